"""The folder every executor can reach.

Written tables, stream checkpoints and lineage cuts go to the folder named in
``spark.checkpoint.dir``.  Only a local session without that setting (a test,
a laptop) gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that every executor can reach")
    return _local_folders.setdefault(context.applicationId, tempfile.mkdtemp(prefix="rungauge-"))


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder name below the shared one."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "rows") -> DataFrame:
    """The rows written once to a table in the shared folder and read back from there.

    What reads them next neither repeats the work behind them nor loses it with
    an executor, reads only the columns it needs, and knows their real size.
    """
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SENT_ROWS = 2_000_000  # narrow rows of a broadcast side: some tens of MB


def sent_if_small(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """A narrow side marked for broadcast when it has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
