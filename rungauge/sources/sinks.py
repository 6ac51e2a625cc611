"""Sinks: JSON lines, parquet, CSV, step folders, manifests and fail-closed publishing."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungauge.functions.hashing import table_digest
from rungauge.functions.rows import keep_first
from rungauge.shared import cut_lineage

# A finished output is never replaced.
NEVER_REPLACE = "errorifexists"


class Refused(ValueError):
    """An output that must not be written."""


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode(NEVER_REPLACE).option("ignoreNullFields", "false").json(path)


def write_split_parquet(df: DataFrame, path: str, split: str = "split") -> None:
    """Train and validation rows below one folder, one partition per side."""
    df.write.mode(NEVER_REPLACE).partitionBy(split).parquet(path)


def write_csv(df: DataFrame, path: str, free_text: Sequence[str] = ()) -> None:
    """CSV without quoting: commas and line ends are taken out of free text."""
    for name in free_text:
        df = df.withColumn(name, scrub(F.col(name)))
    df.write.mode(NEVER_REPLACE).option("header", True).option("quote", "").csv(path)


def scrub(text):
    """Free text for a CSV cell: comma to semicolon, line end to blank."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit(";")), F.lit("\n"), F.lit(" "))


def write_trajectories(df: DataFrame, path: str, split: str = "split", step: str = "global_step") -> None:
    """One record per rollout in a folder per split and step.

    Rows are dealt out by ranges of split, step and a hash of the row: a step has
    as many writers as it fills ranges, and small steps share one.
    """
    dealt = df.repartitionByRange(split, step, F.xxhash64(*df.columns))
    dealt.write.mode(NEVER_REPLACE).partitionBy(split, step).json(path)


def manifest(df: DataFrame, protocol: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows and content digest per output, under a protocol tag."""
    return table_digest(df, keys, columns).withColumn("protocol", F.lit(protocol))


def write_manifest(manifest_rows: DataFrame, path: str) -> None:
    """Written last: its presence says that the outputs are whole."""
    manifest_rows.repartition(1).write.mode(NEVER_REPLACE).json(path)


def publish(summary: DataFrame, path: str, complete: str = "complete") -> None:
    """Publishes a complete one-row summary as one JSON file; refuses anything else.

    The file is written whole under a name of its own and then renamed by the
    call that fails when the target exists, also when it appeared in between.
    Whatever happens, no staging file stays.
    """
    spark: SparkSession = summary.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    target = hadoop.Path(path)
    files = target.getFileSystem(conf)
    target = files.makeQualified(target)
    if files.exists(target):
        raise Refused(f"refusing to overwrite {path}")
    checks = summary.agg(F.count("*").alias("n"), F.min(F.col(complete).cast("int")).alias("ok")).first()
    if checks.n != 1 or checks.ok != 1:
        raise Refused("summary is not complete")
    line = summary.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]
    staging = hadoop.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    none[0] = hadoop.Options.Rename.NONE
    try:
        stream = files.create(staging, False)
        stream.write(bytearray((line + "\n").encode()))
        stream.close()
        hadoop.FileContext.getFileContext(target.toUri(), conf).rename(staging, target, none)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise Refused(f"refusing to overwrite {path}") from error
        raise
    finally:
        files.delete(staging, False)


def not_done(df: DataFrame, ledger: DataFrame, key: str, ledger_key: str | None = None) -> DataFrame:
    """Rows whose id is not in the append-only ledger yet."""
    done = ledger.select(F.col(ledger_key or key).alias("_done")).where(F.col("_done").isNotNull())
    return df.join(done, df[key] == F.col("_done"), "left_anti")


def append_results(df: DataFrame, path: str, key: str) -> None:
    """Adds rows for ids that the ledger does not hold yet, once per id; a ledger has one writer at a time."""
    spark = df.sparkSession
    fresh = keep_first(df, [key], [F.xxhash64(*df.columns)])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # not on the first run
        fresh = not_done(fresh, spark.read.schema(df.schema).json(path), key)
    fresh.write.mode("append").json(path)


def write_named_files(df: DataFrame, folder: str, name: str = "file_name", text: str = "text", folders: int | None = None) -> DataFrame:
    """One file per row, under the row's own name below ``folder``; returns the names and sizes written.

    For stores that Arrow opens.  A name holds no folder, and is unique: a task that
    runs again writes the same file again.  Rows are dealt over the tasks by name.
    With ``folders`` the files are dealt over as many folders below ``folder``, so that
    many files can be listed side by side.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(f"file://{folder.removeprefix('file:')}" if folder.startswith("file:/") and not folder.startswith("file://") else folder)
        store.create_dir(path, recursive=True)
        made = {None}
        for batch in batches:
            sizes = []
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not file or "/" in file:
                    raise ValueError(f"no file name: {file!r}")
                data = (value or "").encode()
                below = None if folders is None else f"{zlib.crc32(file.encode()) % folders:05d}"
                if below not in made:
                    store.create_dir(f"{path}/{below}", recursive=True)
                    made.add(below)
                with store.open_output_stream(f"{path}/{file}" if below is None else f"{path}/{below}/{file}", compression=None) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["file_name", "n_bytes"])

    rows = df.select(F.col(name).alias("file_name"), F.col(text).alias("text")).repartition("file_name")
    return cut_lineage(rows.mapInArrow(write, "file_name string, n_bytes long"), "named-files")
