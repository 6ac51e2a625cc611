"""Session settings and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from rungauge.functions.ordered import is_small

# What the engine asks of a session.  Sizes are left to AQE: partitions start
# numerous and are coalesced to the advisory size, skewed join partitions split.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(
    app: str = "rungauge", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with the engine's settings; the cluster's own values win where it sets any."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a dataset folder: a parquet file or a folder of them."""
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


# Below this an input is worth spreading; above it the files have splits enough.
SPREAD_BYTES = 64 * 1024 * 1024


def spread(df: DataFrame, key: str, at_most: DataFrame | None = None) -> DataFrame:
    """A small input spread over the cores before work that is heavy per row.

    A small file is often one row group, which a single task would read and
    process.  The size is checked first: a large input is not shuffled.  ``at_most``
    names a table with as many rows where a join has inflated the estimate.
    """
    if not is_small(df if at_most is None else at_most, SPREAD_BYTES):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def spread_table(spark: SparkSession, root: str, name: str, key: str) -> DataFrame:
    """A table for row-heavy work."""
    return spread(table(spark, root, name), key)
