"""Session files dealt over folders, and event files of a large table."""

import os

from pyspark.sql import functions as F

from rungauge.plans import streams as plans
from rungauge.sources import readers, sinks


def test_named_files_are_dealt_over_folders_and_found(spark, tmp_path):
    folder = str(tmp_path / "sessions")
    names = spark.range(40).select(F.concat(F.md5(F.col("id").cast("string")), F.lit(".post"), F.col("id").cast("string"), F.lit(".json")).alias("file_name"),
                                   F.concat(F.lit('{"ts": '), (F.col("id") + 1).cast("string"), F.lit("}")).alias("text"))
    assert sinks.write_named_files(names, folder, folders=4).count() == 40
    below = [len(os.listdir(f"{folder}/{d}")) for d in os.listdir(folder)]
    assert len(below) == 4 and sum(n for n in below) >= 40  # Arrow writes no other file, a store may add checksums
    found = readers.read_sessions(spark, folder, since=1.0, until=20.0, slack=1e11)
    assert sorted((r.segment, r.segment_index, r.ts) for r in found.collect()) == [("post", n, n + 1.0) for n in range(20)]


def test_files_of_a_large_table_make_the_same_batches(spark):
    root, more = "/root/testdata/sf0.001", spark.sparkContext.defaultParallelism
    stream = plans.event_files(spark, root, 6, files_per_batch=2, small=0)
    seen = stream.groupBy().count().writeStream.outputMode("update").format("memory").queryName("files_seen").trigger(availableNow=True).start()
    seen.awaitTermination()
    batches = [p["numInputRows"] for p in seen.recentProgress if p["numInputRows"]]
    assert more > 1 and len(batches) == 3 and sum(batches) == spark.read.parquet(f"{root}/events.parquet").count()
