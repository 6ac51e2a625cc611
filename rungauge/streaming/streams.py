"""Structured Streaming forms: windows with late data, sessions, ordered state, the live monitor.

Counts, windows, sessions and duplicates use Spark's state store behind a
watermark, and so does ordered logic per client (``state.ordered_fold``) and the
monitor's table of steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungauge.functions.rows import keep_last
from rungauge.shared import fresh_folder
from rungauge.streaming.state import latest_series, rocksdb


def file_stream(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.parquet", files_per_batch: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def event_time(ts: Column) -> Column:
    """A timestamp without zone as the event time a watermark needs (session zone UTC)."""
    return ts.cast("timestamp")


def drain(stream: DataFrame, mode: str = "append", label: str = "stream") -> DataFrame:
    """Runs a stream over all it has now and gives the written rows back.

    Output and checkpoint lie in the shared folder, so a restarted query goes on
    where it stopped.
    """
    spark = stream.sparkSession
    out = fresh_folder(spark, label)
    if mode == "append":
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", out)
    else:
        # Every batch replaces its own folder: running it again changes nothing.
        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

        writer = stream.writeStream.outputMode(mode).foreachBatch(keep)
    query = writer.option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(_with_batch(stream, mode)).parquet(out if mode == "append" else f"{out}/part=*")
    return rows


END = "2261-01-01 00:00:00"  # in the range of pandas, which counts nanoseconds


def drain_whole(stream: DataFrame, windows: Callable[[DataFrame], DataFrame], at: str, label: str = "stream") -> DataFrame:
    """The windows of a finished stream, the last ones too.

    A watermark closes a window only when later rows come, so the end of the
    input is told to the stream by one row of its own: after the input is
    drained, a row at the end of time is put in a second folder of the stream
    and the same query goes on from its checkpoint.  That row's own windows end
    later still and stay open.
    """
    spark = stream.sparkSession
    ends, out = fresh_folder(spark, f"{label}-end"), fresh_folder(spark, label)
    nothing = spark.createDataFrame([], stream.schema)
    nothing.write.parquet(ends)
    result = windows(stream.unionByName(spark.readStream.schema(stream.schema).parquet(ends)))

    def go_on() -> None:
        writer = result.writeStream.outputMode("append").format("parquet").option("path", out)
        writer.option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start().awaitTermination()

    go_on()
    last = [F.lit(END).cast("timestamp").alias(f.name) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(*last).write.mode("append").parquet(ends)
    go_on()
    return spark.read.schema(result.schema).parquet(out)


def _with_batch(stream: DataFrame, mode: str) -> T.StructType:
    if mode == "append":
        return stream.schema
    return T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest version of every key of an update stream."""
    return keep_last(rows, list(keys), ["_batch"]).drop("_batch")


def capture_rates(calls: DataFrame, at: str, outcome: str, window: str, lateness: str, threshold: float) -> DataFrame:
    """Outcome counts and capture rate per window; a window below the threshold is marked."""
    counted = calls.withWatermark(at, lateness).groupBy(F.window(at, window).alias("w")).agg(
        F.count("*").alias("n_calls"), F.count_if(F.col(outcome) == "kept").alias("n_kept"),
        F.count_if(F.col(outcome) == "error").alias("n_error"), F.count_if(F.col(outcome) == "no_ids").alias("n_no_ids"),
    )
    rate = F.col("n_kept") / F.col("n_calls")
    return counted.select(
        F.col("w.start").alias("window_start"), "n_calls", "n_kept", "n_error", "n_no_ids", rate.alias("rate"), (rate < threshold).alias("below")
    )


def sliding_counts(rows: DataFrame, at: str, width: str, slide: str, lateness: str) -> DataFrame:
    """Rows per sliding window.  Late rows count until the watermark has passed their window."""
    counted = rows.withWatermark(at, lateness).groupBy(F.window(at, width, slide).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def gap_session_stream(rows: DataFrame, key: str, at: str, gap: str, lateness: str) -> DataFrame:
    """Sessions of a key that end after a pause.

    Rows of one micro-batch are merged into partial sessions before the shuffle.
    """
    found = rows.withWatermark(at, lateness).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def message_parts(deltas: DataFrame, keys: Sequence[str], at: str, window: str, lateness: str, order: Sequence[str]) -> DataFrame:
    """Parts of streamed messages (``sequences.chunk_deltas``), one message per keys and window.

    Spark's state store holds the pieces of each open part, until the watermark has
    passed the window; then the part comes out whole, its pieces in order whatever
    order they arrived in.  ``sequences.messages_of_parts`` makes messages of it.
    """
    piece = F.struct(*order, "place", "piece")
    found = deltas.withWatermark(at, lateness).groupBy(F.window(at, window).alias("w"), *keys, "kind", "index").agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
    joined = F.array_join(F.transform("_pieces", lambda x: F.coalesce(x["piece"], F.lit(""))), "")
    return found.select(
        *keys, F.col("w.start").alias("window_start"), "kind", "index", joined.alias("text"),
        F.element_at("_pieces", -1)["piece"].alias("last"), F.size("_pieces").cast("long").alias("n"),
    )


def once_per_id(rows: DataFrame, key: str, at: str, lateness: str) -> DataFrame:
    """Repeated ids inside the lateness pass once."""
    return rows.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


class LiveMonitor:
    """Step metrics as a stream: the latest line of a step wins, then every rule is judged.

    Spark's state store holds the lines.  A batch judges the runs that it touches,
    all their steps, because a corrected step changes the rules of later ones; only
    the last judgement of a run counts.  Warnings are recorded; with ``stop`` a run
    ends at its first stop-level alarm: later steps, in the same batch or another,
    are not part of it.  Tables depend on the lines, not on how batches cut them.
    """

    def __init__(self, judge: Callable[[DataFrame], DataFrame], alarms: Callable[[DataFrame], DataFrame], stop: bool = True) -> None:
        self.judge, self.alarms, self.stop = judge, alarms, stop

    def run(self, stream: DataFrame, keys: Sequence[str], order: str, label: str = "monitor") -> tuple[DataFrame, DataFrame]:
        """Health and alarm tables after all steps there are now; ``keys`` are those of a run and, last, its step."""
        spark = stream.sparkSession
        root = fresh_folder(spark, label)
        runs, step = list(keys[:-1]), keys[-1]

        def upto_stop(rows: DataFrame, ends: DataFrame) -> DataFrame:
            return rows.join(ends, runs, "left").where(F.col("_end").isNull() | (F.col(step) <= F.col("_end"))).drop("_end")

        def batch(rows: DataFrame, number: int) -> None:
            here = rows.sparkSession
            self.judge(rows.drop(order)).write.mode("overwrite").parquet(f"{root}/judged-{number}")
            health = here.read.parquet(f"{root}/judged-{number}")
            found = self.alarms(health)
            if self.stop:
                ends = found.where("severity = 'stop'").groupBy(*runs).agg(F.min(step).alias("_end"))
                health, found = upto_stop(health, ends), upto_stop(found, ends)
            health.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/health-{number}")
            found.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/alarms-{number}")

        with rocksdb(spark):
            query = (
                latest_series(stream, runs, step, order).writeStream.foreachBatch(batch)
                .option("checkpointLocation", f"{root}/checkpoint")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
        health = spark.read.parquet(f"{root}/health-*")
        last = health.groupBy(*runs).agg(F.max("_batch").alias("_batch"))
        newest = [*runs, "_batch"]
        return health.join(last, newest, "left_semi").drop("_batch"), spark.read.parquet(f"{root}/alarms-*").join(last, newest, "left_semi").drop("_batch")
