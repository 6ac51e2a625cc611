"""Frontier search for the shortest prefix that passes, with a plugged-in evaluator.

Passing is not monotone in the length, so candidates are asked from the smallest up
and a trace is settled by its first one that passes.  Each round asks, for every
trace that is not settled, the next ``width`` candidates that have no answer yet; a
trace that passed early is never asked again.  Answers are appended to a memo table;
every round, and every later run over the same folder, starts from what it holds, so
no (trace, prefix) pair is asked twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from rungauge.functions.guards import truthy
from rungauge.functions.ranks import with_position
from rungauge.shared import cut_lineage, fresh_folder

Evaluator = Callable[[pa.RecordBatch], pa.Array]


@lru_cache(maxsize=4)
def _loaded(load: Callable[[], Evaluator]) -> Evaluator:
    """One evaluator per Python worker, for loaders that are functions of a module."""
    return load()


def _with_answer(pairs: DataFrame) -> StructType:
    return StructType([*pairs.schema.fields, StructField("ok", BooleanType())])


def evaluated(pairs: DataFrame, load: Callable[[], Evaluator]) -> DataFrame:
    """``pairs`` with the evaluator's answer ``ok`` per row (null where it gave none)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluate = _loaded(load)
        for batch in batches:
            answers = evaluate(batch).cast(pa.bool_())
            if len(answers) != batch.num_rows:
                raise ValueError(f"the evaluator gave {len(answers)} answers for {batch.num_rows} prefixes")
            yield pa.RecordBatch.from_arrays([*batch.columns, answers], names=[*batch.schema.names, "ok"])

    return pairs.mapInArrow(ask, _with_answer(pairs))


def _memo(candidates: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """What has been answered; a folder that is not there yet has no answers."""
    spark = candidates.sparkSession
    schema = _with_answer(candidates.select(*keys))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def search(candidates: DataFrame, key: str, k: str, load: Callable[[], Evaluator], memo: str | None = None, width: int = 1) -> DataFrame:
    """Answers by (key, k): ``rank`` of the candidate in its trace and ``ok``; null where it needed no answer.

    ``candidates`` has one row per (key, k), repeats are asked once; its other columns
    are handed to the evaluator, which takes Arrow batches and gives one boolean per
    row.  ``load`` makes the evaluator in the worker.  ``memo`` is a folder that every
    executor reaches; name it to go on after a restart.  A larger ``width`` asks more
    prefixes than needed in fewer rounds.  Rows without key or length are left out.
    """
    if width < 1:
        raise ValueError("a round asks at least one prefix of a trace")
    pair = [key, k]
    memo = memo or fresh_folder(candidates.sparkSession, "prefix-memo")
    asked = candidates.where(F.col(key).isNotNull() & F.col(k).isNotNull()).dropDuplicates(pair)
    asked = cut_lineage(with_position(asked, [key], [k], "rank"), "prefix-candidates")
    while True:
        answers = _memo(asked, memo, pair).groupBy(*pair).agg(F.bool_or(truthy(F.col("ok"))).alias("ok"))
        state = asked.join(answers.withColumn("_known", F.lit(True)), pair, "left")
        done = F.min(F.when(truthy(F.col("ok")), F.col("rank")))
        following = F.min(F.when(F.col("_known").isNull(), F.col("rank")))
        open_traces = state.groupBy(key).agg(done.alias("_done"), following.alias("_next"))
        open_traces = open_traces.where(F.col("_next").isNotNull() & (F.col("_done").isNull() | (F.col("_next") < F.col("_done"))))
        ask = state.where(F.col("_known").isNull()).join(open_traces, key)
        ask = ask.where((F.col("rank") < F.col("_next") + width) & (F.col("_done").isNull() | (F.col("rank") < F.col("_done"))))
        ask = cut_lineage(ask.select(*asked.columns), "prefix-frontier")
        if ask.isEmpty():
            return state.select(*pair, "rank", "ok")
        evaluated(ask, load).select(*pair, "ok").write.mode("append").parquet(memo)


def shortest(answers: DataFrame, key: str, k: str) -> DataFrame:
    """Per trace: the smallest length that passes, how many prefixes were asked, and why a trace is dropped."""
    found = answers.groupBy(key).agg(
        F.min(F.when(truthy(F.col("ok")), F.col(k))).alias("k_prefix"), F.count("ok").alias("n_evaluated"), F.count("*").alias("n_candidates")
    )
    return found.withColumn("drop_reason", F.when(F.col("k_prefix").isNull(), "replay_drift"))

