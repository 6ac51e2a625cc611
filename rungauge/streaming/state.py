"""Ordered logic per key in Spark's own state store.

Rows of a key wait in the store until the watermark has passed them, and are then
taken in event-time order, whatever order and micro-batch they came in.  The
result therefore depends on the rows alone.  Rows later than the watermark are
dropped by Spark.

Keys share a fixed number of buckets, and the store is asked once per bucket and
batch, not once per key or row.  One task holds one bucket's waiting rows while a
timer of it fires (the rows of the lateness, not of the past) and the small states
of its keys, which are written again whenever the bucket folds rows.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BUCKETS = 2048  # of keys; fixed for a checkpoint
OUT_ROWS = 10_000  # handed on at once

State = tuple
Fold = Callable[[State, dict], tuple[State, tuple]]


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which timers and lists need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _plain(rows: pd.DataFrame, schema: T.StructType) -> list[tuple]:
    """Rows as tuples of the schema; pandas' missing values are nulls again, and whole numbers whole."""
    columns = []
    for field in schema:
        whole = isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        values = rows[field.name]
        missing = values.isna()
        if missing.any():
            columns.append([None if gone else int(v) if whole else v for v, gone in zip(values.tolist(), missing.tolist())])
        else:
            columns.append(values.astype("int64").tolist() if whole else values.tolist())
    return list(zip(*columns))


class OrderedFold(StatefulProcessor):
    """Folds each key's rows of a bucket of keys in event-time order; each row gives its output columns.

    ``fold`` is (state, row) -> (state, outputs); the state is null fields for a
    new key.  The first column of ``order`` is the event time in microseconds; a
    row without it takes no part.  The store keeps the rows of a batch together,
    and the states of all keys of the bucket.
    """

    def __init__(self, rows: T.StructType, key: str, order: Sequence[str], state: T.StructType, fold: Fold, out: Sequence[str]) -> None:
        self.rows, self.key, self.order, self.fields, self.fold, self.out = rows, key, list(order), state, fold, list(out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.states = handle.getValueState("states", "states binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest, place = None, self.rows.fieldNames().index(self.order[0])
        for part in rows:
            found = [r for r in _plain(part, self.rows) if r[place] is not None]
            if found:
                self.waiting.appendValue((pickle.dumps(found),))
                latest = max([r[place] for r in found] + ([] if latest is None else [latest]))
        if latest is not None:
            self.handle.registerTimer(-(-latest // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names = self.rows.fieldNames()
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        places, of = [names.index(c) for c in self.order], names.index(self.key)
        ready, later = defaultdict(list), []
        for (rows,) in self.waiting.get() if self.waiting.exists() else ():
            for row in pickle.loads(rows):
                (ready[row[of]] if row[places[0]] <= upto else later).append(row)
        if not ready:
            return iter([])
        states = pickle.loads(self.states.get()[0]) if self.states.exists() else {}
        outputs = []
        for one, rows in ready.items():
            rows.sort(key=lambda row: [(row[p] is not None, row[p]) for p in places])
            state = states.get(one, (None,) * len(self.fields))
            for row in rows:
                state, result = self.fold(state, dict(zip(names, row)))
                outputs.append((*row, *result))
            states[one] = state
        self.states.update((pickle.dumps(states),))
        if later:
            self.waiting.put([(pickle.dumps(later[n : n + OUT_ROWS]),) for n in range(0, len(later), OUT_ROWS)])
        else:
            self.waiting.clear()
        columns = [*names, *self.out]
        return (pd.DataFrame(outputs[n : n + OUT_ROWS], columns=columns, dtype=object) for n in range(0, len(outputs), OUT_ROWS))


def ordered_fold(
    stream: DataFrame, key: str, order: Sequence[str], at: str, lateness: str, state: str, fold: Fold, out: str, buckets: int = BUCKETS
) -> DataFrame:
    """Rows of a stream with the columns ``out`` (DDL) that ``fold`` gives them, per key and in event-time order."""
    kept = [f for f in stream.schema if f.name != at]
    columns, fields = T.StructType(kept), T.StructType.fromDDL(out)
    processor = OrderedFold(columns, key, order, T.StructType.fromDDL(state), fold, fields.fieldNames())
    timed = stream.withWatermark(at, lateness).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    return timed.groupBy("_bucket").transformWithStateInPandas(processor, T.StructType([*columns, *fields]), "Append", "EventTime")


class LatestLines(StatefulProcessor):
    """Keeps the latest line of every step of a run; a batch gives the whole series of each run that it touches."""

    def __init__(self, rows: T.StructType, step: str, order: str) -> None:
        self.rows, self.step, self.order = rows, step, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getMapState("lines", T.StructType([self.rows[self.step]]), self.rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = self.rows.fieldNames()
        step, order = names.index(self.step), names.index(self.order)
        for part in rows:
            for row in _plain(part, self.rows):
                at = (row[step],)
                if not self.lines.containsKey(at) or self.lines.getValue(at)[order] < row[order]:
                    self.lines.updateValue(at, row)
        return iter([pd.DataFrame([tuple(v) for v in self.lines.values()], columns=names, dtype=object)])


def latest_series(stream: DataFrame, run: Sequence[str], step: str, order: str) -> DataFrame:
    """Per micro-batch the series of every touched run, the line with the highest ``order`` of each step."""
    return stream.groupBy(*run).transformWithStateInPandas(LatestLines(stream.schema, step, order), stream.schema, "Append", "None")
