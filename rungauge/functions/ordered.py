"""Running values over an ordered group, safe when one group holds most rows.

A plain window sends a whole group to one task.  Here a group larger than
``target_rows`` is cut into slices along its order, the window runs inside
(group, slice), and what earlier slices contribute is added from a summary with
one row per slice.  Ordinary groups stay in one slice.

What is cut is decided by counted rows.  Slices are ranges of the whole order, so
that rows that agree in the first order columns are cut too; the rows of hot
groups are written with their slice, so a task that is run again after an
executor is lost finds the same cuts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungauge.shared import cut_lineage, sent_if_small

# Rows one task should order at most; a larger group is cut.
TARGET_ROWS = 2_000_000
# Estimated bytes up to which rows are counted before anything is written.
SMALL_BYTES = 256 * 1024 * 1024

KINDS = ("sum", "max", "min", "last", "prev", "next", "first", "total")


def scan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the plan, or None where it is not available."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except (AttributeError, TypeError):  # a session without a local JVM gives no estimate
        return None


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """True when the plan's estimate is below the limit: a guide to what is cheap, not to what is right."""
    size = scan_bytes(df)
    return size is not None and size <= (SMALL_BYTES if limit is None else limit)


# Plan nodes whose work is not repeated lightly.
COSTLY = ("Join ", "Aggregate ", "Window ", "Generate ", "EvalPython", "MapInPandas", "LogicalRDD", "Sort ")


def rereads_cheaply(df: DataFrame) -> bool:
    """True when the plan only scans files, filters and projects."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    except (AttributeError, TypeError):
        return False
    return not any(node in plan for node in COSTLY)


def cut_hot_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Adds ``_slice`` (long) and ``_hot`` (boolean).

    Rows are counted per group with map-side partial sums.  The rows of groups
    above ``target_rows``, however many such groups there are, are range
    partitioned by key and order into as many parts as they fill; a part's number
    is the slice, which rises with the order inside a group.
    """
    hot, n_hot = hot_groups(df, keys, target_rows)
    if not n_hot:
        return df.withColumn("_slice", F.lit(0).cast("long")).withColumn("_hot", F.lit(False))
    return _sliced(df, keys, order, target_rows, hot, n_hot)


def hot_groups(df: DataFrame, keys: Sequence[str], target_rows: int = TARGET_ROWS) -> tuple[DataFrame, int]:
    """The keys of groups above ``target_rows``, and how many rows these groups have together."""
    names = [F.col(k).alias(f"_hot_key_{i}") for i, k in enumerate(keys)]
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > target_rows)
    hot = cut_lineage(hot.select(*names, "_n"), "hot-groups")
    return hot, hot.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], target_rows: int, hot: DataFrame, n_hot: int) -> DataFrame:
    """The rows of hot groups cut into slices, the others in one."""
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_hot_key_{i}")) for i, k in enumerate(keys)])
    marked = df.join(sent_if_small(hot), on, "left").withColumn("_hot", F.col("_n").isNotNull()).drop("_n", *[f"_hot_key_{i}" for i in range(len(keys))])
    parts = -(-n_hot // target_rows)
    sliced = marked.where("_hot").repartitionByRange(parts, *keys, *order).withColumn("_slice", F.spark_partition_id().cast("long"))
    return marked.where(~F.col("_hot")).withColumn("_slice", F.lit(0).cast("long")).unionByName(cut_lineage(sliced, "slices"))


def _local(kind: str, value: Column, upto: Window, whole: Window) -> Column:
    if kind == "sum":
        return F.sum(value).over(upto)
    if kind == "max":
        return F.max(value).over(upto)
    if kind == "min":
        return F.min(value).over(upto)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(upto)
    if kind == "first":
        return F.first(value, ignorenulls=True).over(upto)
    if kind == "prev":
        return F.lag(F.struct(value.alias("v"))).over(whole)
    if kind == "next":
        return F.lead(F.struct(value.alias("v"))).over(whole)
    if kind == "total":
        return F.sum(value).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    raise ValueError(f"unknown running kind {kind!r}; use one of {KINDS}")


def _summary(kind: str, value: Column, order: Column) -> Column:
    if kind in ("sum", "total"):
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    if kind == "min":
        return F.min(value)
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), order))
    if kind == "first":
        return F.min_by(value, F.when(value.isNotNull(), order))
    if kind == "prev":
        return F.max_by(F.struct(value.alias("v")), order)
    return F.min_by(F.struct(value.alias("v")), order)


def _carry(kind: str, name: str, before: Window, whole: Window) -> Column:
    if kind == "sum":
        return F.sum(name).over(before)
    if kind == "max":
        return F.max(name).over(before)
    if kind == "min":
        return F.min(name).over(before)
    if kind == "last":
        return F.last(name, ignorenulls=True).over(before)
    if kind == "first":
        return F.first(name, ignorenulls=True).over(before)
    if kind == "prev":
        return F.lag(name).over(whole)
    if kind == "total":
        everything = F.sum(name).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return everything - F.coalesce(F.col(name), F.lit(0))
    return F.lead(name).over(whole)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind in ("sum", "total"):
        return F.coalesce(local + carry, local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "min":
        return F.least(local, carry)
    if kind == "first":
        return F.coalesce(carry, local)
    if kind == "last":
        return F.coalesce(local, carry)
    return F.coalesce(local, carry)["v"]


class Scan:
    """A table with running values added step by step along one order.

    ``order`` is a total ascending order inside the group.  Rows are counted once,
    for all steps: a table without a group that is too large for one task gets plain
    windows that share one shuffle and one sort.  Another is cut into slices, and the
    rows so far are written before every further step, so steps never recompute each
    other.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], target_rows: int | None = None) -> None:
        self.order = list(order)
        self.keys = list(keys)
        self.helpers: list[str] = []
        if not self.keys:
            df = df.withColumn("_all", F.lit(0))
            self.keys, self.helpers = ["_all"], ["_all"]
        target = target_rows or TARGET_ROWS
        if not is_small(df) and not rereads_cheaply(df):
            df = cut_lineage(df)
        self.plain = df.count() <= target
        if not self.plain:
            if not rereads_cheaply(df):
                df = cut_lineage(df)
            hot, n_hot = hot_groups(df, self.keys, target)
        self.steps = 0
        self.sliced = not self.plain and n_hot > 0
        if not self.sliced:
            self.partition = self.keys
        else:
            df = _sliced(df, self.keys, self.order, target, hot, n_hot)
            self.partition = [*self.keys, "_slice"]
            self.helpers += ["_slice", "_hot"]
        self.df = df

    def column(self, name: str, value: Column) -> "Scan":
        """A column computed from the row alone."""
        self.df = self.df.withColumn(name, value)
        return self

    def add(self, **values: tuple[str, Column]) -> "Scan":
        """Columns name = (kind, expression).

        Kinds: ``sum``/``max``/``min`` up to and with the row, ``last``/``first``
        non-null value up to and with the row, ``prev``/``next`` neighbour's value,
        ``total`` the sum over the whole group.
        """
        if self.steps and self.sliced:
            self.df = cut_lineage(self.df)
        self.steps += 1
        whole = Window.partitionBy(*self.partition).orderBy(*self.order)
        upto = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self.df
        inputs = {name: f"_v_{name}" for name in values}
        rows = rows.withColumns({inputs[name]: value for name, (_, value) in values.items()})
        if not self.sliced:
            local = {name: _local(kind, F.col(inputs[name]), upto, whole) for name, (kind, _) in values.items()}
            out = rows.withColumns(
                {n: c["v"] if values[n][0] in ("prev", "next") else c for n, c in local.items()}
            )
            self.df = out.drop(*inputs.values())
            return self
        per_slice = rows.where("_hot").groupBy(*self.partition).agg(*[
            _summary(kind, F.col(inputs[name]), F.struct(*self.order)).alias(f"_t_{name}")
            for name, (kind, _) in values.items()
        ])
        across = Window.partitionBy(*self.keys).orderBy("_slice")
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        carried = per_slice.select(
            *[F.col(k).alias(f"_carry_key_{i}") for i, k in enumerate(self.partition)],
            *[
                _carry(kind, f"_t_{name}", before, across).alias(f"_p_{name}")
                for name, (kind, _) in values.items()
            ],
        )
        on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_carry_key_{i}")) for i, k in enumerate(self.partition)])
        local = rows.withColumns(
            {f"_l_{name}": _local(kind, F.col(inputs[name]), upto, whole) for name, (kind, _) in values.items()}
        )
        out = local.join(carried, on, "left").withColumns(
            {name: _combine(kind, F.col(f"_l_{name}"), F.col(f"_p_{name}")) for name, (kind, _) in values.items()}
        )
        drop = [*inputs.values(), *[f"_carry_key_{i}" for i in range(len(self.partition))]]
        self.df = out.drop(*drop, *[f"_l_{name}" for name in values], *[f"_p_{name}" for name in values])
        return self

    def add_run(self, name: str, same: Column) -> "Scan":
        """``name``: rows since ``same`` was last false, this row included (0 when false)."""
        self.column("_same", same).add(_rn=("sum", F.lit(1)))
        self.add(_stop=("max", F.when(~F.col("_same"), F.col("_rn"))))
        length = F.col("_rn") - F.coalesce("_stop", F.lit(0))
        self.df = self.df.withColumn(name, length.cast("long")).drop("_same", "_rn", "_stop")
        return self

    def rows(self, *drop: str) -> DataFrame:
        """The table without helper columns."""
        return self.df.drop(*self.helpers, *drop)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, tuple[str, Column]],
    **options,
) -> DataFrame:
    """One step of a ``Scan``: adds one column per entry of ``values``."""
    return Scan(df, keys, order, **options).add(**values).rows()
