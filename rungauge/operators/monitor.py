"""Run monitoring: ordered rules over the steps of a run.

The step series is an aggregate with one row per run and step, so a window per
run is small whatever the size of the data behind it.  A missing metric is null
and makes a rule's flag false; it is never 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungauge.functions.guards import ratio, truthy

# Rules and their severity; a warning never stops a run.
WARN_ONLY = (91,)
STOP_MERGE_BREAKS = 4


def _order(run: Sequence[str], step: str):
    return Window.partitionBy(*run).orderBy(step)


def consecutive(flag: Column, n: int, order) -> Column:
    """The last n rows all hold; fewer rows do not."""
    last = order.rowsBetween(-(n - 1), Window.currentRow)
    held = truthy(flag).cast("int")
    return (F.sum(held).over(last) == n) & (F.count(F.lit(1)).over(last) == n)


def with_baseline(series: DataFrame, run: Sequence[str], step: str, value: str, name: str) -> DataFrame:
    """Adds the mean of the first two present values, null before the second is there.

    Also ``<name>_seen``, how many values were present up to the row.
    """
    order = _order(run, step)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = series.withColumn(f"{name}_seen", F.count(value).over(upto))
    first_two = F.when((F.col(f"{name}_seen") <= 2) & F.col(value).isNotNull(), F.col(value))
    whole = Window.partitionBy(*run)
    both = F.sum(first_two).over(whole) / 2.0
    return seen.withColumn(name, F.when(F.col(f"{name}_seen") >= 2, both))


def collapse(series: DataFrame, run: Sequence[str], step: str, value: str, share: float, name: str, times: int = 2) -> DataFrame:
    """Adds ``name``: below share x baseline ``times`` rows in a row, judged from the third value on.

    Rows are compared with the same baseline wherever they stand, as a replay of
    the log up to the row would.
    """
    order = _order(run, step)
    based = with_baseline(series, run, step, value, "_base")
    whole = Window.partitionBy(*run)
    baseline = F.max("_base").over(whole)
    low = F.col(value) < share * baseline
    rows = F.row_number().over(order)
    fired = consecutive(low, times, order) & (F.col("_base_seen") >= 3) & (rows >= 3)
    return based.withColumn(name, truthy(fired)).drop("_base", "_base_seen")


def no_signal(series: DataFrame, run: Sequence[str], step: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the baseline itself is not positive."""
    order = _order(run, step)
    based = with_baseline(series, run, step, value, "_base")
    fired = (F.col("_base") <= 0) & (F.col("_base_seen") >= 3) & (F.row_number().over(order) >= 3)
    return based.withColumn(name, truthy(fired)).drop("_base", "_base_seen")


def drift(series: DataFrame, run: Sequence[str], step: str, value: str, share: float, name: str, back: int = 5) -> DataFrame:
    """Adds ``name``: below share x mean of the present values of the previous rows, twice in a row."""
    order = _order(run, step)
    before = F.avg(value).over(order.rowsBetween(-back, -1))
    marked = series.withColumn("_low", truthy(ratio(F.col(value), before) < share))
    seen = F.count(value).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fired = consecutive(F.col("_low"), 2, order) & (F.row_number().over(order) >= 3) & (seen >= 3)
    return marked.withColumn(name, fired).drop("_low")


def spike(series: DataFrame, run: Sequence[str], step: str, value: str, name: str, factor: float = 10.0) -> DataFrame:
    """Adds ``name``: not a number in the last two rows, or both last values above factor x their median before.

    The median is over the ten present values before the last two.  A missing
    value among the last two rows counts as not a number once two values are there.
    """
    order = _order(run, step)
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(F.col(value)) == float("inf"))
    broken = F.max(bad.cast("int")).over(order.rowsBetween(-1, Window.currentRow)) == 1
    seen = F.count(value).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = series.withColumn("_seen", seen).withColumn("_broken", broken).withColumn("_place", F.row_number().over(order))
    # Present values only: the row series without gaps, joined back by the running count.
    present = marked.where(F.col(value).isNotNull())
    middle = F.percentile(value, F.lit(0.5)).over(order.rowsBetween(-11, -2))
    high = present.select(
        *[F.col(k).alias(f"_p_{i}") for i, k in enumerate(run)],
        F.col("_seen").alias("_p_seen"),
        middle.alias("_median"),
        F.least(F.col(value), F.lag(value).over(order)).alias("_lower"),
    )
    on = F.col("_seen") == F.col("_p_seen")
    for i, k in enumerate(run):
        on = on & F.col(k).eqNullSafe(F.col(f"_p_{i}"))
    out = marked.join(high, on, "left")
    spiked = (F.col("_seen") >= 12) & (F.col("_median") > 0) & (F.col("_lower") > factor * F.col("_median"))
    fired = (F.col("_place") >= 3) & truthy(F.when(F.col("_broken"), F.col("_seen") >= 2).otherwise(spiked))
    return out.withColumn(name, fired).drop(
        "_seen", "_broken", "_place", "_p_seen", "_median", "_lower", *[f"_p_{i}" for i in range(len(run))]
    )


def share_rules(series: DataFrame, run: Sequence[str], step: str) -> DataFrame:
    """Adds rules 3, 4, 5, 9 and 91, and the shares they look at.

    Needs groups_zero_adv, groups_seen, n_traced, n_rollouts, is_mean and
    merge_mismatch_rows.  ``groups_seen`` stays beside its share, because a
    resampled run decides that denominator itself.
    """
    order = _order(run, step)
    out = series.withColumn("zero_share", ratio(F.col("groups_zero_adv"), F.col("groups_seen"))).withColumn(
        "capture_rate", ratio(F.col("n_traced"), F.col("n_rollouts"))
    )
    third = F.row_number().over(order) >= 3
    breaks = F.col("merge_mismatch_rows")
    return (
        out.withColumn("rule_3", third & consecutive(F.col("zero_share") > 0.60, 3, order))
        .withColumn("rule_4", third & consecutive(F.col("capture_rate") < 0.90, 2, order))
        .withColumn("rule_5", third & consecutive((F.col("is_mean") < 0.85) | (F.col("is_mean") > 1.15), 2, order))
        .withColumn("rule_9", truthy(breaks >= STOP_MERGE_BREAKS))
        .withColumn("rule_91", truthy((breaks > 0) & (breaks < STOP_MERGE_BREAKS)))
    )


def judge(series: DataFrame, run: Sequence[str] = ("run",), step: str = "step") -> DataFrame:
    """Every rule at every step of every run, in one pass: the full replay history."""
    out = collapse(series, run, step, "response_length", 0.50, "rule_1")
    out = drift(out, run, step, "response_length", 0.55, "rule_2")
    out = share_rules(out, run, step)
    out = spike(out, run, step, "grad_norm", "rule_6")
    out = no_signal(out, run, step, "reward", "_none")
    out = collapse(out, run, step, "reward", 0.40, "_low")
    return out.withColumn("rule_7", F.col("_none") | F.col("_low")).drop("_none", "_low")


RULES = (1, 2, 3, 4, 5, 6, 7, 9, 91)


def alarms(judged: DataFrame, run: Sequence[str] = ("run",), step: str = "step") -> DataFrame:
    """One row per fired rule and step, with its severity."""
    rows = F.explode(
        F.array_compact(
            F.array(*[F.when(F.col(f"rule_{r}"), F.struct(F.lit(r).alias("rule"), F.lit("warn" if r in WARN_ONLY else "stop").alias("severity"))) for r in RULES])
        )
    )
    return judged.select(*run, step, rows.alias("a")).select(*run, step, "a.rule", "a.severity")


def first_firing(fired: DataFrame, run: Sequence[str] = ("run",), step: str = "step") -> DataFrame:
    """First step of each rule in each run, and how often it fired."""
    return fired.groupBy(*run, "rule", "severity").agg(F.min(step).alias("first_step"), F.count("*").alias("n_steps"))


def pair_margin(series: DataFrame, run: Sequence[str], step: str, value: str, share: float) -> DataFrame:
    """How far a run stayed above a collapse threshold when two rows in a row count.

    The smallest larger-of-two-neighbours over share x baseline; rows without
    the value are left out.
    """
    present = series.where(F.col(value).isNotNull())
    order = _order(run, step)
    based = with_baseline(present, run, step, value, "_base")
    pairs = based.select(
        *run, "_base", F.when(F.lead(value).over(order).isNotNull(), F.greatest(F.col(value), F.lead(value).over(order))).alias("_pair")
    )
    out = pairs.groupBy(*run).agg(F.min("_pair").alias("lowest_pair"), F.max("_base").alias("baseline"))
    return out.withColumn("margin", ratio(F.col("lowest_pair"), F.col("baseline") * share))


def block_average(series: DataFrame, run: Sequence[str], step: str, values: Sequence[str], complete: Column, width: int = 20) -> DataFrame:
    """Means over blocks of ``width`` consecutive rows, and whether every row of the block was complete."""
    order = _order(run, step)
    block = F.floor((F.row_number().over(order) - 1) / width).cast("long")
    return (
        series.withColumn("block", block)
        .withColumn("_ok", truthy(complete))
        .groupBy(*run, "block")
        .agg(
            F.min(step).alias("first_step"),
            F.max(step).alias("last_step"),
            F.count("*").alias("n_steps"),
            *[F.avg(v).alias(v) for v in values],
            F.bool_and("_ok").alias("complete"),
        )
    )


def merge_round_metrics(metrics: DataFrame, keys: Sequence[str], name: str, round_no: str, value: str) -> DataFrame:
    """Metrics of several rounds as one: counts named ``training/n_`` add up, others keep the last round's."""
    out = metrics.groupBy(*keys, name).agg(
        F.sum(value).alias("_sum"), F.max_by(value, round_no).alias("_last"), F.count("*").alias("n_rounds")
    )
    merged = F.when(F.col(name).startswith("training/n_"), F.col("_sum")).otherwise(F.col("_last"))
    return out.withColumn("value", merged).drop("_sum", "_last")


def grid_share(metrics: DataFrame, name: str, value: str, denominator: int = 512) -> DataFrame:
    """Share of a metric's values that lie on the grid k / denominator."""
    scaled = F.col(value) * denominator
    out = metrics.where(F.col(value).isNotNull()).groupBy(name).agg(
        F.count("*").alias("n"), F.count_if(scaled == F.floor(scaled)).alias("n_on_grid")
    )
    return out.withColumn("share", ratio(F.col("n_on_grid"), F.col("n")))
