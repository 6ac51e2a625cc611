"""Positions and exact index percentiles without a single-task sort."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungauge.functions.ordered import running


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "rn",
    **options,
) -> DataFrame:
    """Adds the 1-based position in the group's order."""
    out = running(df, keys, order, {name: ("sum", F.lit(1))}, **options)
    return out.withColumn(name, F.col(name).cast("long"))


# Index rules, each a function of the row count; values are 0-based positions.
def index_card(share: float) -> Callable[[Column], Column]:
    """min(n - 1, int(share * n))."""
    return lambda n: F.least(n - 1, F.floor(F.lit(float(share)) * n))


def index_tail(share: float) -> Callable[[Column], Column]:
    """int(n * share), the form used by the assembly report and the ETA."""
    return lambda n: F.floor(n * F.lit(float(share)))


def index_half() -> Callable[[Column], Column]:
    """n // 2."""
    return lambda n: F.floor(n / 2)


def index_round(share: float) -> Callable[[Column], Column]:
    """round((n - 1) * share), half to even, inside 0 .. n - 1."""
    return lambda n: F.least(n - 1, F.greatest(F.lit(0), F.bround((n - 1) * F.lit(float(share)))))


def value_at(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: dict[str, Callable[[Column], Column]],
    **options,
) -> DataFrame:
    """One row per group with the value at each wanted index of its sorted non-null values.

    Equal values are counted before anything is ordered, so the ordered table
    holds distinct values only; a hot group is ordered in slices.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    placed = running(
        counted, keys, [value], {"_upto": ("sum", F.col("_c"))}, **options
    )
    totals = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if keys:
        totals = totals.select(*[F.col(k).alias(f"_total_key_{i}") for i, k in enumerate(keys)], "_n")
        match = [F.col(k).eqNullSafe(F.col(f"_total_key_{i}")) for i, k in enumerate(keys)]
    else:
        placed = placed.withColumn("_one", F.lit(1))
        totals = totals.select("_n", F.lit(1).alias("_total_one"))
        match = [F.col("_one") == F.col("_total_one")]
    on = match[0]
    for extra in match[1:]:
        on = on & extra
    joined = placed.join(totals, on)
    columns = []
    for name, index in wanted.items():
        at = index(F.col("_n"))
        here = (F.col("_upto") - F.col("_c") <= at) & (at < F.col("_upto"))
        columns.append(F.max(F.when(here, F.col(value))).alias(name))
    return joined.groupBy(*keys).agg(*columns)


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", **options) -> DataFrame:
    """Mean of the two middle values, one row per group."""
    out = value_at(
        df,
        keys,
        value,
        {"_a": lambda n: F.floor((n - 1) / 2), "_b": lambda n: F.floor(n / 2)},
        **options,
    )
    return out.withColumn(name, (F.col("_a") + F.col("_b")) / 2.0).drop("_a", "_b")
