"""Keep-first, keep-last and order helpers that stay aggregates (partial, skew-safe)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungauge.functions.ordered import running
from rungauge.functions.ranks import with_position


def _keep(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    order_columns = [F.col(o) if isinstance(o, str) else o for o in order]
    row = pick(F.struct(*rest), F.struct(*order_columns)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key.  An aggregate, not a window: copies are merged before the shuffle."""
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Last row per key, merged before the shuffle."""
    return _keep(df, keys, order, F.max_by)


def global_position(
    df: DataFrame,
    groups: Sequence[str],
    within: Sequence[str],
    name: str = "rn",
    **options,
) -> DataFrame:
    """1-based position in the order (groups, within) over the whole table.

    Positions inside a group plus the rows of earlier groups, so neither a huge
    group nor the whole table is sorted in one task.
    """
    sizes = df.groupBy(*groups).agg(F.count("*").alias("_n"))
    offsets = running(sizes, [], list(groups), {"_upto": ("sum", F.col("_n"))}, **options)
    offsets = offsets.select(
        *[F.col(g).alias(f"_group_{i}") for i, g in enumerate(groups)], (F.col("_upto") - F.col("_n")).alias("_before")
    )
    placed = with_position(df, groups, within, "_at", **options)
    on = None
    for i, g in enumerate(groups):
        same = F.col(g).eqNullSafe(F.col(f"_group_{i}"))
        on = same if on is None else on & same
    return (
        placed.join(offsets, on, "left")
        .withColumn(name, (F.col("_before") + F.col("_at")).cast("long"))
        .drop("_before", "_at", *[f"_group_{i}" for i in range(len(groups))])
    )
