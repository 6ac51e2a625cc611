"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket; the bucket in which a source's budget
runs out is cut again into finer buckets, and only that one, until it holds a
single hash value.  Documents below the threshold are in.  Nothing is sorted, and
thresholds are nested: a larger budget keeps what a smaller one kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungauge.shared import cut_lineage

HASH_BITS = 60
STEP_BITS = 12
WEIGHTS = (5, 2, 1)
MOST = 3


def size_of(text: Column) -> Column:
    """Words between white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(key: Column, text: Column) -> Column:
    """60 bits of a row's identity and text: the same on every run and layout."""
    own = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``target`` of each ``source`` from its ``source_size``.

    Sources in code point order (null last) weigh as listed, again and again, and
    share the sum of all sizes.  A target stops at ``most`` times its source's
    size; what is over is shared again by weight.  That ends where each target is
    min(cap, level * weight); the level follows from running sums over the sources
    by cap per weight.  One row per source is ordered, no documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    earlier = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumn("left", F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
    rows = rows.withColumn("weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    fits = F.col("left") < F.col("ratio") * F.col("weights")
    level = F.min_by(F.when(fits, F.col("left") / F.col("weights")), F.when(fits, F.col("ratio"))).over(every)
    return rows.select("source", "source_size", F.coalesce(F.least("cap", level * F.col("weight")), F.lit(0.0)).alias("target"))


def boundaries(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Where each source's ``budget`` runs out: ``edge`` (a hash), the ``edge_size`` it has, and the budget ``rest``.

    ``rows``: source, h, size.  Hashes below ``edge`` fit whole.  A source whose
    rows all fit has no boundary row.
    """
    edges = budgets.select("source", F.col("budget").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for used in range(0, HASH_BITS, STEP_BITS):
        shift = HASH_BITS - used - STEP_BITS
        at = edges.select(F.col("source").alias("of"), "rest", "prefix")
        inside = rows.join(at, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("h", shift + STEP_BITS) == F.col("prefix")))
        cells = inside.groupBy("source", "rest", F.shiftright("h", shift).alias("cell")).agg(
            F.sum("size").alias("total"), F.min(F.when(F.col("size") > 0, F.col("h"))).alias("low"), F.max(F.when(F.col("size") > 0, F.col("h"))).alias("high")
        )
        cells = cells.withColumn("upto", F.sum("total").over(Window.partitionBy("source").orderBy("cell")))
        over = cells.filter(F.col("upto") > F.col("rest"))
        found = over.groupBy("source").agg(F.min_by(F.struct("cell", "total", "low", "high", "upto", "rest"), F.col("cell")).alias("b"))
        edges = cut_lineage(
            found.select(
                "source",
                (F.col("b.rest") - (F.col("b.upto") - F.col("b.total"))).alias("rest"),
                F.col("b.cell").alias("prefix"),
                F.col("b.total").alias("edge_size"),
                F.col("b.low").alias("edge"),
                (F.col("b.low") == F.col("b.high")).alias("single"),
            ),
            "mix-edges",
        )
        if edges.filter(~F.col("single")).isEmpty():
            break
    return edges.select("source", "edge", "edge_size", "rest")


def mixed(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``rows`` (source, size, h and others) with ``source_size``, ``target``, ``taken`` (words) and ``copies`` (whole texts).

    A target of k times its source and a rest takes every document k times and
    those below the rest's threshold once more.  The document at the threshold is
    cut: as many of its words are taken as still fit, so that a source ends within
    a word of its target; rows that tie there share the rest in proportion.
    ``copies`` counts it as whole when at least half fits.  A row without words has
    ``taken`` 0.  ``rows`` is read several times: pass a written table.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, most).withColumn("whole", F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).cast("long"))
    goals = cut_lineage(goals.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goals")
    edges = boundaries(rows.select("source", "h", "size"), goals)
    plan = goals.select(F.col("source").alias("of"), "source_size", "target", "whole").join(
        edges.select(F.col("source").alias("edge_of"), "edge", "edge_size", "rest"), F.col("of").eqNullSafe(F.col("edge_of")), "left"
    )
    share = F.col("rest") / F.col("edge_size")
    at_edge = F.floor(F.col("size") * share).cast("long")
    extra = F.when(F.col("edge").isNull() | (F.col("size") == 0), 0).when(F.col("h") < F.col("edge"), F.col("size")).when(F.col("h") == F.col("edge"), at_edge).otherwise(0)
    once_more = F.col("edge").isNotNull() & ((F.col("h") < F.col("edge")) | ((F.col("h") == F.col("edge")) & (share >= 0.5)))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    joined = joined.withColumn("taken", (F.col("whole") * F.col("size") + extra).cast("long"))
    return joined.withColumn("copies", (F.col("whole") + once_more.cast("int")).cast("int")).drop("of", "edge_of", "edge", "edge_size", "rest", "whole")
