"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungauge.shared import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours linked to its least neighbour: those above it (large) or those below it and itself (small)."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node of its component) of all ends of ``links`` (a, b).

    Each round makes every component flatter; it ends when all edges lead to a
    node that leads nowhere.  Minima are merged before the shuffle, and a node
    with very many neighbours meets them in a plain join, which can be split.
    """
    edges = cut_lineage(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        roots = edges.select(F.col("u").alias("v"))
        several = edges.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        if edges.join(roots, "v", "left_semi").isEmpty() and several.isEmpty():
            break
        edges = cut_lineage(_star(_star(edges, large=True), large=False), "edges")
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
