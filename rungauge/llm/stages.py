"""The stages of the corpus pipeline: documents in, kept documents out, columns as they came.

Each stage packs the documents' columns into one, so that none of its own can
clash with them, and decides on narrow rows.  A decision finds its documents by
``k``, a hash of id and text: rows equal in both are decided alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungauge.llm import bagminhash, decontamination, mixing, sharding, toxicity
from rungauge.session import table
from rungauge.shared import cut_lineage, sent_if_small


def _packed(docs: DataFrame, **more: Column) -> DataFrame:
    k = F.xxhash64("doc_id", "text").alias("k")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", k, *[c.alias(n) for n, c in more.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject; learned from the labels of those that are here."""
    model = toxicity.fitted(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.scored_rows(docs, model).filter(F.col("score") < toxicity.REJECT).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies; rows equal in id and text are one document."""
    packed = _packed(docs)
    classes = cut_lineage(bagminhash.near_duplicates(packed.select("k", "text"), key="k"), "classes")
    kept = classes.filter(F.col("k") == F.col("class_id")).groupBy("k").agg(F.count("*").alias("n"))
    kept = cut_lineage(kept, "kept")
    single = packed.join(sent_if_small(kept.filter("n = 1").select("k")), "k", "left_semi").select("row.*")
    several = kept.filter("n > 1").select("k")
    if several.isEmpty():
        return single
    return single.unionByName(packed.join(several, "k", "left_semi").dropDuplicates(["k"]).select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    packed = _packed(docs)
    found = decontamination.decontaminated(packed.select("k", "text"), table(spark, sf_dir, "benchmark"), key="k")
    bad = cut_lineage(found.filter("contaminated").select("k").distinct(), "contaminated")
    return packed.join(sent_if_small(bad), "k", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; documents that it leaves out go."""
    h = mixing.hash_of(F.col("doc_id"), F.col("text"))
    rows = cut_lineage(docs.select("source", mixing.size_of(F.col("text")).alias("size"), h.alias("h")), "mix-sizes")
    plan = mixing.mixed(rows).filter(F.col("copies") > 0).select(F.col("h").alias("plan_h"), F.col("source").alias("plan_source"), "copies").distinct()
    packed = _packed(docs, h=h, source=F.col("source"))
    plan = sent_if_small(cut_lineage(plan, "mix-plan"))
    joined = packed.join(plan, (F.col("h") == F.col("plan_h")) & F.col("source").eqNullSafe(F.col("plan_source")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their position, shard and slot in 24 shards."""
    keyed = docs.withColumns({"_crc": F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8"))})
    return sharding.sharded(keyed, ["doc_id", "_crc"], shards=24, seed=10).drop("_crc")
