"""The operators on the driver tables: thin queries with the columns of their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungauge.llm import bagminhash, decontamination, lm_scoring, mixing, pii, secret_scan, sharding, topk, toxicity, url_rules
from rungauge.llm.registry import query
from rungauge.llm.folds import held_out
from rungauge.llm import sequence_queries  # noqa: F401  (registers its queries)
from rungauge.session import table
from rungauge.shared import cut_lineage

MIX_SQL = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15) as bigint) as h
  from documents),
sources as (select source, cast(sum(size) as bigint) as source_size from sized group by 1),
weighed as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5e0 when 1 then 2e0 else 1e0 end as weight,
         3e0 * source_size as cap
  from sources),
summed as (
  select *, cap / weight as ratio,
         cast(sum(source_size) over () as double) - coalesce(sum(cap) over before, 0e0) as room,
         sum(weight) over () - coalesce(sum(weight) over before, 0e0) as weights
  from weighed window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
level as (select room / weights as level from summed where room < ratio * weights order by ratio limit 1),
goals as (
  select source, source_size, coalesce(least(cap, (select level from level) * weight), 0e0) as target from summed),
budgets as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from goals),
cells as (
  select source, h, sum(size) as total from sized group by 1, 2),
running as (
  select *, sum(total) over (partition by source order by h rows between unbounded preceding and current row) as upto from cells),
shares as (
  select r.source, r.h, b.source_size, b.target, b.whole,
         case when r.upto <= b.target - b.whole * b.source_size then 1e0
              when r.upto - r.total > b.target - b.whole * b.source_size or r.total = 0 then 0e0
              else (b.target - b.whole * b.source_size - (r.upto - r.total)) / r.total end as share
  from running r join budgets b on r.source is not distinct from b.source)
select d.doc_id, d.size, s.source_size, s.target, cast(s.whole * d.size + floor(d.size * s.share) as bigint) as taken
from sized d join shares s on d.h = s.h and d.source is not distinct from s.source
"""


@query("op2_mix_sources", MIX_SQL)
def mix_sources(spark: SparkSession, root: str) -> DataFrame:
    """Words the mix takes of each document."""
    docs = table(spark, root, "documents").select(
        "doc_id", "source", mixing.size_of(F.col("text")).alias("size"), mixing.hash_of(F.col("doc_id"), F.col("text")).alias("h")
    )
    return mixing.mixed(cut_lineage(docs, "mix-sizes")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_shard_rows")
def shard_rows(spark: SparkSession, root: str) -> DataFrame:
    """Shard and slot of each document; counts of shards differ by one at most."""
    docs = sharding.measured(table(spark, root, "documents").select("doc_id", "text")).drop("text")
    return sharding.sharded(docs, ["doc_id", "text_crc32", "size"], shards=24, seed=10).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


DECONTAMINATION_SQL = r"""
with docs as (
  select row_number() over () as row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark),
windows as (
  select distinct item_id, least(len(words), 10) as width, words[i : i + 9] as win
  from (select item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i from items where len(words) > 0)),
spots as (
  select row, words, width, unnest(range(1, len(words) - width + 2)) as i
  from docs, (select distinct width from windows) where len(words) >= width),
found as (
  select s.row, s.i, s.width, w.item_id from spots s join windows w on w.width = s.width and w.win = s.words[s.i : s.i + s.width - 1]),
hits as (select row, count(distinct p) as n_hit from (select row, unnest(range(i, i + width)) as p from found) group by 1),
named as (select row, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct row, cast(item_id as varchar) as id from found) group by 1)
select d.doc_id, cast(len(d.words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join hits using (row) left join named using (row)
"""


@query("op6_decontaminate", DECONTAMINATION_SQL)
def decontaminate(spark: SparkSession, root: str) -> DataFrame:
    """Words of each document that lie in a ten-word window of a benchmark item."""
    found = decontamination.decontaminated(table(spark, root, "documents"), table(spark, root, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "contaminated"
    )


@query("op7_near_duplicates")
def near_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """Class of near-copies of each document."""
    return bagminhash.near_duplicates(table(spark, root, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


@query("op3_scan_secrets")
def scan_secrets(spark: SparkSession, root: str) -> DataFrame:
    """Known secret shapes and random strings in each document."""
    found = secret_scan.scanned(table(spark, root, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s.kind != "random")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in secret_scan.KINDS], F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("secrets")).alias("spans")
    )


@query("op5_find_personal_data")
def find_personal_data(spark: SparkSession, root: str) -> DataFrame:
    """Personal data in each document, by kind and place."""
    found = pii.detected(table(spark, root, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.BASE + pii.ADDED], F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans")
    )


TOP_K_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.e, v.e) as bigint) as score
  from v q join v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id),
ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""


@query("op8_top_k", TOP_K_SQL)
def top_k(spark: SparkSession, root: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector."""
    return topk.top_k(topk.quantised(table(spark, root, "embeddings")))


@query("op4_filter_urls")
def filter_urls(spark: SparkSession, root: str) -> DataFrame:
    """Verdict on each page's url by fixed and mined rules."""
    return url_rules.judged(table(spark, root, "pages").select("page_id", "url")).drop("url")


@query("op1_score_toxicity")
def score_toxicity(spark: SparkSession, root: str) -> DataFrame:
    """Toxicity of each document by matched clauses."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    model = toxicity.fitted(docs, table(spark, root, "labels"))
    found = toxicity.scored(docs, model).drop("text")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"), "clauses")


@query("op9_score_language")
def score_language(spark: SparkSession, root: str) -> DataFrame:
    """Cross-entropy difference of each document: texts labelled good against all others."""
    labels = table(spark, root, "labels").filter("quality is not null")
    return lm_scoring.scored(table(spark, root, "documents"), labels.filter("quality = 1").select("doc_id"), labelled=labels).withColumn("held_out", held_out(F.col("doc_id")))
