"""Queries on sequences: repeated words of a text, turns of conversations, records of archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungauge.functions.ordered import Scan
from rungauge.llm import periodic_runs, prefix_trie, warc
from rungauge.llm.registry import query
from rungauge.session import table
from rungauge.shared import fresh_folder

# crc32 of the decimal digits of {0}, unsigned, as DuckDB has no such function.
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast({0} as varchar), ''), lambda ch: ascii(ch)::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

RUNS_SQL = rf"""
with docs as (
  select row_number() over () as row, doc_id, {CRC_SQL.format("doc_id")} as h,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words
  from documents),
placed as (select *, len(words) as n, (h // 10) % greatest(len(words), 1) as a from docs),
turned as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from placed),
texts as (
  select row, doc_id, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: words[1 + case when i < a then i else a + (i - a) % p end]) else words end as words
  from turned),
grams as (select row, i, array_to_string(words[i + 1 : i + 6], ' ') as gram from (select row, words, unnest(range(0, len(words) - 5)) as i from texts)),
pairs as (select x.row, x.i, y.i - x.i as q from grams x join grams y on x.row = y.row and x.gram = y.gram and x.i < y.i),
islands as (
  select row, q, min(i) as start, count(*) + 5 as depth
  from (select row, q, i, i - row_number() over (partition by row, q order by i) as island from pairs) group by row, q, island),
runs as (
  select row, start, depth + q as length, min(q) as period
  from islands where depth >= q and depth + q >= 12 group by row, start, depth + q),
longest as (select row, arg_min((start, length, period), (-length, start, period)) as r from runs group by row),
named as (select row, count(*) as n_runs, sha256(string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period)) as runs_sha256 from runs group by row),
gone as (select distinct row, unnest(range(start + period, start + length)) as i from runs),
kept as (
  select row, sha256(string_agg(word, ' ' order by i)) as collapsed_sha256
  from (select row, unnest(range(len(words))) as i, unnest(words) as word from texts) anti join gone using (row, i) group by row)
select doc_id, coalesce(n_runs, 0) as n_runs, r[1] as start, r[2] as length, r[3] as period, 1000 * r[2] // r[3] as exponent_milli,
       coalesce(runs_sha256, sha256('')) as runs_sha256, coalesce(collapsed_sha256, sha256('')) as collapsed_sha256
from texts left join longest using (row) left join named using (row) left join kept using (row)
"""


def _crc(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary"))


def _turned(docs: DataFrame) -> DataFrame:
    """The texts of the contract: in a tenth of them all words from one on repeat with a period."""
    h = _crc(F.col("doc_id"))
    words = F.regexp_extract_all("text", F.lit(prefix_trie.SPACED), F.lit(0))
    docs = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    docs = docs.withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    turned = F.transform("words", lambda word, i: F.when(i < F.col("a"), word).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_find_runs", RUNS_SQL)
def find_runs(spark: SparkSession, root: str) -> DataFrame:
    """Periodic runs of words in each document, and its text without their repeats."""
    found = periodic_runs.without_runs(_turned(table(spark, root, "documents").select("doc_id", "text")))
    longest = F.reduce(
        "runs", F.get("runs", F.lit(0)), lambda best, run: F.when(run["length"] > best["length"], run).otherwise(best)
    )  # runs come by start and period, so the first of the longest stays
    line = lambda r: F.concat_ws(",", *[r[f].cast("string") for f in periodic_runs.FIELDS])
    written = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    found = found.withColumns({"longest": longest, "runs_sha256": F.sha2(written, 256), "collapsed_sha256": F.sha2("collapsed", 256)})
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"longest.{f}").alias(f) for f in periodic_runs.FIELDS],
        F.expr("(1000 * longest.length) div longest.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


TRIE_SQL = rf"""
with turns as (
  select conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as digest,
         len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) as tokens
  from conversations where conv_id is not null),
own as (select *, row_number() over (partition by conv_id order by turn nulls first, digest) as place from turns),
convs as (select conv_id, {CRC_SQL.format("conv_id")} % 4 as h, conv_id - conv_id % 20 as base from (select distinct conv_id from turns)),
rebuilt as (
  select c.conv_id, 0 as part, place, digest, tokens from convs c join own o on o.conv_id = c.base and place <= h
  union all select conv_id, 1, place, digest, tokens from own join convs using (conv_id) where place > h),
paths as (
  select conv_id, row_number() over w as depth, md5(string_agg(digest, '') over w) as sig, tokens
  from rebuilt window w as (partition by conv_id order by part, place rows between unbounded preceding and current row)
  union all select conv_id, 0, '', 0 from convs),
named as (select *, lag(sig) over (partition by conv_id order by depth) as parent_sig, max(depth) over (partition by conv_id) as ending from paths),
nodes as (
  select depth, sig, min(conv_id) as conv_id, count(*) as n_convs, any_value(parent_sig) as parent_sig, any_value(tokens) as tokens,
         string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ending = depth) as ends
  from named group by 1, 2),
children as (select depth - 1 as depth, parent_sig as sig, count(*) as n_children from nodes where depth > 0 group by 1, 2),
full_nodes as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (depth, sig)),
above as (
  select a.depth, a.sig, sum((u.n_children = 0)::int) as n_leaves, sum((u.n_convs - 1) * u.tokens) as saved_tokens
  from full_nodes u join paths a on a.conv_id = u.conv_id and a.depth <= u.depth group by 1, 2)
select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, cast(n_leaves as bigint) as n_leaves,
       cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(v.ends, '')) as ends_sha256
from full_nodes v join above using (depth, sig) left join nodes p on p.depth = v.depth - 1 and p.sig = v.parent_sig
"""

HEADS = 3  # at most so many turns come from the other conversation


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations in the order of part and place, and all conversation ids."""
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", prefix_trie.turn_digest(F.col("role"), F.col("text")).alias("digest"), prefix_trie.words_of(F.col("text")).alias("tokens"))
    own = Scan(turns, ["conv_id"], ["turn", "digest"]).add(place=("sum", F.lit(1))).rows().withColumn("h", _crc(F.col("conv_id")) % 4)
    convs = own.filter("place = 1").select("conv_id", "h")
    heads = own.filter((F.col("conv_id") % 20 == 0) & (F.col("place") <= HEADS)).select(F.col("conv_id").alias("base"), "place", "digest", "tokens")
    heads = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "base").filter("place <= h")
    columns = ["conv_id", "part", "place", "digest", "tokens"]
    return heads.withColumn("part", F.lit(0)).select(columns).unionByName(own.filter("place > h").withColumn("part", F.lit(1)).select(columns)), convs


@query("op12_prefix_trie", TRIE_SQL)
def conversation_trie(spark: SparkSession, root: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    turns, convs = _rebuilt(table(spark, root, "conversations"))
    return prefix_trie.trie(turns, convs, ["part", "place"])


WARC_SQL = f"""
with sized as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as bytes from pages),
ranked as (
  select *, row_number() over (partition by html order by page_id desc nulls last) as place, max(page_id) over (partition by html) as newest from sized)
select page_id, bytes as payload_bytes, sha1(html) as payload_digest, case when place > 1 and bytes >= {warc.SHORTEST} then 'revisit' else 'response' end as record_type,
       case when place > 1 and bytes >= {warc.SHORTEST} then newest end as refers_to
from ranked
"""


@query("op13_write_archives", WARC_SQL)
def write_archives(spark: SparkSession, root: str) -> DataFrame:
    """Pages written to archives, equal payloads once, and what the archives give back."""
    pages = table(spark, root, "pages")
    folder = fresh_folder(spark, "archives")
    index = warc.write_archives(warc.planned(pages, "page_id", "url", "html"), folder)
    number = lambda c: F.col(c).cast(pages.schema["page_id"].dataType).alias("page_id" if c == "key" else c)
    return warc.resolved(index, folder).select(number("key"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))
