"""Curation, join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungauge.functions import times
from rungauge.functions.text import BLANK
from rungauge.operators import curation as cu
from rungauge.operators import joins as jn
from rungauge.plans.registry import query
from rungauge.session import spread_table, table
from rungauge.sources import sinks

# The same white space class in the oracle's regular expressions.
def one_blank(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '[{BLANK}]+', ' ', 'g'), '^ | $', '', 'g')"


@query("s02_work_list", """
with p as (select p_partkey, p_brand, p_size, row_number() over (order by p_brand, p_size, p_partkey) - 1 as place from part)
select p_partkey, p_brand, p_size, place from p where place % 4 = 1
  and p_partkey not in (select l_partkey from lineitem where l_quantity = 50)
""")
def _(spark, root):
    done = table(spark, root, "lineitem").where("l_quantity = 50").select("l_partkey")
    tasks = table(spark, root, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    out = cu.work_list(
        tasks, "p_partkey", "p_brand", "p_size", ["p_name"], done=done, shards=4, shard=1,
    )
    return out.select("p_partkey", "p_brand", "p_size", "place")


@query("s15_manifest", """
with r as (select lang, sha256(concat_ws(chr(31), doc_id::varchar, text, source, n_chars::varchar)) as d from documents),
     w as (select lang, count(*) as n_rows, """ + ", ".join(
    f"sum(('0x' || substr(d, {1 + 8 * i}, 8))::bigint) as w{i}" for i in range(8)
) + """ from r group by 1)
select lang, n_rows, sha256(concat_ws('-', """ + ", ".join(f"w{i}::varchar" for i in range(8)) + """)) as digest,
       'critic-train-derived-v1' as protocol from w
""")
def _(spark, root):
    docs = spread_table(spark, root, "documents", "doc_id")
    return sinks.manifest(docs, "critic-train-derived-v1", ["lang"], ["doc_id", "text", "source", "n_chars"])


@query("s17_resume_ledger", """
select doc_id from documents where doc_id not in (select doc_id from labels)
""")
def _(spark, root):
    return sinks.not_done(table(spark, root, "documents").select("doc_id"), table(spark, root, "labels"), "doc_id")


RATES = """
select l_partkey as task, avg(case when l_returnflag = 'R' then 1.0 else 0.0 end) as pass_rate, count(*) as n
from lineitem group by 1
"""


def rates(spark, root):
    attempts = table(spark, root, "lineitem").select(
        F.col("l_partkey").alias("task"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward")
    )
    return cu.pass_rates(attempts, "task", "reward")


@query("f05_pass_band", f"""
select task, round(pass_rate, 6) as pass_rate, n, p_name from ({RATES}) join part on p_partkey = task
where pass_rate > 0 and pass_rate < 1
""")
def _(spark, root):
    tasks = table(spark, root, "part").select("p_partkey", "p_name")
    kept, _ = cu.screen_tasks(rates(spark, root), tasks, "task", "p_partkey")
    return kept.select("task", F.round("pass_rate", 6).alias("pass_rate"), "n", "p_name")


@query("f05_band_counts", f"""
select case when p_partkey is null then 'unmatched' when pass_rate = 0 then 'never' when pass_rate = 1 then 'always'
       else 'between' end as band, count(*) as n_tasks
from ({RATES}) left join (select case when p_size < 40 then p_partkey else -p_partkey end as p_partkey from part) on p_partkey = task group by 1
""")
def _(spark, root):
    # Large parts have another key in the task table, so their rates have no task.
    key = F.when(F.col("p_size") < 40, F.col("p_partkey")).otherwise(-F.col("p_partkey")).alias("p_partkey")
    tasks = table(spark, root, "part").select(key, "p_name")
    return cu.screen_tasks(rates(spark, root), tasks, "task", "p_partkey")[1]


# Wanted and guard tests per document: file names by source, test names by id.
GUARDS = """
select doc_id, [source || '.py::t' || (doc_id % 5)::varchar, 'src1.py::t0'] as f2p,
       case when doc_id % 7 = 0 then [] else ['src' || (doc_id % 20)::varchar || '.py::g', source || '.pyx::g', 'lib.py::g'] end as p2p
from documents
"""


def guards(spark, root):
    i = F.col("doc_id")
    f2p = F.array(F.concat("source", F.lit(".py::t"), (i % 5).cast("string")), F.lit("src1.py::t0"))
    p2p = F.array(
        F.concat(F.lit("src"), (i % 20).cast("string"), F.lit(".py::g")), F.concat("source", F.lit(".pyx::g")), F.lit("lib.py::g")
    )
    empty = F.array().cast("array<string>")
    return table(spark, root, "documents").select(
        "doc_id", f2p.alias("f2p"), F.when(i % 7 == 0, empty).otherwise(p2p).alias("p2p")
    )


@query("f06_guard_rails", f"""
with g as ({GUARDS}), k as (select doc_id,
  list_filter(p2p, lambda t: list_bool_or(list_transform(f2p, lambda f: starts_with(t, string_split(f, '::')[1])))) as prefix_kept,
  list_filter(p2p, lambda t: list_contains(list_transform(f2p, lambda f: string_split(f, '::')[1]), string_split(t, '::')[1])) as exact_kept
  from g)
select doc_id, array_to_string(prefix_kept, ' ') as prefix_kept, array_to_string(exact_kept, ' ') as exact_kept,
       case when len(prefix_kept) = 0 then 'no_guard' else 'kept' end as outcome from k
""")
def _(spark, root):
    prefix = cu.kept_guards(F.col("f2p"), F.col("p2p"))
    exact = cu.kept_guards(F.col("f2p"), F.col("p2p"), "exact")
    return guards(spark, root).select(
        "doc_id",
        F.array_join(prefix, " ").alias("prefix_kept"),
        F.array_join(exact, " ").alias("exact_kept"),
        cu.guard_outcome(F.col("f2p"), prefix).alias("outcome"),
    )


@query("f20_purity", f"""
with t as (select {one_blank('text')} as k, text from documents), h as (select distinct text as k from benchmark)
select count(*) as n_rows, 0::bigint as n_missing_ids, count_if(length({one_blank('text')}) = 0) as n_missing_texts,
       count_if(k in (select k from h)) as n_held_out,
       (select count(*) from (select k from t group by 1 having count(*) > 1)) as n_repeated_ids,
       count_if(length({one_blank('text')}) = 0) + count_if(k in (select k from h))
         + (select count(*) from (select k from t group by 1 having count(*) > 1)) = 0 as clean from t
""")
def _(spark, root):
    from rungauge.functions.text import one_blank as blanks

    train = spread_table(spark, root, "documents", "doc_id").select(blanks(F.col("text")).alias("id"), "text")
    return cu.purity(train, table(spark, root, "benchmark"), "id", "text", "text")


@query("a21_image_plan", """
with i as (select p_brand as image, count(*) as n_tasks from part group by 1),
     o as (select *, row_number() over (order by n_tasks desc, image) as place from i),
     q as (select *, (place - 1) // 8 + 1 as batch from o)
select image, n_tasks, place, batch, count(*) over (partition by batch) as batch_images,
       cast(sum(n_tasks) over (partition by batch) as bigint) as batch_tasks from q
""")
def _(spark, root):
    return cu.image_plan(table(spark, root, "part").select(F.col("p_brand").alias("image")), "image", 8)


@query("l04_top_images", """
select p_brand, p_type, count(*) as n from part group by 1, 2 order by n desc, p_brand, p_type limit 20
""")
def _(spark, root):
    counts = table(spark, root, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "p_brand", "p_type").limit(20)


@query("l01_held_out_split", """
with p as (select doc_id, sha256('20260920' || doc_id::varchar) as h from documents),
     v as (select doc_id from p order by h limit 30)
select doc_id, source, case when doc_id in (select doc_id from v) then 'val' else 'train' end as split from documents
""")
def _(spark, root):
    rows = table(spark, root, "documents").select("doc_id", "source")
    return cu.held_out_split(rows, "doc_id", "20260920", 30)


# The oracle takes the digest modulo 10 by Horner's rule.
@query("l02_bucket_split", f"""
with t as (select doc_id, sha256({one_blank('text')}) as text_group from documents),
     h as (select *, sha256('critic-v1:' || text_group) as d from t),
     u as (select *, list_reduce(list_transform(range(1, 65), lambda i: ('0x' || substr(d, i, 1))::bigint),
                                 lambda a, x: (a * 16 + x) % 10) as bucket from h)
select doc_id, text_group, bucket, case when bucket = 0 then 'validation' else 'train' end as split from u
""")
def _(spark, root):
    out = cu.bucket_split(spread_table(spark, root, "documents", "doc_id").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "text_group", F.col("bucket").cast("long").alias("bucket"), "split")


@query("l03_hash_sample", """
select doc_id, lang from documents order by sha256('value-eval' || doc_id::varchar), doc_id limit 64
""")
def _(spark, root):
    return cu.hash_sample(table(spark, root, "documents").select("doc_id", "lang"), "doc_id", "value-eval", 64)


@query("l05_latest", """
select event_id, user_id, event_type from events order by ts desc, event_id desc limit 400
""")
def _(spark, root):
    newest = table(spark, root, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(400)
    return newest.select("event_id", "user_id", "event_type")


@query("t12_duplicate_groups", f"""
select sha256({one_blank('text')}) as text_group, count(*) as n_copies, min(doc_id) as representative from documents group by 1
""")
def _(spark, root):
    return cu.duplicate_groups(spread_table(spark, root, "documents", "doc_id"), "doc_id", "text")


@query("t11_prompt_key_groups", """
with k as (select doc_id, case when doc_id % 3 = 0 then '  "' || replace(text, '"', '\\"') || '" ' else text end as p from documents),
     s as (select doc_id, regexp_replace(regexp_replace(p, '^[""" + BLANK + """]+', ''), '[""" + BLANK + """]+$', '') as p from k),
     u as (select doc_id, case when length(p) >= 2 and starts_with(p, '"') and ends_with(p, '"')
                               then replace(substr(p, 2, length(p) - 2), '\\"', '"') else p end as p from s)
select md5(regexp_replace(regexp_replace(p, '^[""" + BLANK + """]+', ''), '[""" + BLANK + """]+$', '')) as prompt_key,
       count(*) as n_traces, min(doc_id) as first_id from u group by 1
""")
def _(spark, root):
    from rungauge.functions.text import prompt_key

    quoted = F.concat(F.lit('  "'), F.replace("text", F.lit('"'), F.lit('\\"')), F.lit('" '))
    prompt = F.when(F.col("doc_id") % 3 == 0, quoted).otherwise(F.col("text"))
    return spread_table(spark, root, "documents", "doc_id").groupBy(prompt_key(prompt).alias("prompt_key")).agg(
        F.count("*").alias("n_traces"), F.min("doc_id").alias("first_id")
    )


@query("j01_results_tasks_status", """
select o_orderkey as id, c_mktsegment as repo, n_turns, n_turns is not null as has_status
from orders join customer on c_custkey = o_custkey
left join (select l_orderkey, count(*) as n_turns from lineitem where l_linestatus = 'F' group by 1) on l_orderkey = o_orderkey
""")
def _(spark, root):
    results = table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    tasks = table(spark, root, "customer").select("c_custkey", "c_mktsegment")
    # Many results share a task here, so the task is matched on its own key first.
    joined = results.join(tasks, F.col("o_custkey") == F.col("c_custkey"))
    status = table(spark, root, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count("*").alias("n_turns")
    )
    out = jn.results_with_tasks(joined, joined.select("id"), status, "id")
    return out.select("id", F.col("c_mktsegment").alias("repo"), "n_turns", "has_status")


USER_TURNS = "select conv_id, turn, text from conversations where role = 'user'"


def user_turns(spark, root):
    return table(spark, root, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


def captured_turns(users):
    """The same turns as a log writes them: quoted."""
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('\\"')), F.lit('"'))
    return users.select("conv_id", "turn", quoted.alias("captured"))


@query("j02_prompt_hash", f"""
with c as ({USER_TURNS}), k as (select text, count(*) as n, min((conv_id, turn)) as f from c where text is not null group by 1)
select c.conv_id, c.turn, p.conv_id as other_conv, p.turn as other_turn, coalesce(n, 0) as n_matches, f[1] as first_conv, f[2] as first_turn
from c left join k on k.text = c.text left join c p on p.text = c.text
""")
def _(spark, root):
    users = user_turns(spark, root)
    captured = captured_turns(users)
    found = jn.prompt_matches(users, "text", captured, "captured", ["conv_id", "turn"])
    others = captured.withColumnsRenamed({"conv_id": "other_conv", "turn": "other_turn"})
    out = jn.by_prompt_hash(found, "text", others, "captured", "left")
    return out.select(
        "conv_id", "turn", "other_conv", "other_turn",
        "n_matches", F.col("first_match.conv_id").alias("first_conv"), F.col("first_match.turn").alias("first_turn"),
    )


@query("j02_prompt_members", f"""
with c as ({USER_TURNS} and text is not null), s as (select *, regexp_replace(regexp_replace(text, '^[{BLANK}]+', ''), '[{BLANK}]+$', '') as p from c)
select conv_id, turn, md5(p) as prompt_key from s
""")
def _(spark, root):
    return jn.prompt_members(captured_turns(user_turns(spark, root)), "captured", ["conv_id", "turn"])


@query("j03_statement_match", f"""
with k as (select distinct {one_blank('text')} as k from (select case when doc_id % 10 = 3 then text || ' changed' else text end as text from documents)),
     a as (select distinct {one_blank('text')} as a from documents)
select count(*) as n_asked, count(k) as n_matched, round(count(k) / count(*), 6) as match_rate,
       count(k) / count(*) >= 0.9 as enough from a left join k on k = a
""")
def _(spark, root):
    from rungauge.functions.text import one_blank as blanks

    docs = spread_table(spark, root, "documents", "doc_id")
    prompt = F.concat(
        F.lit("Consider the following PR description:\n"), "text", F.lit("\n</pr_description>"), "source"
    )
    asked = docs.select(blanks(cu.statement_of_prompt(prompt)).alias("statement"))
    changed = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    known = docs.select(blanks(changed).alias("statement"))
    out = jn.match_report(asked, "statement", known, "statement")
    return out.withColumn("match_rate", F.round("match_rate", 6))


@query("j04_id_lists", """
select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)
  and doc_id not in (select doc_id from labels where toxic = 1)
""")
def _(spark, root):
    labels = table(spark, root, "labels")
    docs = table(spark, root, "documents").select("doc_id", "lang")
    wanted = jn.keep_listed(docs, labels.where("quality = 1"), "doc_id", "doc_id")
    return jn.drop_listed(wanted, labels.where("toxic = 1"), "doc_id", "doc_id")


@query("j06_id_sets", """
select count(l.doc_id) as n_common, count_if(l.doc_id is null) as n_only_a, 0::bigint as n_only_b,
       count_if(l.doc_id is null) = 0 as equal
from documents d left join labels l on l.doc_id = d.doc_id
""")
def _(spark, root):
    return jn.id_sets(table(spark, root, "documents"), table(spark, root, "labels"), "doc_id")


@query("j07_rollout_log", """
select o_orderkey as rollout_id, l_shipdate::varchar as last_ship, n from orders join
 (select l_orderkey, max(l_shipdate) as l_shipdate, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey
""")
def _(spark, root):
    # The id is read out of the log's file name.
    logs = table(spark, root, "lineitem").select(
        F.concat(F.lit("rollout-"), F.col("l_orderkey").cast("string"), F.lit(".log")).alias("file"), "l_shipdate"
    )
    per = logs.withColumn("id", F.regexp_extract("file", r"^rollout-(\d+)\.log$", 1).cast("long")).groupBy("id").agg(
        F.max("l_shipdate").alias("last"), F.count("*").alias("n")
    )
    orders = table(spark, root, "orders").select(F.col("o_orderkey").alias("rollout_id"))
    return orders.join(per, F.col("rollout_id") == F.col("id")).select(
        "rollout_id", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_ship"), "n"
    )


@query("j08_interval_counts", """
with i as (select event_id as id, user_id as k, epoch_us(ts) / 1000000.0 as t0, epoch_us(ts) / 1000000.0 + value * 1000 as t1
           from events where event_type = 'signup'),
     e as (select user_id as k, epoch_us(ts) / 1000000.0 as at from events where event_type <> 'signup')
select id, count(e.k) as n_events from i left join e on e.k = i.k and e."at" between t0 - 1 and t1 + 1 group by 1
""")
def _(spark, root):
    events = table(spark, root, "events")
    at = times.epoch_micros(F.col("ts")) / 1000000.0
    runs = events.where("event_type = 'signup'").select(
        F.col("event_id").alias("id"), "user_id", at.alias("t0"), (at + F.col("value") * 1000).alias("t1")
    )
    seen = events.where("event_type <> 'signup'").select("user_id", at.alias("at"))
    out = jn.interval_counts(runs, seen, "id", "user_id", "t0", "t1", "user_id", "at", slack=1.0)
    return out.select("id", "n_events")


@query("j09_provenance", """
select case when doc_id % 11 = 0 then 'no_parent' when doc_id % 13 = 0 then 'differs' else 'same' end as state, count(*) as n
from documents group by 1
""")
def _(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    child = docs.withColumn("source", F.lit("elsewhere")).withColumn(
        "lang", F.when(i % 13 == 0, F.lit("xx")).otherwise(F.col("lang"))
    )
    parents = docs.withColumn("doc_id", F.when(i % 11 == 0, -1 - i).otherwise(i))
    return cu.provenance(child, parents, "doc_id", "source")


FIRST_WORD = "regexp_extract(text, '^[" + BLANK + "]*([^" + BLANK + "]+)', 1)"


@query("j10_node_resolution", f"""
with c as (select distinct text as f from documents), w as (select f, {FIRST_WORD.replace('text', 'f')} as w from c),
     q as (select w, count(*) as n, min(f) as one from w group by 1),
     a as (select distinct {FIRST_WORD} as node from benchmark union select distinct case when doc_id % 3 = 0 then text else {FIRST_WORD} end from documents),
     r as (select node, coalesce(f, case when n = 1 then one end) as f, case when f is not null then 'exact' when n is null
           then 'unavailable' when n > 1 then 'ambiguous' else 'truncated' end as s
           from a left join c on c.f = a.node left join q on q.w = a.node),
     u as (select f from r where f is not null group by 1 having count(*) > 1)
select node, f as "full", case when f in (select f from u) then 'shared' else s end as state from r
""")
def _(spark, root):
    docs, bench = spread_table(spark, root, "documents", "doc_id"), table(spark, root, "benchmark")
    first = F.regexp_extract("text", f"^[{BLANK}]*([^{BLANK}]+)", 1)
    asked = bench.select(first.alias("node")).unionByName(
        docs.select(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(first).alias("node"))
    )
    return jn.resolve_nodes(asked, docs, "node", "text")


@query("j11_unique_names", """
with k as (select p_name || case when p_size > 10 then '' else '?' end as p_name, min(p_brand) as lo, max(p_brand) as hi, min(p_type) as s from part group by 1)
select p_name, case when lo is null then 'MISSING' when lo <> hi then 'ambiguous' else s end as status
from (select distinct p_name || case when p_partkey % 4 = 0 then '!' else '' end as p_name from part) left join k using (p_name)
""")
def _(spark, root):
    part = table(spark, root, "part")
    asked = part.select(
        F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, "!").otherwise("")).alias("p_name")
    )
    known = part.withColumn("p_name", F.concat("p_name", F.when(F.col("p_size") > 10, "").otherwise("?")))
    return jn.unique_names(asked, known, "p_name", "p_brand", "p_type")


TENSORS = """
select label, vec_id * 64 + i as pos, embedding[i + 1]::double as v, vec_id from embeddings, range(0, 64) t(i)
"""
DRIFT = f"""
select coalesce(n.name, o.name) as name, sqrt(sum((n.v - o.v) * (n.v - o.v))) as change, sqrt(sum(case when n.v is not null then o.v * o.v end)) as norm,
       count_if(n.v is null or o.v is null) as n_unmatched
from (select 'layer' || label || case when label % 5 = 0 then '.norm' when label = 3 then '.new' else '' end as name, pos, v + 0.01 * (pos % 3) as v from ({TENSORS})) n
full join (select 'layer' || label || case when label % 5 = 0 then '.norm' else '' end as name, case when label = 7 and vec_id % 2 <> 0 then -1 - pos else pos end as pos, v from ({TENSORS})) o
  on n.name = o.name and n.pos = o.pos group by 1
"""


def tensors(spark, root):
    """Embeddings as two parameter tables; one tensor has another name on one side, one has other positions."""
    rows = table(spark, root, "embeddings").where(F.size("embedding") > 0).select(
        "label", "vec_id", F.concat(F.lit("layer"), F.col("label").cast("string"), F.when(F.col("label") % 5 == 0, ".norm").otherwise("")).alias("name"),
        (F.col("vec_id") * 64).alias("start"), F.transform("embedding", lambda x: x.cast("double")).alias("v"),
    )
    renamed = F.when(F.col("label") == 3, F.concat("name", F.lit(".new"))).otherwise(F.col("name")).alias("name")
    moved = (F.col("label") == 7) & (F.col("vec_id") % 2 != 0)  # positions -1 - p, so the piece lies backwards
    new = rows.select(renamed, "start", F.transform("v", lambda x, i: x + 0.01 * ((F.col("start") + i) % 3)).alias("v"))
    old = rows.select("name", F.when(moved, -F.col("start") - F.size("v")).otherwise(F.col("start")).alias("start"), F.when(moved, F.reverse("v")).otherwise(F.col("v")).alias("v"))
    return jn.weight_drift(jn.tensor_blocks(new, "name", "start", "v"), jn.tensor_blocks(old, "name", "start", "v"))


@query("j12_tensor_join", f"""
select name, cast(sum(case when change is null then 0 else 1 end) as bigint) as compared, max(n_unmatched) as n_unmatched
from ({DRIFT}) group by 1
""")
def _(spark, root):
    per = tensors(spark, root)
    return per.select("name", F.col("change").isNotNull().cast("long").alias("compared"), "n_unmatched")


@query("a28_weight_drift", f"""
select name, round(change, 6) as change, round(norm, 6) as norm, round(change / norm, 6) as relative from ({DRIFT})
where n_unmatched = 0 order by change / norm desc, name limit 10
""")
def _(spark, root):
    per = tensors(spark, root).where("n_unmatched = 0")
    top = per.orderBy(F.desc("relative"), "name").limit(10)
    return top.select("name", *[F.round(c, 6).alias(c) for c in ("change", "norm", "relative")])


@query("a28_drift_summary", f"""
select count_if(n_unmatched = 0) as n_tensors, count_if(n_unmatched > 0) as n_unmatched,
       round(sqrt(sum(change * change) filter (where n_unmatched = 0)) / sqrt(sum(norm * norm) filter (where n_unmatched = 0)), 6) as global_drift,
       round(max(change) filter (where n_unmatched = 0 and contains(name, 'norm')), 6) as max_norm_layer from ({DRIFT})
""")
def _(spark, root):
    out = jn.drift_summary(tensors(spark, root), "name")
    return out.withColumn("global_drift", F.round("global_drift", 6)).withColumn("max_norm_layer", F.round("max_norm_layer", 6))


@query("j13_first_root", """
with k as (select n_nationkey as id, n_name as name from nation),
     c as (select c_nationkey as id, min(c_mktsegment) as seg from customer group by 1),
     s as (select s_nationkey as id, min(s_name) as seg from supplier group by 1)
select o_orderkey as id, case when c1.id is not null then 0 when s1.id is not null then 1 else -1 end as root,
       coalesce(case when c1.id is not null then c1.seg when s1.id is not null then s1.seg end, o_orderpriority) as seg
from orders left join (select case when c_custkey % 3 = 0 then c_custkey else -c_custkey end as id, c_mktsegment as seg from customer) c1 on c1.id = o_custkey
left join (select s_suppkey as id, s_name as seg from supplier) s1 on s1.id = o_custkey
""")
def _(spark, root):
    wanted = table(spark, root, "orders").select(
        F.col("o_orderkey"), F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("seg")
    )
    here = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).otherwise(-F.col("c_custkey"))  # the others have another id in this root
    first = table(spark, root, "customer").select(here.alias("id"), F.col("c_mktsegment").alias("seg"))
    second = table(spark, root, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("seg"))
    per_id = wanted.select("id").distinct().withColumn("seg", F.lit(None).cast("string"))
    found = cu.resolve_over_roots(per_id, "id", [first, second], ["seg"])
    found = found.select(F.col("id").alias("_id"), "root", F.col("seg").alias("_seg"))
    return wanted.join(found, F.col("id") == F.col("_id"), "left").select(
        F.col("o_orderkey").alias("id"), "root", F.coalesce("_seg", "seg").alias("seg")
    )


@query("j14_gold_overlap", """
with e as (select l_orderkey as t, l_partkey % 50 as p, l_linenumber as h from lineitem where l_returnflag <> 'N'),
     g as (select distinct l_orderkey as t, l_partkey % 50 as p, l_linenumber as h from lineitem where l_linestatus = 'F'),
     f as (select distinct e.t from e join g on g.t = e.t and g.p = e.p), k as (select distinct e.t from e join g using (t, p, h))
select count(distinct e.t) as n_traces, (select count(*) from f) as n_file_hits, (select count(*) from k) as n_hunk_hits,
       round((select count(*) from f) / count(distinct e.t), 6) as file_rate, round((select count(*) from k) / count(distinct e.t), 6) as hunk_rate
from e
""")
def _(spark, root):
    lines = table(spark, root, "lineitem").select(
        "l_orderkey", (F.col("l_partkey") % 50).alias("path"), "l_linenumber", "l_returnflag", "l_linestatus"
    )
    out = jn.gold_overlap(
        lines.where("l_returnflag <> 'N'"), lines.where("l_linestatus = 'F'"), "l_orderkey", "path", "l_linenumber"
    )
    return out.withColumn("file_rate", F.round("file_rate", 6)).withColumn("hunk_rate", F.round("hunk_rate", 6))


@query("a37_mixture", """
with p as (select source, lang, count(*) as n from documents group by 1, 2)
select source, lang, n, count(*) over (partition by source) as n_categories, round(n / sum(n) over (partition by source), 6) as share_of_shard,
       round(n / sum(n) over (), 6) as share_of_all from p
""")
def _(spark, root):
    out = cu.mixture(table(spark, root, "documents"), "source", "lang")
    return out.withColumn("share_of_shard", F.round("share_of_shard", 6)).withColumn("share_of_all", F.round("share_of_all", 6))


@query("u01_shard_overlap", """
with s as (select o_orderkey as id, 'a' as shard from orders where o_totalprice < 300000 union all
           select o_orderkey, 'b' from orders where o_totalprice > 290000)
select id, count(distinct shard) as n_shards, count(*) as n_rows from s group by 1 having count(*) > 1
""")
def _(spark, root):
    orders = table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    union = orders.where("o_totalprice < 300000").withColumn("shard", F.lit("a")).unionByName(
        orders.where("o_totalprice > 290000").withColumn("shard", F.lit("b"))
    )
    return jn.shard_overlap(union, "id", "shard")


@query("u02_common_ids", """
select o_custkey as id from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderpriority = '5-LOW'
""")
def _(spark, root):
    orders = table(spark, root, "orders")
    a = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return a.intersect(orders.where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("id")))


@query("u03_missing_and_extra", """
select distinct o_custkey as key, 'missing' as side from orders where o_orderpriority = '5-LOW'
  and o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')
union all select distinct o_custkey, 'extra' from orders where o_orderstatus = 'F'
  and o_custkey not in (select o_custkey from orders where o_orderpriority = '5-LOW')
""")
def _(spark, root):
    orders = table(spark, root, "orders")
    return jn.difference_both_ways(
        orders.where("o_orderstatus = 'F'"), orders.where("o_orderpriority = '5-LOW'"), "o_custkey"
    )


@query("u04_used_before", """
select strftime(o_orderdate, '%Y') as batch, count(distinct o_custkey) as n_ids,
       count(distinct case when o_custkey in (select l_suppkey from lineitem) then o_custkey end) as n_used
from orders group by 1
""")
def _(spark, root):
    used = table(spark, root, "lineitem").select(F.col("l_suppkey").alias("used")).distinct()
    fresh = table(spark, root, "orders").select(
        F.date_format("o_orderdate", "yyyy").alias("batch"), "o_custkey"
    ).distinct()
    return fresh.join(used, F.col("o_custkey") == F.col("used"), "left").groupBy("batch").agg(
        F.count("*").alias("n_ids"), F.count("used").alias("n_used")
    )


@query("u05_merged_predictions", """
with v as (select l_orderkey as o, case when l_returnflag = 'R' then 1.0 else 0.0 end as r, l_discount * 10 as v from lineitem
           ), t as (select avg((r - v) * (r - v)) as m from v group by o)
select count(*) as n, (select count(*) from t) as n_trajectories, round(avg((r - v) * (r - v)), 9) as token_mse,
       (select round(avg(m), 9) from t) as trajectory_mse, round(1 - var_pop(r - v) / var_pop(r), 9) as explained_variance from v
""")
def _(spark, root):
    from rungauge.operators.evaluation import value_quality
    from rungauge.plans.evaluation import predictions

    rows = predictions(spark, root)
    first = rows.where("l_linestatus = 'F'")
    second = rows.where("l_linestatus <> 'F'")
    out = value_quality(first.unionByName(second), "trajectory", "reward", "value")
    for c in ("token_mse", "trajectory_mse", "explained_variance"):
        out = out.withColumn(c, F.round(c, 9))
    return out
