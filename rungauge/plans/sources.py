"""Scan and sink queries: Spark writes what it derives from the tables, then scans it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungauge.functions import times
from rungauge.plans import bindings as b
from rungauge.plans.registry import query
from rungauge.plans.sequences import turns
from rungauge.session import spread, spread_table, table
from rungauge.shared import fresh_folder
from rungauge.sources import readers as rd
from rungauge.sources import sinks as sk


def written(spark, df, label: str) -> str:
    """Text lines of a one-column table in a new shared folder."""
    path = fresh_folder(spark, label)
    df.write.text(path)
    return path


@query("s01_task_scan", """
select case when doc_id % 37 = 5 or doc_id % 31 = 4 then null else 'd' || doc_id end as instance_id, case when doc_id % 37 <> 5 then length(text) end as n_chars,
  case when doc_id % 37 <> 5 then lang end as repo, (case when doc_id % 37 = 5 then 0 when doc_id % 3 = 0 then 2 else 1 end)::bigint as n_f2p,
  case when doc_id % 37 = 5 then '' when doc_id % 3 = 0 then 'a::1 b::2' when doc_id % 3 = 1 then 'x::y' else 'bare::t' end as f2p, 0::bigint as n_p2p, doc_id % 37 = 5 as malformed from documents
""")
def _(spark, root):
    i = F.col("doc_id")
    body = F.to_json(
        F.struct(
            F.when(i % 31 != 4, F.concat(F.lit("d"), i.cast("string"))).alias("instance_id"), F.col("text").alias("problem_statement"),
            F.col("source").alias("image_name"), F.col("lang").alias("repo"),
        )
    )
    # A list, a list as JSON text, or one bare text; every 40th line is followed by a blank one; some are cut, some lack their id.
    f2p = F.when(i % 3 == 0, '["a::1","b::2"]').when(i % 3 == 1, '"[\\"x::y\\"]"').otherwise('"bare::t"')
    whole = F.concat(F.expr("substring(j, 1, length(j) - 1)"), F.lit(',"FAIL_TO_PASS":'), f2p, F.lit("}"))
    line = F.when(i % 37 == 5, F.expr("substring(j, 1, length(j) - 1)")).otherwise(whole)
    lines = spread_table(spark, root, "documents", "doc_id").withColumn("j", body).select(
        F.explode(F.when(i % 40 == 0, F.array(line, F.lit(""))).otherwise(F.array(line))).alias("value")
    )
    tasks = rd.scan_tasks(spark, written(spark, lines, "tasks"), "documents")
    sound = lambda c: F.when(~F.col("malformed"), c)
    return tasks.select(
        sound(F.col("instance_id")).alias("instance_id"), sound(F.length("problem_statement")).alias("n_chars"), sound(F.col("repo")).alias("repo"),
        F.coalesce(sound(F.size("FAIL_TO_PASS")), F.lit(0)).cast("long").alias("n_f2p"), F.coalesce(sound(F.array_join("FAIL_TO_PASS", " ")), F.lit("")).alias("f2p"),
        F.size("PASS_TO_PASS").cast("long").alias("n_p2p"), "malformed",
    )


RESULT_SCHEMA = "resolved boolean, n_turns int"


@query("s03_result_folders", """
with n as (select s_nationkey as k, count(*) as c, sum(s_suppkey)::bigint as s from supplier group by 1)
select r.run, k::varchar as instance_id, case when k % 5 < 1 or k % 5 > 3 then null else (s + r.n) % 3 = 0 end as resolved, case when k % 5 between 1 and 3 then c end::int as n_turns, k % 5 not between 1 and 3 as unreadable
from n, (values ('base', 0), ('probe', 1)) r(run, n)
""")
def _(spark, root):
    # One result file per run and nation, made from the nation's suppliers; some are cut, followed by a second object, an array, or empty.
    per = table(spark, root, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("c"), F.sum("s_suppkey").alias("s"))
    runs = F.explode(F.array(F.struct(F.lit("base").alias("run"), F.lit(0).alias("n")), F.struct(F.lit("probe").alias("run"), F.lit(1).alias("n"))))
    rows = per.select("k", "c", "s", runs.alias("r"))
    good = F.concat(
        F.lit('{"resolved": '), ((F.col("s") + F.col("r.n")) % 3 == 0).cast("string"), F.lit(',\n "n_turns": '), F.col("c").cast("string"), F.lit("}")
    )
    cut = F.when(F.col("k") % 2 == 0, F.lit('{"resolved": tr')).otherwise(F.concat(good, good))
    text = F.when(F.col("k") % 5 == 0, cut).when(F.col("k") % 5 == 4, F.concat(F.lit("["), good, F.lit("]"))).otherwise(good)
    path = fresh_folder(spark, "results")
    rows.select(F.col("r.run").alias("run"), F.col("k").alias("instance"), text.alias("value")).repartition("run", "instance").write.partitionBy(
        "run", "instance"
    ).text(path)
    out = rd.read_results(spark, path, RESULT_SCHEMA, r"run=([^/]+)/instance=([^/]+)/")
    # A file that can not be read says nothing about the outcome.
    readable = lambda c: F.when(~F.col("unreadable"), F.col(c)).alias(c)
    return out.select("run", "instance_id", readable("resolved"), readable("n_turns"), "unreadable")


@query("s04_session_segments", """
with f as (select conv_id, turn, md5(conv_id::varchar) as k, case turn % 4 when 0 then '' when 1 then '.compact' || (turn + 1) when 2 then '.post' || turn else '.other9' end as s,
   1000.0 * conv_id as ts, case when conv_id % 3 = 0 then null else 1000.0 * conv_id end as exact from conversations)
select k as key, case turn % 4 when 0 then 'main' when 1 then 'compact' else 'post' end as segment, case turn % 4 when 0 then 0 when 1 then turn + 1 else turn end::int as segment_index, conv_id
from f where turn % 4 <> 3 and coalesce(exact, ts + 600) between 3000 and 80000
""")
def _(spark, root):
    t = F.col("turn")
    suffix = F.when(t % 4 == 0, "").when(t % 4 == 1, F.concat(F.lit(".compact"), (t + 1).cast("string"))).when(
        t % 4 == 2, F.concat(F.lit(".post"), t.cast("string"))
    ).otherwise(".other9")
    ts = F.col("conv_id") * 1000.0
    files = table(spark, root, "conversations").select(
        "conv_id", F.concat(F.md5(F.col("conv_id").cast("string")), suffix, F.lit(".json")).alias("file_name"),
        (ts + 600).alias("modified"), F.when(F.col("conv_id") % 3 != 0, ts).alias("ts"),
    )
    return rd.session_segments(files, since=3000.0, until=80000.0).select("key", "segment", "segment_index", "conv_id")


# Conversations as session files: one main file each, named by a hash, whose first user message (quoted in a third of
# them) gives the key; compact and post files for later turns; broken, foreign and userless ones between them.
SESSION_FILES_SQL = """
with c as (select conv_id, arg_min(text, turn) filter (where role = 'user') as said, 4000000000.0 + 1000.0 * conv_id as ts from conversations group by 1),
 s as (select conv_id, turn, 4000000000.0 + 1000.0 * conv_id + turn as ts from conversations where turn % 4 in (1, 2))
"""
SESSION_ROWS_SQL = """
 m as (select md5(trim(said, chr(32) || chr(9) || chr(10) || chr(13))) as key, 'main' as segment, 0 as segment_index, ts, conv_id from c where said is not null and conv_id % 10 <> 4)
select key, segment, segment_index, arg_max(conv_id, (ts, conv_id)) as conv_id from (
"""


@query("s04_session_files", SESSION_FILES_SQL + "," + SESSION_ROWS_SQL + """
  select * from m union all select md5('stem' || conv_id), case turn % 4 when 1 then 'compact' else 'post' end, turn::int, ts, conv_id from s)
where ts between 4000003000.0 and 4000080000.0 group by 1, 2, 3
""")
def _(spark, root):
    """Session files that the query writes and scans: opened inside the window only."""
    out = rd.read_sessions(spark, session_files(spark, root), since=4_000_003_000.0, until=4_000_080_000.0, slack=4e9)
    return out.select("key", "segment", "segment_index", F.floor((F.col("ts") - 4e9) / 1000).alias("conv_id"))


@query("s04_main_sessions", SESSION_FILES_SQL + "," + SESSION_ROWS_SQL + " select * from m) group by 1, 2, 3")
def _(spark, root):
    """Main files only, without a window: keyed by the first user message."""
    out = rd.read_sessions(spark, session_files(spark, root), main_only=True)
    return out.select("key", "segment", "segment_index", F.floor((F.col("ts") - 4e9) / 1000).alias("conv_id"))


def session_files(spark, root):
    """Writes the session files of all conversations and gives their folder."""
    rows = table(spark, root, "conversations")
    said = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    mains = rows.groupBy("conv_id").agg(said.alias("said"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    quoted = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('"'), F.replace("said", F.lit('"'), F.lit('\\"')), F.lit('" '))).otherwise(F.col("said"))
    parts = F.to_json(F.array(F.create_map(F.lit("type"), F.lit("image"), F.lit("text"), F.lit("no")), F.create_map(F.lit("type"), F.lit("text"), F.lit("text"), quoted)))
    message = lambda role, content: F.concat(F.lit(f'{{"role":"{role}","content":'), content, F.lit("}"))
    first = F.when(F.col("conv_id") % 2 == 0, parts).otherwise(F.regexp_extract(F.to_json(F.struct(quoted.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))
    ts = lambda more: (F.col("conv_id") * 1000 + more + 4_000_000_000).cast("string")
    body = F.concat(F.lit('{"ts":'), ts(F.lit(0)), F.lit(',"request":{"messages":['), message("system", F.lit('"be brief"')), F.when(F.col("said").isNotNull(), F.concat(F.lit(","), message("user", first))).otherwise(""), F.lit("]}}"))
    text = F.when(F.col("conv_id") % 10 == 4, F.lit('{"ts": 4')).otherwise(body)
    files = mains.select(F.concat(F.md5(F.concat(F.lit("main"), F.col("conv_id").cast("string"))), F.lit(".json")).alias("file_name"), text.alias("text"))
    stem = F.md5(F.concat(F.lit("stem"), F.col("conv_id").cast("string")))
    kind = F.when(F.col("turn") % 4 == 1, ".compact").otherwise(".post")
    later = rows.where(F.col("turn") % 4 < 3).where(F.col("turn") % 4 > 0).select(
        F.concat(stem, kind, F.col("turn").cast("string"), F.lit(".json")).alias("file_name"), F.concat(F.lit('{"ts": '), ts(F.col("turn")), F.lit("}")).alias("text")
    )
    other = rows.where("turn = 3").select(F.concat(stem, F.lit(".other9.json")).alias("file_name"), F.lit("{}").alias("text"))
    folder = fresh_folder(spark, "sessions")
    sk.write_named_files(files.unionByName(later).unionByName(other), folder, folders=256)
    return folder


EVENT_LINES = "case when event_id % 50 = 0 then 'malformed' when event_id % 41 = 0 then 'no_session' when event_type = 'signup' then 'retry' when event_type = 'error' then 'upstream_error' when event_id % 37 = 0 then 'upstream_error' else 'request' end"


@query("s05_event_log_scan", f"""
select {EVENT_LINES} as kind, count(*) as n, count(distinct case when {EVENT_LINES} not in ('malformed', 'no_session') then user_id end) as n_sessions,
  cast(sum(case when {EVENT_LINES} = 'request' then cast(json_extract_string(props, '$.k') as bigint) end) as bigint) as prompt_tokens from events group by 1
""")
def _(spark, root):
    i = F.col("event_id")
    event = F.when(F.col("event_type") == "signup", "retry").when(F.col("event_type") == "error", "upstream_error").otherwise("ok")
    usage = F.struct(F.get_json_object("props", "$.k").cast("long").alias("prompt_tokens"))
    body = F.to_json(
        F.struct(
            (times.epoch_micros(F.col("ts")) / 1e6).alias("ts"), F.when(i % 41 != 0, F.col("user_id").cast("string")).alias("session"),
            event.alias("event"), F.when(i % 37 == 0, 503).otherwise(200).alias("status"),
            F.struct(F.lit("stop").alias("finish_reason"), usage.alias("usage")).alias("response"),
        )
    )
    line = F.when(i % 50 == 0, F.substring(body, 1, 25)).otherwise(body)
    log = rd.read_event_log(spark, written(spark, table(spark, root, "events").select(line.alias("value")), "events"))
    return log.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.count_distinct(F.when(~F.col("kind").isin("malformed", "no_session"), F.col("session"))).alias("n_sessions"),
        F.sum(F.when(F.col("kind") == "request", F.col("response.usage.prompt_tokens"))).alias("prompt_tokens"),
    )


def number(column: str):
    return F.col(column).cast("string")


@query("s06_trainer_log", f"""
select run, step, round(response_length, 6) as response_length, round(reward, 6) as reward, round(grad_norm, 6) as grad_norm, groups_seen::double as groups_seen, n_traced::double as n_traced from ({b.STEPS})
""")
def _(spark, root):
    # Each step is logged twice, first with wrong numbers: the later line wins.
    series = b.steps(spark, root)
    early = F.concat(
        F.lit("(Task pid=1) step:"), number("step"), F.lit(" - timing/step_start_wall:1.5 - training/reward:0.001 - actor/grad_norm:np.float64(9.0)")
    )
    late = F.concat(
        F.lit("(Task pid=1) step:"), number("step"), F.lit(" - timing/step_start_wall:1.5 - response_length/mean:"), number("response_length"),
        F.lit(" - training/reward:"), number("reward"),
        F.coalesce(F.concat(F.lit(" - actor/grad_norm:np.float64("), number("grad_norm"), F.lit(")")), F.lit("")),
        F.lit(" - training/dynamic_sampling/n_groups_seen:"), number("groups_seen"), F.lit(" - training/n_rollouts_w_trace:"), number("n_traced"),
    )
    lines = series.select("run", F.explode(F.array(early, F.lit("other output"), late)).alias("value"))
    path = fresh_folder(spark, "trainer")
    lines.write.partitionBy("run").text(path)
    run = F.url_decode(F.regexp_extract("file", r"run=([^/]+)/", 1))
    logged = rd.trainer_metrics(rd.read_lines(spark, path).withColumn("run", run), ["run"], ["file", "block", "line"])
    return logged.select(
        "run", "step", F.round("response_length_mean", 6).alias("response_length"), F.round("training_reward", 6).alias("reward"),
        F.round("actor_grad_norm", 6).alias("grad_norm"), F.col("training_dynamic_sampling_n_groups_seen").alias("groups_seen"),
        F.col("training_n_rollouts_w_trace").alias("n_traced"),
    )


@query("s07_curve_log", """
with m as (select month(o_orderdate) as step, year(o_orderdate) as y, count(*) as n, count_if(o_orderstatus = 'F') as f from orders group by 1, 2)
select y::varchar as run, 'train' as split, step, round(f / n, 4) as reward, n::double as n, 30.25 as step_secs from m
union all select y::varchar, 'val', step, round(f / n, 4), n::double, null from m where step % 3 = 0
""")
def _(spark, root):
    per = table(spark, root, "orders").groupBy(
        F.date_format("o_orderdate", "yyyy").alias("run"), F.month("o_orderdate").alias("step")
    ).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    reward = F.format_string("%.4f", F.round(F.col("f") / F.col("n"), 4))
    color = F.concat(F.lit("\x1b[36m(TaskRunner)\x1b[0m step:"), number("step"))
    train = F.concat(color, F.lit(" - training/reward:"), reward, F.lit(" - training/n_rollouts:"), number("n"), F.lit(" - timing_s/step:30.25"))
    val = F.concat(color, F.lit(" - val/reward:"), reward, F.lit(" - val/n_rollouts:"), number("n"))
    lines = per.select("run", F.explode(F.when(F.col("step") % 3 == 0, F.array(val, train)).otherwise(F.array(train))).alias("value"))
    path = fresh_folder(spark, "curve")
    lines.write.partitionBy("run").text(path)
    read = rd.read_lines(spark, path).withColumn("run", F.regexp_extract("file", r"run=([^/]+)/", 1))
    return rd.curve_metrics(read, ["run"], ["file", "block", "line"]).select("run", "split", "step", "reward", "n", "step_secs")


def rollout_lines(spark, root):
    """Log lines of every rollout; a few have no end, a few end twice."""
    r = spread(b.rollouts(spark, root), "rollout_id", b.table(spark, root, "orders"))
    i = F.col("rollout_id")
    start = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",123 INFO SmithAgent start: instance=task-"), F.col("uid").cast("string"), F.lit(" max_turns=40")
    )

    def done(reward):
        return F.concat(
            F.lit("x done: mode=train submitted="), F.when(i % 2 == 0, "True").otherwise("False"), F.lit(" patch="), F.col("tokens").cast("string"),
            F.lit("B reward="), reward, F.lit(" raw_reward=1.0 binary="), F.col("reward").cast("string"), F.lit(" f2p_ratio=0.5 n_turns="), F.col("n_turns").cast("string"),
            F.lit(" max_prompt_tokens=900 reason=FAIL_TO_PASS "), F.col("n_f2p_pass").cast("string"), F.lit("/"), F.col("n_f2p").cast("string"),
            F.lit(" passed, PASS_TO_PASS "), F.col("n_p2p_ok").cast("string"), F.lit("/"), F.col("n_p2p").cast("string"), F.lit(" ok (f2p_only)"),
        )

    both = F.array(start, F.lit("turn"), done(F.lit("-0.5")), done(F.lit("0.25")))
    lines = F.when(i % 19 == 0, F.array(start)).when(i % 23 == 0, F.array(F.lit("?"))).otherwise(both)
    return r.select(F.col("rollout_id"), F.posexplode(lines).alias("line", "value"))


@query("s08_rollout_log", f"""
select rollout_id, 'task-' || uid as inst, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, 0.25 as reward, reward as binary_, rollout_id % 2 = 0 as submitted, tokens::int as patch, n_turns::int as turns,
   n_f2p_pass::int as f2p_pass, n_f2p::int as f2p_tot, n_p2p_ok <> n_p2p as p2p_broke from ({b.ROLLOUTS}) where rollout_id % 19 <> 0 and rollout_id % 23 <> 0
""")
def _(spark, root):
    out = rd.rollout_logs(rollout_lines(spark, root), "rollout_id", ["line"])
    return out.select(
        "rollout_id", "inst", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "reward", F.col("binary").alias("binary_"), "submitted", "patch", "turns",
        "f2p_pass", "f2p_tot", "p2p_broke",
    )


@query("s08_rollout_log_errors", """
select case when o_orderkey % 19 = 0 then 'no_done' when o_orderkey % 23 = 0 then 'no_start' else 'complete' end as outcome, count(*) as n_logs from orders group by 1
""")
def _(spark, root):
    return rd.rollout_log_errors(rollout_lines(spark, root), "rollout_id", ["line"])


@query("s09_archive_scan", """
select s_nationkey::varchar as logical_name, s_nationkey % 2 = 0 as is_gz, sum(s_suppkey)::bigint as key_sum from supplier group by 1, 2
""")
def _(spark, root):
    # Every record has a gzip copy; odd ones a plain copy with the same content beside it.
    per = table(spark, root, "supplier").groupBy(F.col("s_nationkey").alias("name")).agg(F.sum("s_suppkey").alias("n"))
    rows = per.select("name", F.to_json(F.struct("n")).alias("value"))
    path = fresh_folder(spark, "archive")
    rows.repartition("name").write.partitionBy("name").option("compression", "gzip").text(path)
    rows.where("name % 2 = 1").repartition("name").write.mode("append").partitionBy("name").option("compression", "none").text(path)
    out = rd.read_archive(spark, path, r"name=([^/]+)/")
    return out.select("logical_name", "is_gz", F.get_json_object("value", "$.n").cast("long").alias("key_sum"))


@query("s10_broken_json", """
select doc_id % 17 = 0 as bad, count(*) as n, cast(sum(case when doc_id % 17 = 0 then 0 else doc_id end) as bigint) as id_sum, cast(sum(case when doc_id % 17 = 0 then 0 else length(text) end) as bigint) as n_chars
from documents group by 1
""")
def _(spark, root):
    # Records broken between tokens, by either line end, with their fields in either order, are joined again; a cut one is bad and harms no other.
    i = F.col("doc_id")
    text = F.concat(F.lit('"text": '), F.expr("substring(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)"))
    number = F.concat(F.lit('"doc_id": '), i.cast("string"))
    gap = F.when(i % 3 == 0, ",\n\n").when(i % 3 == 1, ",\r\n ").otherwise(", ")
    end = F.when(i % 5 == 0, "\n}").otherwise("}")
    whole = F.concat(F.lit("{"), F.when(i % 2 == 0, F.concat(number, gap, text)).otherwise(F.concat(text, gap, number)), end)
    line = F.when(i % 17 == 0, F.concat(F.lit("{"), number, F.lit(', "text": '))).otherwise(whole)
    path = written(spark, spread_table(spark, root, "documents", "doc_id").select(line.alias("value")), "broken")
    out = rd.read_broken_json(spark, path, "doc_id long, text string", record_start="{")
    return out.groupBy("bad").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("doc_id"))).alias("id_sum"),
        F.sum(F.when(F.col("bad"), 0).otherwise(F.length("text"))).cast("long").alias("n_chars"),
    )


@query("s11_action_log", """
select l_orderkey as trace, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as k,
  case l_linenumber % 3 when 0 then 'echo "it''s" ' || l_partkey when 1 then 'cat a' || chr(10) || 'ls ' || l_partkey else 'grep ' || l_partkey end as action from lineitem where l_linestatus = 'F'
""")
def _(spark, root):
    from rungauge.functions.ranks import with_position

    n, part = F.col("l_linenumber") % 3, F.col("l_partkey").cast("string")
    literal = F.when(n == 0, F.concat(F.lit("'echo \"it\\'s\" "), part, F.lit("'"))).when(
        n == 1, F.concat(F.lit("'cat a\\nls "), part, F.lit("'"))
    ).otherwise(F.concat(F.lit('"grep '), part, F.lit('"')))
    line = F.when(
        F.col("l_linestatus") == "F", F.concat(F.lit("INFO turn="), F.col("l_linenumber").cast("string"), F.lit(" cmd="), literal, F.lit(" rc=0"))
    ).otherwise("INFO thinking")
    lines = spread(turns(spark, root), "l_partkey").select(F.col("l_orderkey").alias("trace"), "l_linenumber", "l_partkey", "l_suppkey", line.alias("value"))
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    actions = rd.action_log(lines, "trace", order)
    return with_position(actions, ["trace"], order, "k").select("trace", "k", "action")


def sample_rows(spark, root):
    """Conversations as training samples: segments of four turns with their messages as JSON."""
    from rungauge.plans.messages import sessions

    rows = sessions(spark, root)
    message = lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
    return rows.select(
        F.col("trace").cast("string").alias("instance_id"), F.lit("r1").alias("run"),
        F.when(F.col("segment_index") == 0, "main").otherwise("post").alias("segment"), "segment_index",
        F.to_json(F.transform("messages", message)).alias("messages_json"), F.lit("[]").alias("tools_json"),
        F.when(F.col("trace") % 10 == 0, "val").otherwise("train").alias("split"),
    )


@query("s12_sample_scan", """
select conv_id::varchar as instance_id, (turn // 4)::int as segment_index, count(*) as n_messages, count_if(role = 'assistant') as n_assistant,
  case when conv_id % 10 = 0 then 'val' else 'train' end as split from conversations group by all
""")
def _(spark, root):
    path = fresh_folder(spark, "samples")
    sk.write_split_parquet(sample_rows(spark, root), path)
    out = rd.read_samples(spark, path)
    return out.select(
        "instance_id", "segment_index", F.size("messages").cast("long").alias("n_messages"),
        F.size(F.filter("messages", lambda m: m["role"] == "assistant")).cast("long").alias("n_assistant"), "split",
    )


@query("s13_sinks", """
select 'json' as sink, count(*) as n, cast(sum(n_chars) as bigint) as n_chars, cast(sum(length(source)) as bigint) as n_text from documents
union all select 'parquet', count(*), cast(sum(n_chars) as bigint), cast(sum(length(source)) as bigint) from documents
union all select 'csv', count(*), cast(sum(n_chars) as bigint), cast(sum(length(replace(replace(source || ',a' || chr(10) || 'b', ',', ';'), chr(10), ' '))) as bigint) from documents
""")
def _(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "n_chars", "source", F.when(F.col("doc_id") % 9 == 0, "val").otherwise("train").alias("split"))
    json_path, parquet_path, csv_path = (fresh_folder(spark, f"sink-{k}") for k in ("json", "parquet", "csv"))
    sk.write_json_lines(docs, json_path)
    sk.write_split_parquet(docs, parquet_path)
    sk.write_csv(docs.withColumn("source", F.concat("source", F.lit(",a\nb"))), csv_path, ["source"])
    back = {
        "json": spark.read.schema(docs.schema).json(json_path),
        "parquet": spark.read.parquet(parquet_path),
        "csv": spark.read.schema(docs.schema).option("header", True).csv(csv_path),
    }
    out = None
    for name, df in back.items():
        part = df.agg(
            F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.sum(F.length("source")).cast("long").alias("n_text")
        ).withColumn("sink", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("s14_trajectory_sink", f"""
select case when rollout_id % 10 = 0 then 'validation' else 'train' end as split, (year(ts) - 1995)::int as global_step, count(*) as n,
   cast(sum(n_turns) as bigint) as n_turns, cast(sum(tokens) as bigint) as resp_tokens, round(avg(reward), 6) as reward from ({b.ROLLOUTS}) group by 1, 2
""")
def _(spark, root):
    rows = b.rollouts(spark, root).select(
        "rollout_id", "reward", "n_turns", F.col("tokens").alias("resp_tokens"), F.col("price").alias("duration_s"),
        F.when(F.col("rollout_id") % 10 == 0, "validation").otherwise("train").alias("split"), (F.year("ts") - 1995).alias("global_step"),
    )
    path = fresh_folder(spark, "trajectories")
    sk.write_trajectories(rows, path)
    back = spark.read.schema(rows.schema).json(path)
    return back.groupBy("split", "global_step").agg(
        F.count("*").alias("n"), F.sum("n_turns").alias("n_turns"), F.sum("resp_tokens").alias("resp_tokens"), F.round(F.avg("reward"), 6).alias("reward")
    )


@query("s16_publish", """
select true as complete, count(*) as n_completed, count_if(o_orderstatus = 'F') as n_resolved from orders
""")
def _(spark, root):
    summary = table(spark, root, "orders").agg(
        F.count("*").alias("n_completed"), F.count_if(F.col("o_orderstatus") == "F").alias("n_resolved")
    ).withColumn("complete", F.lit(True))
    path = fresh_folder(spark, "summary")
    sk.publish(summary, path)
    return spark.read.schema("complete boolean, n_completed long, n_resolved long").json(path)
