"""Ordered-logic queries on events and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungauge.functions import times
from rungauge.operators import grader as gd
from rungauge.operators import sequences as sq
from rungauge.operators import trajectories as tr
from rungauge.plans.messages import MESSAGES, messages
from rungauge.plans.registry import query
from rungauge.session import spread, spread_table, table

EVENTS = """
select event_id, user_id, epoch_us(ts) as us, event_type, value, props, cast(json_extract_string(props, '$.k') as integer) as k from events
"""
BY_USER = "partition by user_id order by us, event_id"
ORDER = ["us", "event_id"]


def events(spark, root):
    return table(spark, root, "events").select(
        "event_id", "user_id", times.epoch_micros(F.col("ts")).alias("us"), "event_type", "value", "props",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


TURNS = ["l_linenumber", "l_partkey", "l_suppkey"]
BY_ORDER = "partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey"


def turns(spark, root):
    return table(spark, root, "lineitem").select(
        "l_orderkey", *TURNS, "l_quantity", "l_returnflag", "l_linestatus", "l_extendedprice"
    )


@query("w01_gap_sessions", f"""
with g as (select *, us - lag(us) over ({BY_USER}) > 43200000000 as gap from ({EVENTS}))
select event_id, user_id, cast(sum(case when gap then 1 else 0 end) over ({BY_USER}) as bigint) as session from g
""")
def _(spark, root):
    return sq.gap_sessions(events(spark, root), ["user_id"], ORDER, "us", 43_200_000_000).select(
        "event_id", "user_id", "session"
    )


RUNS = f"""
with p as (select *, case when event_type = 'view' then null else event_type end as sig from ({EVENTS})),
 c as (select *, case when sig is null or sig is distinct from lag(sig) over ({BY_USER}) then 1 else 0 end as brk from p),
 i as (select *, sum(brk) over ({BY_USER}) as isl from c)
select event_id, user_id, case when sig is null then 0 else row_number() over (partition by user_id, isl order by us, event_id) end as run_length from i
"""


def runs(spark, root):
    signature = F.when(F.col("event_type") != "view", F.col("event_type"))
    return sq.identical_runs(events(spark, root), ["user_id"], ORDER, signature)


@query("w06_identical_runs", RUNS)
def _(spark, root):
    return runs(spark, root).select("event_id", "user_id", "run_length")


@query("a33_repetition_profile", f"""
with r as ({RUNS}), p as (select user_id, count(*) as n, count_if(run_length > 1) as rep, max(run_length) as m from r group by 1)
select cast(sum(n) as bigint) as n_calls, cast(sum(rep) as bigint) as n_repeated, count(*) as n_keys, count_if(m >= 4) as n_looping_keys,
       max(m) as longest, round(sum(rep) / sum(n), 6) as repeated_share from p
""")
def _(spark, root):
    out = sq.repetition_profile(runs(spark, root), ["user_id"], 4)
    return out.withColumn("repeated_share", F.round("repeated_share", 6))


@query("w07_periodic_cycles", f"""
with s as (select *, case when k >= 5 then (case when event_type in ('view', 'click', 'error') then 'a' else 'b' end) || (k // 60) end as sig from ({EVENTS})),
 h as (select *, lag(sig, 1) over ({BY_USER}) as s1, lag(sig, 2) over ({BY_USER}) as s2, lag(sig, 3) over ({BY_USER}) as s3,
              lag(sig, 4) over ({BY_USER}) as s4, lag(sig, 5) over ({BY_USER}) as s5 from s)
select event_id, case when sig = s1 and s1 = s2 then 1
   when sig = s2 and s2 = s4 and s1 = s3 and s3 = s5 then 2 end as period from h
""")
def _(spark, root):
    rows = events(spark, root)
    signature = F.when(F.col("event_type").isin("view", "click", "error"), "a").otherwise("b")
    fingerprint = F.when(F.col("k") >= 5, F.floor(F.col("k") / 60))
    return sq.periodic_cycles(rows, ["user_id"], ORDER, signature, fingerprint).select("event_id", "period")


@query("w08_context_drops", f"""
with s as (select *, case when event_type = 'view' then 0 else value end as ctx from ({EVENTS})),
 l as (select *, last_value(case when ctx > 0 then ctx end ignore nulls) over ({BY_USER} rows between unbounded preceding and 1 preceding) as before from s)
select event_id, coalesce(before > 60 and ctx > 0 and ctx < 0.5 * before, false) as dropped from l
""")
def _(spark, root):
    rows = events(spark, root).withColumn("ctx", F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value")))
    return sq.context_drops(rows, ["user_id"], ORDER, "ctx", 60.0).select("event_id", "dropped")


@query("w09_step_delta", f"""
with s as (select *, cast(l_quantity as integer) % 7 as n, l_returnflag = 'R' as ok from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((n - coalesce(lag(n) over ({BY_ORDER}), 0)) / 7.0, 6) as delta,
   case when ok and not coalesce(lag(ok) over ({BY_ORDER}), false) then 1.0 when not ok and coalesce(lag(ok) over ({BY_ORDER}), false) then -1.0 else 0.0 end as flip from s
""")
def _(spark, root):
    rows = turns(spark, root).select(
        "l_orderkey", *TURNS, (F.col("l_quantity").cast("int") % 7).alias("n"), F.lit(7).alias("total"),
        (F.col("l_returnflag") == "R").alias("ok"),
    )
    out = sq.step_delta(rows, ["l_orderkey"], TURNS, "n", "total", "ok")
    return out.select("l_orderkey", *TURNS, F.round("delta", 6).alias("delta"), "flip")


KIND_SQL = "case event_type when 'signup' then 'task' when 'error' then 'compact' when 'purchase' then 'post' else 'other' end"
SEGMENTS = f"""
with r as (select *, {KIND_SQL} as kind, md5((k // 50)::varchar) as task from ({EVENTS})),
 c as (select *, last_value(case when kind = 'task' then task end ignore nulls) over ({BY_USER} rows between unbounded preceding and 1 preceding) as former from r),
 s as (select *, case when kind = 'task' and task is distinct from former then 1 else 0 end as starts from c),
 n as (select *, sum(starts) over ({BY_USER}) as run_no from s),
 m as (select *, case when run_no > 0 then count_if(kind = 'compact') over (partition by user_id, run_no order by us, event_id) else 0 end as n_compact from n)
select event_id, user_id, cast(run_no as bigint) as run_no, cast(n_compact as bigint) as n_compact,
  case when run_no = 0 then 'unknown' when kind = 'task' then 'task' when kind = 'compact' then 'compact' || n_compact
       when kind = 'post' then 'post' || greatest(n_compact, 1) else 'other' end as segment from m
"""


def requests(spark, root):
    kind = F.expr(KIND_SQL)
    return events(spark, root).withColumn("kind", kind).withColumn(
        "task", F.md5(F.floor(F.col("k") / 50).cast("string"))
    )


@query("w18_client_segments", SEGMENTS)
def _(spark, root):
    out = sq.client_segments(requests(spark, root), "user_id", ORDER, "kind", "task")
    return out.select("event_id", "user_id", F.col("run_no").cast("long").alias("run_no"), "n_compact", "segment")


# Consecutive tool outputs: everything in a conversation but every fourth message.
@query("w19_shared_budget", f"""
with m as (select trace, idx, (trace + idx) % 4 <> 0 as tool, content from ({MESSAGES})),
 c as (select *, case when tool and length(content) > 300 then substr(content, 1, 300) || chr(10) || '...[truncated ' || (length(content) - 300) || ' chars: tool output limit]' else content end as t from m),
 i as (select *, sum(case when tool then 0 else 1 end) over (partition by trace order by idx) as isl, case when tool then length(t) else 0 end as len from c),
 b as (select *, sum(len) over (partition by trace, isl) as total, sum(len) over (partition by trace, isl order by idx) - len as before from i),
 g as (select *, greatest(0, 500 - before) as budget from b)
select trace, idx, case when not tool or total <= 500 or len <= budget then t
  when budget > 0 then substr(t, 1, budget::bigint) || chr(10) || '...[truncated ' || (len - budget)::bigint || ' chars: tool output limit]'
  else '...[truncated ' || len || ' chars: tool output limit]' end as content from g
""")
def _(spark, root):
    tool = (F.col("trace") + F.col("idx")) % 4 != 0
    out = sq.shared_budget(messages(spark, root), ["trace"], ["idx"], tool, "content", 300, 500)
    return out.select("trace", "idx", "content")


@query("w20_keep_last_request", f"""
select user_id as rollout, event_id as seq from ({EVENTS}) where event_type = 'error'
union all select user_id, max(event_id) from ({EVENTS}) where event_type <> 'error' group by user_id, k % 5, k % 3
""")
def _(spark, root):
    rows = events(spark, root).select(
        F.col("user_id").alias("rollout"), F.col("event_id").alias("seq"), F.array(F.col("k") % 5, F.col("k") % 3).alias("prompt"),
        (F.col("event_type") != "error").alias("valid"),
    )
    return sq.keep_last_request(rows, "rollout", "prompt", "seq", F.col("valid")).select("rollout", "seq")


@query("w32_attempts", f"""
select l_orderkey, l_partkey, l_suppkey, row_number() over ({BY_ORDER}) as attempt, case when l_returnflag = 'R' then 1.0 else 0.0 end as local_reward,
   l_returnflag <> 'R' and row_number() over ({BY_ORDER}) < 3 as should_recover from lineitem
""")
def _(spark, root):
    rows = turns(spark, root).withColumn("ok", F.col("l_returnflag") == "R")
    out = sq.attempts(rows, ["l_orderkey"], TURNS, "ok", 3)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "attempt", "local_reward", "should_recover")


@query("w33_step_budget", f"""
with r as (select *, event_type <> 'error' as counted, event_type = 'signup' as fresh from ({EVENTS})),
 n as (select *, sum(case when fresh and counted then 1 else 0 end) over ({BY_USER}) as isl from r),
 s as (select *, count_if(counted) over (partition by user_id, isl order by us, event_id) as step from n)
select event_id, step, case when counted then case when step > 8 then 'over' when step >= 8 then 'used_up' when step >= 5 then 'warn' else 'ok' end end as budget_state from s
""")
def _(spark, root):
    out = sq.step_budget(
        events(spark, root), "user_id", ORDER, F.col("event_type") == "signup", F.col("event_type") != "error", 8, 3
    )
    return out.select("event_id", "step", "budget_state")


@query("r08_chunk_assembly", f"""
select user_id, us // 86400000000 as response, string_agg(event_type, '' order by us, event_id) as text,
  arg_max(event_type, (us, event_id)) filter (where event_type in ('purchase', 'error')) as finish,
  arg_max(k, (us, event_id)) filter (where k > 50) as usage, count(*) as n_chunks from ({EVENTS}) group by 1, 2
""")
def _(spark, root):
    rows = events(spark, root).select(
        "user_id", F.floor(F.col("us") / 86_400_000_000).alias("response"), "us", "event_id", F.col("event_type").alias("part"),
        F.when(F.col("event_type").isin("purchase", "error"), F.col("event_type")).alias("finish"),
        F.when(F.col("k") > 50, F.col("k")).alias("usage"),
    )
    return sq.assemble_chunks(rows, ["user_id", "response"], ORDER, "part")


# Events as lines of streamed answers, one answer per client and day: content, reasoning, two tool calls
# with interleaved pieces, ends with usage, and lines that hold no chunk.
LINE_SQL = """
case event_id % 9 when 0 then 'data: {"choices":[{"delta":{"content":"' || event_type || '"}}]}'
  when 1 then 'data:{"choices":[{"delta":{"reasoning_content":"r' || k || ' ","content":""}}]}'
  when 2 then 'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"id":"c' || event_id || '","function":{"name":"get","arguments":"["}}]}}]}'
  when 3 then 'data: {"choices":[{"delta":{"tool_calls":[{"index":1,"function":{"arguments":"' || k || ',"}}]}}]}'
  when 4 then 'data: {"choices":[{"delta":{"tool_calls":[{"index":1,"id":"d' || event_id || '","function":{"name":"p"}},{"function":{"arguments":"y"}}]}}]}'
  when 5 then 'data: {"choices":[{"delta":{},"finish_reason":"' || event_type || '"}],"usage":{"total":' || k || '}}'
  when 6 then ': keep-alive' when 7 then 'data: {"choices":[{"delta":{"content":"lost' else 'data: [DONE]' end
"""
ANSWER_SQL = f"""
with e as (select *, us // 86400000000 as response, event_id % 9 as m from ({EVENTS})),
 a as (select user_id, response, string_agg(event_type, '' order by us, event_id) filter (where m = 0) as content,
   string_agg('r' || k || ' ', '' order by us, event_id) filter (where m = 1) as reasoning,
   count_if(m in (2, 4)) > 0 as c0, count_if(m in (3, 4)) > 0 as c1,
   arg_max('c' || event_id, (us, event_id)) filter (where m = 2) as id0, string_agg('get', '' order by us, event_id) filter (where m = 2) as name0,
   string_agg(case m when 2 then '[' else 'y' end, '' order by us, event_id) filter (where m in (2, 4)) as args0,
   arg_max('d' || event_id, (us, event_id)) filter (where m = 4) as id1, string_agg('p', '' order by us, event_id) filter (where m = 4) as name1,
   string_agg(k || ',', '' order by us, event_id) filter (where m = 3) as args1,
   arg_max(event_type, (us, event_id)) filter (where m = 5) as finish, arg_max('{{"total":' || k || '}}', (us, event_id)) filter (where m = 5) as usage, count_if(m < 6) as n_chunks
  from e group by 1, 2)
select user_id, response, content, reasoning, finish, usage, n_chunks,
  concat_ws(';', case when c0 then concat_ws('|', '0', coalesce(id0, '-'), coalesce(name0, ''), coalesce(args0, '')) end,
                 case when c1 then concat_ws('|', '1', coalesce(id1, '-'), coalesce(name1, ''), coalesce(args1, '')) end) as calls from a
"""


def answer_line():
    """The line of an event."""
    return F.expr(LINE_SQL.replace("|| k ||", "|| cast(k as string) ||"))


def answer_lines(rows):
    """``events`` as lines of answers."""
    return rows.select("user_id", F.floor(F.col("us") / 86_400_000_000).alias("response"), *ORDER, answer_line().alias("line"))


def written_calls(answers):
    """Answers with their tool calls as one text."""
    call = lambda c: F.concat_ws("|", c["index"].cast("string"), F.coalesce(c["id"], F.lit("-")), c["name"], c["arguments"])
    return answers.withColumn("calls", F.concat_ws(";", F.transform("tool_calls", call))).drop("tool_calls")


@query("r08_message_assembly", ANSWER_SQL)
def _(spark, root):
    """Content, reasoning and tool calls by index from raw lines."""
    deltas = sq.chunk_deltas(answer_lines(events(spark, root)), ["user_id", "response"], ORDER, "line")
    return written_calls(sq.assemble_responses(deltas, ["user_id", "response"], ORDER))


# --- event logs -----------------------------------------------------------------------


def log_rows(spark, root):
    """Events as a session log: kinds by type, a few malformed or without session."""
    kind = (
        F.when(F.col("event_id") % 50 == 0, "malformed").when(F.col("event_id") % 41 == 0, "no_session")
        .when(F.col("event_type") == "signup", "retry").when(F.col("event_type") == "error", "upstream_error").otherwise("request")
    )
    return events(spark, root).withColumn("kind", kind).withColumn(
        "finish", F.when(F.col("k") < 10, "length").otherwise("stop")
    )


@query("a20_session_rollup", """
with e as (select user_id, event_type, cast(json_extract_string(props, '$.k') as integer) as k from events where event_id % 50 <> 0 and event_id % 41 <> 0)
select user_id, count_if(event_type not in ('signup', 'error')) as n_req, count_if(event_type = 'signup') as n_retry, count_if(event_type = 'error') as n_err,
   count_if(event_type not in ('signup', 'error') and k >= 10) as n_stop, count_if(event_type not in ('signup', 'error') and k < 10) as n_length from e group by 1
""")
def _(spark, root):
    return tr.session_rollup(log_rows(spark, root), "user_id", "kind", "finish")


@query("a19_api_usage", f"""
select count_if(event_type not in ('error', 'signup') and k > 2) as n_ok, cast(sum(case when event_type not in ('error', 'signup') and k > 2 then k * 10 else 0 end) as bigint) as prompt_tokens,
  cast(sum(case when event_type not in ('error', 'signup') and k > 2 then cast(floor(value) as bigint) else 0 end) as bigint) as completion_tokens,
  cast(sum(case when event_type not in ('error', 'signup') and k > 50 then k else 0 end) as bigint) as reasoning_tokens,
  cast(sum(case when event_type not in ('error', 'signup') and k > 2 and event_type = 'view' then k * 5 else 0 end) as bigint) as cached_tokens,
  count_if(event_type = 'signup') as n_429, count_if(event_type in ('signup', 'error')) as n_not_200 from ({EVENTS})
""")
def _(spark, root):
    status = F.when(F.col("event_type") == "signup", 429).when(F.col("event_type") == "error", F.lit(None)).otherwise(200)
    rows = events(spark, root).select(
        status.alias("status"), (F.col("k") > 2).alias("has_usage"), (F.col("k") * 10).alias("prompt_tokens"),
        F.floor("value").alias("completion_tokens"), F.when(F.col("k") > 50, F.col("k")).alias("reasoning_tokens"),
        F.when(F.col("event_type") == "view", F.col("k") * 5).alias("cached_tokens"),
    )
    return tr.api_usage(rows)


WINDOWS = [(1704153600.0, 1704240000.0), (1704672000.0, 1705276800.5), (1705276000.0, 1705300000.0)]


@query("f07_time_windows", "select event_id, user_id from (" + EVENTS + ") where " + " or ".join(
    f"us / 1000000.0 between {lo} and {hi}" for lo, hi in WINDOWS))
def _(spark, root):
    rows = events(spark, root)
    return rows.where(tr.in_windows(F.col("us") / 1000000.0, WINDOWS)).select("event_id", "user_id")


@query("f16_unsafe_secrets", """
with p as (select event_id, unnest([{'path': 'cfg.api_key', 'v': case event_id % 3 when 0 then '****' when 1 then 'sk-' || event_id else '' end},
   {'path': 'cfg.k', 'v': json_extract_string(props, '$.k')}, {'path': 'meta.db.Password', 'v': case when event_id % 5 = 0 then '<redacted>' else json_extract_string(props, '$.k') end}]) as x from events)
select event_id, x.path as path, case when x.v = '' then 'empty' when x.v in ('****', '<redacted>') then 'masked' else 'unsafe' end as state from p where x.path <> 'cfg.k'
""")
def _(spark, root):
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    key = F.when(i % 3 == 0, "****").when(i % 3 == 1, F.concat(F.lit("sk-"), i.cast("string"))).otherwise("")
    password = F.when(i % 5 == 0, "<redacted>").otherwise(k)
    flat = F.create_map(F.lit("cfg.api_key"), key, F.lit("cfg.k"), k, F.lit("meta.db.Password"), password)
    pairs = table(spark, root, "events").select("event_id", F.explode(flat).alias("path", "value"))
    return tr.unsafe_secrets(pairs, "path", "value").select("event_id", "path", "state")


@query("f17_terminal_log", f"""
with e as (select user_id, us, event_id, case when event_id % 997 = 0 then null when event_type in ('purchase', 'signup') then 'step_finish' else 'tool_use' end as type,
   's' || user_id || case when event_id % 1009 = 0 then 'x' else '' end as session, case event_type when 'purchase' then 'stop' when 'signup' then 'tool-calls' end as reason,
   case when user_id % 11 = 0 then 124 when user_id % 13 = 0 then 1 else 0 end as rc from ({EVENTS})),
 p as (select user_id, max(rc) as rc, count_if(type is null) as bad, count(distinct session) as ns, arg_max(coalesce(type, ''), (us, event_id)) as lt, arg_max(coalesce(reason, ''), (us, event_id)) as lr from e group by 1)
select user_id, rc = 0 and bad = 0 and ns = 1 and lt = 'step_finish' and lr = 'stop' as trajectory_terminal,
  case when rc = 124 then 'runner_timeout' when rc <> 0 then 'runner_error' when bad > 0 then 'incomplete_or_invalid_log'
       when ns = 1 and lt = 'step_finish' and lr = 'stop' then 'stop' else 'missing_final_stop_or_mixed_sessions' end as termination_reason from p
""")
def _(spark, root):
    i, u = F.col("event_id"), F.col("user_id")
    session = F.concat(F.lit("s"), u.cast("string"), F.when(i % 1009 == 0, "x").otherwise(""))
    rows = events(spark, root).select(
        "user_id", "us", "event_id",
        F.when(i % 997 == 0, F.lit(None)).when(F.col("event_type").isin("purchase", "signup"), "step_finish").otherwise("tool_use").alias("type"),
        session.alias("session"), session.alias("part_session"),
        F.when(F.col("event_type") == "purchase", "stop").when(F.col("event_type") == "signup", "tool-calls").alias("reason"),
        F.when(u % 11 == 0, 124).when(u % 13 == 0, 1).otherwise(0).alias("rc"),
    )
    return tr.terminal_state(rows, "user_id", ORDER)


@query("f18_stop_event_class", f"""
with e as (select event_id, case when event_type in ('purchase', 'view') then 'step_finish' else 'tool_use' end as type, case when event_type = 'purchase' then 'stop' else 'tool-calls' end as reason,
   user_id as session, event_id // 3 as message_id, value, k from ({EVENTS})),
 x as (select message_id, count(*) as n, min(session) as session, arg_min(value, session) as v, arg_min(k, session) as k from (select * replace (case when k % 4 = 0 then -1 - message_id else message_id end as message_id) from e) group by 1)
select event_id, case when type = 'step_finish' and reason = 'stop' and x.n = 1 and x.session = e.session then
   case when x.v > 100 then 'compaction' when x.k % 5 > 0 then 'task_stop' else 'unknown' end else 'unknown' end as stop_class
from e left join x on x.message_id = e.message_id
""")
def _(spark, root):
    base = events(spark, root).select(
        "event_id",
        F.when(F.col("event_type").isin("purchase", "view"), "step_finish").otherwise("tool_use").alias("type"),
        F.when(F.col("event_type") == "purchase", "stop").otherwise("tool-calls").alias("reason"),
        F.col("user_id").alias("session"), F.floor(F.col("event_id") / 3).alias("message_id"), "value", "k",
    )
    exported = base.select(
        F.when(F.col("k") % 4 == 0, -1 - F.col("message_id")).otherwise(F.col("message_id")).alias("message_id"), "session", F.lit("assistant").alias("role"), (F.col("value") > 100).alias("summary"),
        F.lit("build").alias("agent"), F.lit("stop").alias("finish"), F.when(F.col("k") % 5 == 0, "failed").alias("error"),
    )
    return tr.stop_event_class(base, exported).select("event_id", "stop_class")


@query("f21_prefilter_then_parse", """
select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where contains(props, '"k": 7')
""")
def _(spark, root):
    out = tr.contains_then_parse(table(spark, root, "events").select("event_id", "props"), "props", '"k": 7', "k bigint")
    return out.select("event_id", F.col("j.k").alias("k"))


@query("a30_round_metric_merge", f"""
with m as (select user_id, case when event_type in ('click', 'view') then 'training/n_' || event_type else 'reward/' || event_type end as name, us // 86400000000 as round, max(k) as v from ({EVENTS}) group by 1, 2, 3)
select user_id, name, cast(case when starts_with(name, 'training/n_') then sum(v) else arg_max(v, round) end as bigint) as value, count(*) as n_rounds from m group by 1, 2
""")
def _(spark, root):
    name = F.concat(
        F.when(F.col("event_type").isin("click", "view"), "training/n_").otherwise("reward/"), F.col("event_type")
    )
    from rungauge.operators.monitor import merge_round_metrics

    per = events(spark, root).groupBy("user_id", name.alias("name"), F.floor(F.col("us") / 86_400_000_000).alias("round")).agg(
        F.max("k").cast("long").alias("v")
    )
    return merge_round_metrics(per, ["user_id"], "name", "round", "v")


@query("t27_usage_audit", """
select source, count_if(length(text) > 0) as n_prompt, count_if(abs(length(text) // 4 - (length(text) // 4 + doc_id % 40)) > greatest(2, (length(text) // 4 + doc_id % 40) // 20)
    and length(text) // 4 > 0) as n_prompt_mismatch, count_if(length(text) // 3 > 0) as n_response, 0::bigint as n_response_mismatch
from documents group by 1
""")
def _(spark, root):
    n = F.length("text")
    quarter = F.floor(n / 4)
    rows = spread_table(spark, root, "documents", "doc_id").select(
        "source", quarter.alias("p"), (quarter + F.col("doc_id") % 40).alias("pe"), F.floor(n / 3).alias("r"),
        F.when(F.floor(n / 3) > 0, F.floor(n / 3)).alias("re"),
    )
    return gd.usage_audit(rows, ["source"], {"prompt": ("p", "pe"), "response": ("r", "re")})


@query("t28_redaction", """
select event_id, '{"k": ' || json_extract_string(props, '$.k') || ', "API_KEY": "<redacted>", "nested": [{"password": "<redacted>", "user": ' || user_id || '}]}' as json,
  'API_KEY,nested.0.password' as touched from events
""")
def _(spark, root):
    raw = F.concat(
        F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"API_KEY":"s'), F.col("event_id").cast("string"),
        F.lit('","nested":[{"password":{"deep":1},"user":'), F.col("user_id").cast("string"), F.lit("}]}"),
    )
    out = spread_table(spark, root, "events", "event_id").select("event_id", gd.redact_json(raw).alias("r"))
    return out.select("event_id", F.col("r.json").alias("json"), F.array_join("r.touched", ",").alias("touched"))


@query("t28_flat_redaction", """
select event_id, json_extract_string(props, '$.k') as k, '<redacted>' as secret from events
""")
def _(spark, root):
    flat = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("Secret"), F.col("event_type"))
    out = table(spark, root, "events").select("event_id", gd.redact_map(flat).alias("m"))
    return out.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["Secret"].alias("secret"))


@query("t34_metric_grid", """
select l_returnflag as name, count(*) as n, count_if(l_discount * 100 / 4 * 512 = floor(l_discount * 100 / 4 * 512)) as n_on_grid,
       round(count_if(l_discount * 100 / 4 * 512 = floor(l_discount * 100 / 4 * 512)) / count(*), 6) as share from lineitem group by 1
""")
def _(spark, root):
    from rungauge.operators.monitor import grid_share

    rows = table(spark, root, "lineitem").select(F.col("l_returnflag").alias("name"), (F.col("l_discount") * 100 / 4).alias("v"))
    return grid_share(rows, "name", "v").withColumn("share", F.round("share", 6))


@query("t35_trace_statistics", f"""
with e as (select user_id, case event_type when 'click' then 'tool_use' when 'signup' then 'session.compacted' when 'purchase' then 'text' else event_type end as type, k, value from ({EVENTS})),
 x as (select user_id, k, unnest(list_filter(['event:' || type, case when type = 'tool_use' then 'tool:bash:' || case when k < 20 then 'error' else 'completed' end end,
    case when contains(type, 'compact') then 'compaction' end, case when k = 99 then 'overflow' end, case when type = 'error' then 'error' end], lambda z: z is not null)) as kind from e)
select user_id, kind, count(*) as n, cast(sum(case when starts_with(kind, 'event:') then k * 2 else 0 end) as bigint) as prompt_tokens,
  cast(sum(case when starts_with(kind, 'event:') then 7 else 0 end) as bigint) as completion_tokens from x group by 1, 2
""")
def _(spark, root):
    kind = F.when(F.col("event_type") == "click", "tool_use").when(F.col("event_type") == "signup", "session.compacted").when(
        F.col("event_type") == "purchase", "text"
    ).otherwise(F.col("event_type"))
    k = F.col("k").cast("string")
    body = F.concat(
        F.lit('{"prompt_tokens": '), k, F.lit(', "input_tokens":'), k, F.lit(', "output_tokens": 7, "note": "'),
        F.when(F.col("k") == 99, "Maximum context length").otherwise(""), F.lit('"}'),
    )
    rows = spread(events(spark, root), "event_id").select(
        "user_id", kind.alias("type"), F.lit("bash").alias("tool"), F.when(F.col("k") < 20, "error").otherwise("completed").alias("status"),
        body.alias("body"),
    )
    return gd.trace_statistics(rows, "user_id", "type", "tool", "status", "body")


# --- grading --------------------------------------------------------------------------


@query("t17_log_statuses", """
with l as (select l_orderkey as run, case l_returnflag when 'R' then 'PASSED' when 'A' then 'FAILED' else 'SKIPPED' end as status, 'tests/t' || (l_linenumber % 3) || '.py::test_' || l_linenumber as node from lineitem)
select run, node, case when min(status) = max(status) then min(status) else 'CONFLICT' end as status, count(*) as n_lines from l group by 1, 2
""")
def _(spark, root):
    status = F.when(F.col("l_returnflag") == "R", "PASSED").when(F.col("l_returnflag") == "A", "FAILED").otherwise("SKIPPED")
    number = F.col("l_linenumber")
    node = F.concat(F.lit("tests/t"), (number % 3).cast("string"), F.lit(".py::test_"), number.cast("string"))
    first = F.concat(F.lit("\x1b[32m"), status, F.lit("\x1b[0m "), node, F.lit(" - detail of it"))
    last = F.concat(node, F.lit(" "), status, F.lit("   [ 12%]"))
    text = F.concat(F.lit("collected\n"), F.when(number % 2 == 0, first).otherwise(last), F.lit("\nend of log"))
    rows = spread(turns(spark, root), "l_partkey").select(F.col("l_orderkey").alias("run"), text.alias("log"))
    return gd.log_statuses(rows, ["run"], "log")


# Line items as phase reports: the phase from the line number, the outcome from the flag.
PHASES = """
select l_orderkey as run, 'n' || (l_partkey % 2) as nodeid, case l_linenumber % 3 when 0 then 'setup' when 1 then 'call' else 'teardown' end as "when",
  case when l_returnflag = 'A' and l_linestatus = 'F' then 'failed' when l_returnflag = 'N' and l_linestatus = 'F' then 'skipped' else 'passed' end as outcome, l_quantity > 40 as wasxfail from lineitem
"""


@query("t18_phase_statuses", f"""
with p as (select run, nodeid, count_if("when" = 'setup') as ns, count_if("when" = 'call') as nc, count_if("when" = 'teardown') as nt,
  max(outcome) filter (where "when" = 'setup') as s, max(outcome) filter (where "when" = 'call') as c, max(outcome) filter (where "when" = 'teardown') as t,
  coalesce(bool_or(wasxfail) filter (where "when" = 'setup'), false) as xs, coalesce(bool_or(wasxfail) filter (where "when" = 'call'), false) as xc from ({PHASES}) group by 1, 2)
select run, nodeid, case when greatest(ns, nc, nt) > 1 then 'CONFLICT' when s = 'failed' or t = 'failed' then 'ERROR' when c = 'failed' then 'FAILED'
  when s is null or coalesce(t <> 'passed', true) then 'MISSING' when s = 'skipped' then case when xs then 'XFAIL' else 'SKIPPED' end when c is null then 'MISSING'
  when c = 'skipped' then case when xc then 'XFAIL' else 'SKIPPED' end else case when xc then 'XPASS' else 'PASSED' end end as status from p
""")
def _(spark, root):
    n = F.col("l_linenumber") % 3
    outcome = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "failed").when(
        (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "skipped"
    ).otherwise("passed")
    rows = turns(spark, root).select(
        F.col("l_orderkey").alias("run"), F.concat(F.lit("n"), (F.col("l_partkey") % 2).cast("string")).alias("nodeid"),
        F.when(n == 0, "setup").when(n == 1, "call").otherwise("teardown").alias("when"), outcome.alias("outcome"),
        F.coalesce(F.col("l_quantity") > 40, F.lit(False)).alias("wasxfail"),
    )
    return gd.run_phase_statuses(rows, ["run"])


GO = f"""
select user_id as run, 'pkg' || (k % 3) as package, case when k % 7 = 0 then '' else 'Test' || (k % 20) end as test,
  case event_type when 'click' then 'run' when 'view' then 'run' when 'purchase' then 'pass' when 'error' then 'fail' else 'output' end as action, us, event_id from ({EVENTS})
"""


def go_events(spark, root):
    action = F.when(F.col("event_type").isin("click", "view"), "run").when(F.col("event_type") == "purchase", "pass").when(
        F.col("event_type") == "error", "fail"
    ).otherwise("output")
    return events(spark, root).select(
        F.col("user_id").alias("run"), F.concat(F.lit("pkg"), (F.col("k") % 3).cast("string")).alias("package"),
        F.when(F.col("k") % 7 == 0, "").otherwise(F.concat(F.lit("Test"), (F.col("k") % 20).cast("string"))).alias("test"),
        action.alias("action"), "us", "event_id",
    )


@query("t19_package_statuses", f"""
with p as (select run, package, test, count_if(action = 'run') as r, count_if(action in ('pass', 'fail')) as e,
  arg_max(action, (us, event_id)) as last_action, max(action) filter (where action in ('pass', 'fail')) as a from ({GO}) where test <> '' and action <> 'output' group by 1, 2, 3)
select run, package, test, case when r = 1 and e = 1 and last_action <> 'run' then case when a = 'pass' then 'PASSED' else 'FAILED' end when r = 1 and e = 0 then 'MISSING' else 'CONFLICT' end as status from p
""")
def _(spark, root):
    return gd.package_statuses(go_events(spark, root), ["run"], ORDER)


@query("t19_package_outcomes", f"""
select run, package, case when count(*) > 1 then 'CONFLICT' when max(action) = 'pass' then 'PASSED' else 'FAILED' end as status
from ({GO}) where test = '' and action in ('pass', 'fail') group by 1, 2
""")
def _(spark, root):
    return gd.package_outcomes(go_events(spark, root), ["run"])


@query("t20_collection_audit", f"""
with e as (select us // 3600000000 as run, case event_type when 'signup' then 'collection' when 'purchase' then 'session_finish' when 'error' then case when k < 30 then 'collection_error' else 'test' end else 'test' end as kind,
   case when k % 8 = 0 then 1 else 0 end as rc, k % 9 = 0 as bad from ({EVENTS})),
 p as (select run, count_if(kind = 'collection') as c, count_if(kind = 'session_finish') as f, count_if(kind = 'session_finish' and rc = 0) as f0, count_if(kind = 'collection_error') as x,
   count_if(kind = 'collection' and bad) as b from e group by 1)
select run, c = 1 and f = 1 and f0 = 1 and x = 0 and b = 0 as valid, case when c <> 1 or f <> 1 or f0 <> 1 or x > 0 then 'incomplete_or_failed' when b > 0 then 'invalid_or_duplicate_ids' end as cause from p
""")
def _(spark, root):
    kind = F.when(F.col("event_type") == "signup", "collection").when(F.col("event_type") == "purchase", "session_finish").when(
        (F.col("event_type") == "error") & (F.col("k") < 30), "collection_error"
    ).otherwise("test")
    name = F.concat(F.lit("n"), F.col("k").cast("string"))
    nodes = F.when(F.col("k") % 9 == 0, F.array(name, name)).otherwise(F.array(name, F.concat(name, F.lit("b"))))
    rows = events(spark, root).select(
        F.floor(F.col("us") / 3_600_000_000).alias("run"), kind.alias("kind"), nodes.alias("nodes"),
        F.when(F.col("k") % 8 == 0, 1).otherwise(0).alias("exitstatus"),
    )
    return gd.collection_audit(rows, ["run"])
