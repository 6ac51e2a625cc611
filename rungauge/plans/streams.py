"""Streaming queries: the events folder as a stream, drained and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungauge.functions import times
from rungauge.functions.ordered import is_small
from rungauge.operators import evaluation as ev
from rungauge.operators import monitor as mo
from rungauge.operators import sequences as sq
from rungauge.plans import bindings as b
from rungauge.plans.evaluation import CALLS
from rungauge.plans.monitor import REPLAY
from rungauge.plans.registry import query
from rungauge.plans.sequences import ANSWER_SQL, KIND_SQL, ORDER, RUNS, SEGMENTS, answer_line, written_calls
from rungauge.session import SPREAD_BYTES, table
from rungauge.shared import fresh_folder
from rungauge.streaming import streams as st
from rungauge.streaming.state import ordered_fold, rocksdb


def event_stream(spark, root):
    """The events table as a file stream."""
    schema = table(spark, root, "events").schema
    return st.file_stream(spark, root, schema, "events.parquet").withColumn("at", st.event_time(F.col("ts")))


def clients(stream, *more):
    """Stream rows with what the ordered operators look at."""
    return stream.select(
        *more,
        "event_id", "user_id", times.epoch_micros(F.col("ts")).alias("us"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


@query("r05_capture_stream", f"""
select batch as day, count(*) as n_calls, count_if(outcome = 'kept') as n_kept, count_if(outcome = 'error') as n_error, count_if(outcome = 'no_ids') as n_no_ids,
  round(count_if(outcome = 'kept') / count(*), 6) as rate, count_if(outcome = 'kept') / count(*) < 0.7 as below from ({CALLS}) group by 1
""")
def _(spark, root):
    k = F.get_json_object("props", "$.k").cast("int")
    outcome = ev.capture_outcome(F.col("event_type"), F.when(F.col("value") > 300, 500).otherwise(200), k >= 5)
    calls = event_stream(spark, root).select("at", outcome.alias("outcome"))
    out = st.drain_whole(calls, lambda c: st.capture_rates(c, "at", "outcome", "1 day", "1 day", 0.7), "at", "capture")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n_calls", "n_kept", "n_error", "n_no_ids", F.round("rate", 6).alias("rate"), "below")


@query("r06_sliding_throughput", """
with w as (select time_bucket(interval 1 hour, ts) - i * interval 1 hour as s from events, range(0, 3) t(i))
select strftime(s, '%Y-%m-%d %H:%M') as window_start, count(*) as n from w group by s
""")
def _(spark, root):
    out = st.drain_whole(event_stream(spark, root), lambda e: st.sliding_counts(e, "at", "3 hours", "1 hour", "1 day"), "at", "sliding")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n")


@query("r10_tumbling_windows", """
select strftime(time_bucket(interval 6 hour, ts), '%Y-%m-%d %H:%M') as window_start, count(*) as n from events group by time_bucket(interval 6 hour, ts)
""")
def _(spark, root):
    out = st.drain_whole(event_stream(spark, root), lambda e: st.sliding_counts(e, "at", "6 hours", "6 hours", "1 day"), "at", "tumbling")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n")


@query("r09_session_stream", """
with g as (select *, ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 2 hour as gap from events),
 s as (select *, sum(case when gap then 1 else 0 end) over (partition by user_id order by ts, event_id) as n from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, count(*) as n from s group by user_id, s.n
""")
def _(spark, root):
    out = st.drain_whole(event_stream(spark, root), lambda e: st.gap_session_stream(e, "user_id", "at", "2 hours", "1 day"), "at", "sessions")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("r07_replayed_events", "select event_type, count(*) as n, count(distinct event_id) as n_ids from events group by 1")
def _(spark, root):
    # Every event arrives twice; the second copy is dropped.
    twice = event_stream(spark, root).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).select("event_id", "event_type", "at")
    out = st.drain(st.once_per_id(twice, "event_id", "at", "40 days"), label="once")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


def late_waves(spark, root, waves=4, jitter_hours=20, small=SPREAD_BYTES):
    """The events in waves that arrive one by one; a row may come up to ``jitter_hours`` after its time, so neighbours overlap.

    A wave is one micro-batch: as many files as any other wave, one if the table is small.
    """
    folder = fresh_folder(spark, "event-waves")
    rows = table(spark, root, "events")
    files = 1 if is_small(rows, small) else spark.sparkContext.defaultParallelism
    us = times.epoch_micros(F.col("ts"))
    came = us + F.pmod(F.xxhash64("event_id"), F.lit(jitter_hours * 3_600_000_000))
    first, last = rows.agg(F.min(came), F.max(came)).first()
    wave = F.floor((came - first) * waves / F.lit(last - first + 1)) if first is not None else F.lit(0)
    nothing = spark.createDataFrame([], rows.schema)
    for n in range(waves):  # a file source takes files by their time of writing
        rows.where(wave == n).repartition(files).write.mode("append").parquet(folder)
        written = len(spark.read.schema(rows.schema).parquet(folder).inputFiles())
        for _ in range((n + 1) * files - written):  # a task without rows writes no file
            nothing.write.mode("append").parquet(folder)
    return st.file_stream(spark, folder, rows.schema, files_per_batch=files).withColumn("at", st.event_time(F.col("ts")))


def folded_by(stream, key, order, state, fold, out, label, lateness):
    """``fold`` over each key's rows in the order of their time, drained to the end."""
    whole = lambda rows: ordered_fold(rows, key, order, "at", lateness, state, fold, out)
    with rocksdb(stream.sparkSession):
        return st.drain_whole(stream, whole, "at", label)


def folded(stream, state, fold, out, label):
    return folded_by(stream, "user_id", ORDER, state, fold, out, label, "2 days")


def classify(state, row):
    """The segment of one request, and the client's task and compactions after it."""
    task, n = state[0], state[1] or 0
    kind = row["kind"]
    if kind == "task":
        n = n if row["task"] == task else 0
        task = row["task"] if row["task"] is not None else task
    if task is None:
        return (None, 0), (0, "unknown")
    n += kind == "compact"
    name = {"task": "task", "compact": f"compact{n}", "post": f"post{max(n, 1)}"}.get(kind, "other")
    return (task, n), (n, name)


CLASSIFIER = ("s_task string, s_compact bigint", classify, "n_compact bigint, segment string")


@query("r02_session_classifier", f"select event_id, user_id, n_compact, segment from ({SEGMENTS})")
def _(spark, root):
    rows = requests(late_waves(spark, root))
    return folded(rows, *CLASSIFIER, "classifier").select("event_id", "user_id", "n_compact", "segment")


def requests(stream):
    return clients(stream, "at").select("*", F.expr(KIND_SQL).alias("kind"), F.md5(F.floor(F.col("k") / 50).cast("string")).alias("task"))


def guard(state, row):
    """How often a client's call has come in a row, and whether that is a loop; a view has no signature."""
    signature = None if row["event_type"] == "view" else row["event_type"]
    length = 0 if signature is None else (state[1] or 0) + 1 if signature == state[0] else 1
    return (signature, length), (length, length >= 3)


GUARD = ("s_signature string, s_length bigint", guard, "run_length bigint, loop boolean")


@query("r03_episode_guard", f"select event_id, user_id, run_length, run_length >= 3 as loop from ({RUNS})")
def _(spark, root):
    return folded(clients(late_waves(spark, root), "at"), *GUARD, "guard").select("event_id", "user_id", "run_length", "loop")


def budgeted(state, row, budget=8, warn=3):
    """The step since the last signup and what is left of the budget; an error is no step."""
    step = state[0] or 0
    if row["event_type"] == "error":
        return (step,), (step, None)
    step = 1 if row["event_type"] == "signup" else step + 1
    name = "over" if step > budget else "used_up" if step == budget else "warn" if step >= budget - warn else "ok"
    return (step,), (step, name)


BUDGET = ("s_step bigint", budgeted, "step bigint, budget_state string")


@query("r04_step_budget", """
with e as (select event_id, user_id, epoch_us(ts) as us, event_type from events),
 n as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by us, event_id) as isl from e),
 s as (select *, count_if(event_type <> 'error') over (partition by user_id, isl order by us, event_id) as step from n)
select event_id, step, case when event_type <> 'error' then case when step > 8 then 'over' when step >= 8 then 'used_up' when step >= 5 then 'warn' else 'ok' end end as budget_state from s
""")
def _(spark, root):
    return folded(clients(late_waves(spark, root), "at"), *BUDGET, "budget").select("event_id", "step", "budget_state")


@query("r01_live_monitor", f"""
with s as ({b.STEPS}) select run, count(*) as n_health from s group by 1
""")
def _(spark, root):
    health, _ = monitor_tables(spark, root)
    return health.groupBy("run").agg(F.count("*").alias("n_health"))


def monitor_tables(spark, root, stop=False):
    """The step series written in two waves, the second with corrected lines, then watched."""
    series = b.steps(spark, root)
    path = fresh_folder(spark, "steps")
    wrong = series.where("step % 3 = 0").withColumn("reward", F.lit(0.0)).withColumn("seq", F.col("step").cast("long"))
    right = series.withColumn("seq", F.col("step").cast("long") + 1_000_000)
    wrong.repartition(1).write.parquet(path)
    right.repartition(1).write.mode("append").parquet(path)
    stream = st.file_stream(spark, path, right.schema, "*.parquet", files_per_batch=1)
    return st.LiveMonitor(mo.judge, mo.alarms, stop=stop).run(stream, ["run", "step"], "seq")


@query("r01_monitor_alarms", f"select run, rule, severity, n_steps from ({REPLAY})")
def _(spark, root):
    """Alarms of the watched runs as last judged, per rule: those of a replay of the corrected series."""
    _, alarms = monitor_tables(spark, root)
    return alarms.groupBy("run", "rule", "severity").agg(F.count("*").alias("n_steps"))


@query("r01_monitor_stop", f"""
with s as ({b.STEPS}), r as (select run, min(first_step) as e from ({REPLAY}) where severity = 'stop' group by 1)
select s.run, count(*) as n_health, max(s.step) as last_step, max(r.e) as ended_at from s left join r using (run) where r.e is null or s.step <= r.e group by 1
""")
def _(spark, root):
    """A run ends at its first stop-level alarm, inside a batch too."""
    health, alarms = monitor_tables(spark, root, stop=True)
    ends = alarms.where("severity = 'stop'").groupBy("run").agg(F.max("step").alias("ended_at"))
    return health.groupBy("run").agg(F.count("*").alias("n_health"), F.max("step").alias("last_step")).join(ends, "run", "left")


@query("r08_chunk_stream", """
select user_id, epoch_us(ts) // 86400000000 as response, string_agg(event_type, '' order by ts, event_id) as text, count(*) as n_chunks from events group by 1, 2
""")
def _(spark, root):
    # Chunks land in a table as they stream in; responses are put together from it.
    rows = clients(event_stream(spark, root)).select(
        "user_id", F.floor(F.col("us") / 86_400_000_000).alias("response"), "us", "event_id", F.col("event_type").alias("part"),
        F.lit(None).cast("string").alias("finish"), F.lit(None).cast("int").alias("usage"),
    )
    landed = st.drain(rows, label="chunks")
    return sq.assemble_chunks(landed, ["user_id", "response"], ORDER, "part").select("user_id", "response", "text", "n_chunks")


def event_files(spark, root, parts, files_per_batch, small=SPREAD_BYTES):
    """The events table in several files, so that a stream takes them in several micro-batches.

    A large table has more files, and a batch as many more: the batches stay as many, each read by several tasks.
    """
    folder = fresh_folder(spark, "event-files")
    rows = table(spark, root, "events")
    more = 1 if is_small(rows, small) else spark.sparkContext.defaultParallelism
    rows.repartition(parts * more, "event_id").write.parquet(folder)
    return st.file_stream(spark, folder, rows.schema, files_per_batch=files_per_batch * more).withColumn("at", st.event_time(F.col("ts")))


@query("r08_message_stream", ANSWER_SQL)
def _(spark, root):
    """Messages put together by Spark's own state, from files whose order says nothing."""
    lines = event_files(spark, root, 6, files_per_batch=2).select("at", "user_id", "event_id", "event_type", times.epoch_micros(F.col("ts")).alias("us"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    lines = lines.select("at", "user_id", *ORDER, answer_line().alias("line"))
    whole = lambda rows: st.message_parts(sq.chunk_deltas(rows, ["at", "user_id"], ORDER, "line"), ["user_id"], "at", "1 day", "3650 days", ORDER)
    parts = st.drain_whole(lines, whole, "at", "messages").withColumn("response", F.floor(F.unix_seconds("window_start") / 86_400)).drop("window_start")
    return written_calls(sq.messages_of_parts(parts, ["user_id", "response"]))
