"""Streams over several micro-batches must equal the batch operators."""

import pytest
from pyspark.sql import functions as F

from rungauge.operators import monitor, sequences
from rungauge.plans import streams as plans
from rungauge.streaming import streams
from rungauge.streaming.state import ordered_fold, rocksdb

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in time order, cut into four files that arrive one by one."""
    path = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{ROOT}/events.parquet")
    cut = F.ntile(4).over(__import__("pyspark").sql.Window.orderBy("ts", "event_id"))
    numbered = events.withColumn("part", cut)
    for n in range(1, 5):
        numbered.where(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, parts):
    schema = spark.read.parquet(parts).schema
    return streams.file_stream(spark, parts, schema, files_per_batch=1)


def by_operators(spark):
    """The batch operators over the same events: what the folds must give."""
    rows = plans.requests(spark.read.parquet(f"{ROOT}/events.parquet").withColumn("at", F.col("ts")))
    kinds = sequences.client_segments(rows, "user_id", plans.ORDER, "kind", "task")
    runs = sequences.identical_runs(rows, ["user_id"], plans.ORDER, F.when(F.col("event_type") != "view", F.col("event_type")))
    steps = sequences.step_budget(rows, "user_id", plans.ORDER, F.col("event_type") == "signup", F.col("event_type") != "error", 8, 3)
    return kinds, runs.withColumn("loop", F.col("run_length") >= 3), steps


@pytest.mark.parametrize("which, fold, columns", [
    (0, plans.CLASSIFIER, ["event_id", "n_compact", "segment"]),
    (1, plans.GUARD, ["event_id", "run_length", "loop"]),
    (2, plans.BUDGET, ["event_id", "step", "budget_state"]),
])
def test_folds_equal_batch(spark, parts, which, fold, columns):
    timed = plans.requests(stream(spark, parts).withColumn("at", streams.event_time(F.col("ts"))))
    got = plans.folded(timed, *fold, "test").select(*columns)
    want = by_operators(spark)[which].select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_state_is_carried_and_order_of_arrival_does_not_matter(spark, tmp_path):
    """Rows in and out of order over three batches: a fold that numbers a key's rows and remembers the one before."""
    path, us = str(tmp_path / "rows"), 1_000_000
    schema = "k string, us long, i int, at timestamp"
    came = [[(5, 1), (1, 2)], [(90_000, 3), (3, 4)], [(200_000, 5), (100_000, 6), (None, 7)], [(100_000, 8)]]
    for wave in came:
        rows = [("a", s and s * us, i) for s, i in wave] + [(None, s and s * us, i) for s, i in wave]
        df = spark.createDataFrame(rows, "k string, us long, i int").withColumn("at", F.timestamp_micros("us"))
        df.coalesce(1).write.mode("append").parquet(path)

    def number(state, row):
        return ((state[0] or 0) + 1, row["i"]), ((state[0] or 0) + 1, state[1])

    rows = streams.file_stream(spark, path, schema, files_per_batch=1)
    out = plans.folded_by(rows, "k", ["us", "i"], "n long, i int", number, "n long, before int", "number", "1 day")
    got = {(r.k, r.i): (r.n, r.before) for r in out.collect()}
    # 8 comes after the watermark (200 000 s less a day) has not passed it, so it counts; 7 has no time.
    one = {2: (1, None), 4: (2, 2), 1: (3, 4), 3: (4, 1), 6: (5, 3), 8: (6, 6), 5: (7, 8)}
    assert got == {(k, i): v for k in ("a", None) for i, v in one.items()}


@pytest.mark.parametrize("buckets", [1, 3])
def test_keys_of_a_bucket_are_folded_apart(spark, tmp_path, buckets):
    """Keys share a bucket's place in the store, null among them, and each has its own state over the batches."""
    path, day = str(tmp_path / "rows"), 86_400_000_000
    for wave in range(3):
        rows = [(k, (wave * 5 + 1) * day - n, 10 * wave - n) for k in (1, 2, 3, None) for n in range(4)]
        spark.createDataFrame(rows, "k long, us long, i int").withColumn("at", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(path)

    def before(state, row):
        return (row["i"], (state[1] or 0) + 1), (state[0], (state[1] or 0) + 1)

    stream = streams.file_stream(spark, path, "k long, us long, i int, at timestamp", files_per_batch=1)
    with rocksdb(spark):
        out = streams.drain_whole(stream, lambda rows: ordered_fold(rows, "k", ["us"], "at", "1 day", "i int, n long", before, "before int, n long", buckets), "at")
    order = [10 * wave - n for wave in range(3) for n in (3, 2, 1, 0)]
    want = [(i, order[n - 1] if n else None, n + 1) for n, i in enumerate(order)]
    for key in (1, 2, 3, None):
        assert sorted((r.i, r.before, r.n) for r in out.where(F.col("k").eqNullSafe(F.lit(key))).collect()) == sorted(want)


def test_waves_have_equally_many_files(spark, tmp_path):
    """A wave of a large table is written by several tasks and is one batch, even where a wave has few rows."""
    events = spark.read.parquet(f"{ROOT}/events.parquet")
    few = events.orderBy("ts").limit(400).union(events.orderBy(F.desc("ts")).limit(1))
    few.write.parquet(str(tmp_path / "events.parquet"))
    files = spark.sparkContext.defaultParallelism
    waves = plans.late_waves(spark, str(tmp_path), small=0)
    got = plans.folded(plans.clients(waves, "at"), *plans.GUARD, "waves")
    assert got.count() == 401 and got.select("event_id").distinct().count() == 401
    counts = waves.groupBy().count().writeStream.outputMode("update").format("memory").queryName("waves_seen").trigger(availableNow=True).start()
    counts.awaitTermination()
    batches = [p["numInputRows"] for p in counts.recentProgress if p["sources"][0]["endOffset"] != p["sources"][0]["startOffset"]]
    assert len(batches) == 4 and batches[3] >= 1 and sum(batches) == 401 and files > 1


def test_windows_equal_batch(spark, parts):
    timed = stream(spark, parts).withColumn("at", streams.event_time(F.col("ts")))
    got = streams.drain(streams.sliding_counts(timed, "at", "3 hours", "1 hour", "1 day"))
    events = spark.read.parquet(f"{ROOT}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    want = {(r.w.start, r.n) for r in events.groupBy(F.window("at", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).collect()}
    rows = {(r.window_start, r.n) for r in got.collect()}
    assert rows and rows <= want  # closed windows only, each with its full count


def test_replayed_rows_pass_once(spark, parts):
    timed = stream(spark, parts).withColumn("at", streams.event_time(F.col("ts")))
    twice = timed.withColumn("_c", F.explode(F.array(F.lit(1), F.lit(2)))).select("event_id", "at")
    assert streams.drain(streams.once_per_id(twice, "event_id", "at", "40 days")).count() == 1000


def test_monitor_later_line_wins_and_alarms(spark, tmp_path):
    schema = ("run string, step int, response_length double, reward double, grad_norm double, groups_seen long, groups_zero_adv long, "
              "n_rollouts long, n_traced long, is_mean double, merge_mismatch_rows long, seq long")

    def rows(values, seq):
        return [("r", i + 1, v, 0.5, 1.0, 10, 1, 8, 8, 1.0, 0, seq + i) for i, v in enumerate(values)]

    path = str(tmp_path / "steps")
    spark.createDataFrame(rows([274.5, 254.8, 10.0], 0), schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame(rows([274.5, 254.8, 112.5, 60.4, 91.3], 100), schema).coalesce(1).write.mode("append").parquet(path)
    live = streams.LiveMonitor(monitor.judge, monitor.alarms, stop=False)
    health, alarms = live.run(streams.file_stream(spark, path, schema, files_per_batch=1), ["run", "step"], "seq")
    assert {r.step: r.response_length for r in health.collect()} == {1: 274.5, 2: 254.8, 3: 112.5, 4: 60.4, 5: 91.3}
    assert {(r.rule, r.step) for r in alarms.collect() if r.rule == 1} == {(1, 4), (1, 5)}
    # The run ends at its first stop-level alarm, step 4, in whatever batch, unless the monitor only records.
    spark.createDataFrame(rows([274.5, 254.8, 112.5, 60.4, 91.3, 80.0, 70.0], 200), schema).coalesce(1).write.mode("append").parquet(path)
    for stop, steps in ((True, 4), (False, 7)):
        live = streams.LiveMonitor(monitor.judge, monitor.alarms, stop=stop)
        health, _ = live.run(streams.file_stream(spark, path, schema, files_per_batch=1), ["run", "step"], "seq")
        assert health.count() == steps


def test_fold_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], "k string, us long, at timestamp").write.parquet(path)
    rows = streams.file_stream(spark, path, "k string, us long, at timestamp")
    assert plans.folded_by(rows, "k", ["us"], "n int", lambda s, r: ((1,), (1,)), "n int", "none", "1 day").count() == 0


def test_long_responses_are_joined_in_order(spark):
    n = 9000
    df = spark.range(n).select(
        F.lit("r").alias("response"), F.col("id").alias("i"), F.concat(F.col("id").cast("string"), F.lit(" ")).alias("part"),
        F.when(F.col("id") == 5, "tool_calls").when(F.col("id") == n - 2, "stop").alias("finish"), F.when(F.col("id") == 7, 3).alias("usage"))
    out = sequences.assemble_chunks(df, ["response"], ["i"], "part").first()
    assert out.text.split() == [str(i) for i in range(n)] and out.finish == "stop" and out.usage == 3 and out.n_chunks == n
