"""Ordered logic: known values, and hot keys cut into slices give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from rungauge.operators import curation, joins, monitor, sequences


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    rng = random.Random(11)
    data = []
    for i in range(900):
        client = "hot" if rng.random() < 0.5 else rng.choice("abc")
        data.append((client, i * 7 + rng.randint(0, 3), i, rng.choice(["task", "compact", "post", "other"]), rng.choice("xy"),
                     rng.choice([None, "p", "q"]), rng.randint(0, 300)))
    path = str(tmp_path_factory.mktemp("calls") / "t")
    spark.createDataFrame(data, "client string, ts long, id long, kind string, task string, sig string, size int").write.parquet(path)
    return spark.read.parquet(path)


ORDER = ["ts", "id"]
CASES = {
    "sessions": lambda d, o: sequences.gap_sessions(d, ["client"], ORDER, "ts", 30, **o),
    "runs": lambda d, o: sequences.identical_runs(d, ["client"], ORDER, F.col("sig"), **o),
    "cycles": lambda d, o: sequences.periodic_cycles(d, ["client"], ORDER, F.col("task"), F.col("sig"), **o),
    "drops": lambda d, o: sequences.context_drops(d, ["client"], ORDER, "size", 100.0, **o),
    "segments": lambda d, o: sequences.client_segments(d, "client", ORDER, "kind", "task", **o),
    "budget": lambda d, o: sequences.step_budget(d, "client", ORDER, F.col("kind") == "task", F.col("kind") != "compact", 8, 3, **o),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_hot_client_gives_the_same_rows(calls, name):
    plain = CASES[name](calls, {})
    sliced = CASES[name](calls, {"target_rows": 60}).select(*plain.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, sliced.collect()))


def one_client(spark, signatures):
    return spark.createDataFrame([("c", i, s) for i, s in enumerate(signatures)], "client string, i int, s string")


def test_loop_needs_identical_calls(spark):
    df = one_client(spark, ["a", "a", "a", None, "a", "b", "b"])
    out = sequences.identical_runs(df, ["client"], ["i"], F.col("s")).orderBy("i").collect()
    assert [r.run_length for r in out] == [1, 2, 3, 0, 1, 1, 2]


def periods(spark, steps):
    df = spark.createDataFrame([("c", i, a, f) for i, (a, f) in enumerate(steps)], "client string, i int, a string, f string")
    out = sequences.periodic_cycles(df, ["client"], ["i"], F.col("a"), F.col("f")).orderBy("i").collect()
    return [r.period for r in out]


def test_cycles(spark):
    assert periods(spark, [("a", "0")] * 3) == [None, None, 1]
    assert periods(spark, [("a", "0"), ("b", "0")] * 3)[-1] == 2
    assert periods(spark, [("a", "0"), ("b", "0")] * 2 + [("a", "0")]) == [None] * 5
    assert periods(spark, [("a", "0"), ("a", "0"), ("a", None), ("a", "0"), ("a", "0")]) == [None] * 5
    assert periods(spark, [("a", "0"), ("a", "1"), ("a", "0")]) == [None] * 3


def test_interval_counts_match_brute_force(spark):
    rng = random.Random(5)
    events = [("hot" if rng.random() < 0.5 else "b", rng.randint(0, 200)) for _ in range(400)]
    spans = [(i, rng.choice(["hot", "b", "none"]), lo, lo + rng.randint(0, 60)) for i, lo in enumerate(rng.choices(range(200), k=60))]
    e = spark.createDataFrame(events, "k string, at long")
    s = spark.createDataFrame(spans, "id int, k string, lo long, hi long")
    for options in ({}, {"target_rows": 30}):
        out = joins.interval_counts(s, e, "id", "k", "lo", "hi", "k", "at", slack=1.0, **options).collect()
        want = {i: sum(k == ek and lo - 1 <= at <= hi + 1 for ek, at in events) for i, k, lo, hi in spans}
        assert {r.id: r.n_events for r in out} == want


def test_work_list_is_total_and_sharded(spark):
    tasks = [(f"t{i:03}", "hot" if i % 3 else "cold", i % 2, i) for i in range(90)] + [("t001", "dup", 0, 999)]
    df = spark.createDataFrame(tasks, "id string, image string, n int, line int")
    order = [t[0] for t in sorted(tasks[:90], key=lambda t: (t[1], t[2], t[0]))]
    for options in ({}, {"target_rows": 10}):
        got = []
        for shard in range(4):
            out = curation.work_list(df, "id", "image", "n", ["line"], shards=4, shard=shard, **options)
            got += [(r.place, r.id) for r in out.collect()]
        assert [i for _, i in sorted(got)] == order


def series(spark, values, column="response_length"):
    return spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(values)], f"run string, step int, {column} double")


def fired(df):
    return [r.step for r in df.where("fired").orderBy("step").collect()]


def test_collapse_fires_on_the_known_bad_run(spark):
    length = series(spark, [274.5, 254.8, 112.5, 60.4, 91.3])
    reward = series(spark, [0.548, 0.580, 0.138, 0.147, 0.235], "reward")
    assert fired(monitor.collapse(length, ["run"], "step", "response_length", 0.50, "fired")) == [4, 5]
    # The fifth reward is above 0.40 x baseline again.
    assert fired(monitor.collapse(reward, ["run"], "step", "reward", 0.40, "fired")) == [4]


def test_rules_stay_silent_on_a_steady_run(spark):
    steady = series(spark, [200.0 + (i % 3) for i in range(40)])
    assert fired(monitor.collapse(steady, ["run"], "step", "response_length", 0.50, "fired")) == []
    assert fired(monitor.drift(steady, ["run"], "step", "response_length", 0.55, "fired")) == []
    assert fired(monitor.spike(steady, ["run"], "step", "response_length", "fired")) == []


def test_missing_metric_is_never_zero(spark):
    gaps = series(spark, [200.0, 210.0, None, None, 205.0])
    assert fired(monitor.collapse(gaps, ["run"], "step", "response_length", 0.50, "fired")) == []
    # A missing gradient among the last two is the not-a-number rule.
    assert fired(monitor.spike(gaps, ["run"], "step", "response_length", "fired")) == [3, 4, 5]


def test_spike_needs_two_values_above_the_median(spark):
    base = [1.0] * 12
    assert fired(monitor.spike(series(spark, base + [50.0, 60.0]), ["run"], "step", "response_length", "fired")) == [14]
    assert fired(monitor.spike(series(spark, base + [50.0, 1.0, 60.0]), ["run"], "step", "response_length", "fired")) == []
