"""Sliced running values must equal plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rungauge.functions import ordered, ranks


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])
        ts = rng.randint(0, 50) if rng.random() < 0.5 else rng.randint(0, 100_000)
        data.append((key, ts, i, rng.choice([None, 1, 2, 3])))
    return spark.createDataFrame(data, "k string, ts long, id long, v int").repartition(5)


@pytest.mark.parametrize("target", [50, 400])
def test_sliced_equals_plain(rows, target):
    values = {
        "s": ("sum", F.col("v")), "n": ("sum", F.lit(1)), "mx": ("max", F.col("v")), "mn": ("min", F.col("v")),
        "la": ("last", F.col("v")), "fi": ("first", F.col("v")),
        "p": ("prev", F.col("v")), "nx": ("next", F.col("v")),
    }
    columns = ["id", *values]
    plain = ordered.running(rows, ["k"], ["ts", "id"], values).select(columns)
    sliced = ordered.running(rows, ["k"], ["ts", "id"], values, target_rows=target).select(columns)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, sliced.collect()), key=str)


def test_hot_group_is_cut(rows):
    cut = ordered.cut_hot_groups(rows, ["k"], ["ts", "id"], 100)
    sizes = cut.where("k = 'hot'").groupBy("_slice").count().collect()
    assert len(sizes) >= 5
    assert cut.count() == rows.count()


def test_ties_and_common_prefixes_are_cut(spark):
    rows = spark.range(2000).select(F.lit("k").alias("k"), F.lit(7).alias("ts"), F.format_string("image/same/prefix/%06d", F.col("id")).alias("name"))
    cut = ordered.cut_hot_groups(rows, ["k"], ["ts", "name"], 100).groupBy("_slice").agg(F.count("*").alias("n"), F.min("name").alias("a"), F.max("name").alias("b")).orderBy("_slice").collect()
    assert 15 <= len(cut) <= 20 and max(r.n for r in cut) <= 250
    assert all(x.b < y.a for x, y in zip(cut, cut[1:]))


def test_global_order_and_percentiles(rows):
    got = ranks.with_position(rows, [], ["ts", "id"], target_rows=200).select("id", "rn")
    want = rows.select("id", F.row_number().over(Window.orderBy("ts", "id")).cast("long").alias("rn"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    values = sorted(r.ts for r in rows.select("ts").collect())
    n = len(values)
    for options in ({}, {"target_rows": 100}):
        row = ranks.value_at(
            rows, [], "ts",
            {"card": ranks.index_card(0.9), "tail": ranks.index_tail(0.9), "half": ranks.index_half(),
             "rnd": ranks.index_round(0.9)}, **options,
        ).first()
        assert row["card"] == values[min(n - 1, int(0.9 * n))]
        assert row["tail"] == values[int(n * 0.9)]
        assert row["half"] == values[n // 2]
        assert row["rnd"] == values[round((n - 1) * 0.9)]


def test_runs(spark):
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate([True, True, False, True, True, True, False])],
                               "k int, i int, b boolean")
    for options in ({}, {"target_rows": 2}):
        out = ordered.Scan(df, ["k"], ["i"], **options).add_run("r", F.col("b")).rows().orderBy("i")
        assert [r.r for r in out.collect()] == [1, 2, 0, 1, 2, 3, 0]


def test_counted_rows_decide(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    stored = spark.read.parquet(path)
    for table in (stored, rows):
        assert ordered.Scan(table, ["k"], ["ts", "id"]).plain
        assert ordered.Scan(table, ["k"], ["ts", "id"], target_rows=3000).plain
        assert not ordered.Scan(table, ["k"], ["ts", "id"], target_rows=2999).plain
    # The estimate of bytes has no say in it.
    monkeypatch.setattr(ordered, "SMALL_BYTES", 10)
    assert ordered.Scan(stored, ["k"], ["ts", "id"]).plain and ordered.Scan(rows, ["k"], ["ts", "id"]).plain


def test_many_ordinary_groups_share_one_shuffle(spark, rows, tmp_path):
    """A large table without a large group is not cut: its steps share one shuffle, and nothing is written between them."""
    path = str(tmp_path / "rows")
    rows.withColumn("k", F.concat(F.coalesce("k", F.lit("")), (F.col("id") % 50).cast("string"))).write.parquet(path)
    stored = spark.read.parquet(path)
    scan = ordered.Scan(stored, ["k"], ["ts", "id"], target_rows=500)
    out = scan.add(a=("sum", F.col("v")), t=("total", F.col("v"))).add(b=("max", F.col("a"))).rows()
    assert not scan.plain and not scan.sliced
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    cut = ordered.Scan(stored, ["k"], ["ts", "id"], target_rows=20)
    again = cut.add(a=("sum", F.col("v")), t=("total", F.col("v"))).add(b=("max", F.col("a"))).rows()
    assert cut.sliced
    assert sorted(map(tuple, out.select("k", "ts", "id", "a", "b", "t").collect()), key=str) == sorted(map(tuple, again.select("k", "ts", "id", "a", "b", "t").collect()), key=str)
