"""Exact tests on published counts."""

import math

import pytest
from pyspark.sql import functions as F

from rungauge.functions import stats
from rungauge.operators import evaluation

# lost, new, p, smallest detectable effect
PUBLISHED = [
    (23, 57, 0.0002, 20), (17, 46, 0.0003, 17), (21, 45, 0.0043, 18), (19, 43, 0.0032, 18), (27, 44, 0.0568, 19),
    (24, 43, 0.0271, 17), (14, 40, 0.0005, 16), (33, 31, 0.9007, 18), (39, 23, 0.0559, 18), (0, 0, 1.0, None),
]


def exact(b, c):
    n, k = b + c, min(b, c)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def test_published_counts(spark):
    df = spark.createDataFrame([(b, c) for b, c, _, _ in PUBLISHED], "b long, c long")
    rows = df.select("b", "c", stats.mcnemar_p(F.col("b"), F.col("c")).alias("p"), stats.smallest_detectable(F.col("b") + F.col("c")).alias("mde")).collect()
    for (b, c, p, mde), r in zip(PUBLISHED, rows):
        assert abs(round(r.p, 4) - p) <= 0.0001 and r.mde == mde, (b, c, r)


def test_against_exact_sums(spark):
    cases = [(b, c) for b in (0, 1, 2, 5, 40, 700, 3000) for c in (0, 1, 3, 50, 650, 3100)]
    rows = spark.createDataFrame(cases, "b long, c long").select(stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()
    for (b, c), r in zip(cases, rows):
        assert r.p == pytest.approx(exact(b, c), rel=1e-6, abs=1e-300), (b, c)


def test_large_counts_stay_bounded(spark):
    row = spark.createDataFrame([(500_000_000, 500_020_000)], "b long, c long").select(stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).first()
    z = 20_000 / math.sqrt(1_000_020_000)
    assert row.p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_t_tail(spark):
    # Tabulated two-sided 5 % points.
    points = [(12.706, 1), (4.303, 2), (3.182, 3), (2.776, 4), (2.228, 10), (2.086, 20), (1.984, 100)]
    rows = spark.createDataFrame(points, "t double, df int").select(stats.t_two_sided_p(F.col("t"), F.col("df")).alias("p")).collect()
    assert all(abs(r.p - 0.05) < 2e-4 for r in rows)


def test_two_proportions(spark):
    z = lambda pooled: spark.range(1).select(
        stats.two_proportion_z(F.lit(1031 / 1319), F.lit(1319), F.lit(825 / 1319), F.lit(1319), pooled)).first()[0]
    assert round(z(True), 2) == 8.78 and round(z(False), 2) == 8.91


def test_verdicts(spark):
    def verdict(only_a, only_b, both=200, neither=200):
        counts = spark.createDataFrame([(both + neither + only_a + only_b, both, only_a, only_b, neither, only_a + only_b)],
                                       "n_common long, n_both long, only_a long, only_b long, n_neither long, n_discordant long")
        return evaluation.verdict(counts).first().verdict

    assert [verdict(57, 23), verdict(33, 31), verdict(23, 57), verdict(31, 33), verdict(5, 5), verdict(57, 23, 10, 10)] == [
        "STOP", "CONTINUE_WARN", "GAIN", "CONTINUE_FLAT", "CONTINUE_FLAT", "INCOMPLETE"]


def test_trend_needs_three_points(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 1.0), ("b", 1, 2.0), ("b", 2, 3.5)], "run string, x int, y double")
    rows = {r.run: r for r in evaluation.trend(df, "x", "y", ["run"]).collect()}
    assert rows["a"].slope == 2.0 and rows["a"].se is None and rows["a"].verdict == "too_few_points"
    assert rows["b"].df == 1 and rows["b"].se == pytest.approx(0.1443, abs=1e-3)
