"""Group signal and batches on known values."""

from pyspark.sql import functions as F

from rungauge.operators import batches, groups, monitor


def rows(spark, scores, uids):
    return spark.createDataFrame([(i, u, s) for i, (s, u) in enumerate(zip(scores, uids))], "rid int, uid string, score double")


def test_zero_variance_groups(spark):
    out = groups.mark_zero_variance(rows(spark, [1.0, 0.0, 1.0, 1.0, 0.0, 0.0], "aabbcc"), ["uid"], "score")
    assert sorted(r.rid for r in out.where("not zero_adv").collect()) == [0, 1]
    counts = groups.zero_variance_counts(out, ["uid"], "score").first()
    assert (counts.n_groups, counts.n_zero, counts.n_rows_kept) == (3, 2, 2)
    out = groups.zero_variance_counts(rows(spark, [1.0, 0.0, 0.0, -0.2], "aabb"), ["uid"], "score").first()
    assert (out.n_groups, out.n_zero, out.n_rows_kept) == (2, 0, 4)


def test_round_metrics_merge(spark):
    data = [(1, "training/n_rollouts", 32.0), (1, "training/reward", 0.1), (1, "x", 1.0),
            (2, "training/n_rollouts", 32.0), (2, "training/reward", 0.3), (2, "x", 2.0)]
    out = monitor.merge_round_metrics(spark.createDataFrame(data, "round int, name string, v double"), [], "name", "round", "v")
    assert {r.name: r.value for r in out.collect()} == {"training/n_rollouts": 64.0, "training/reward": 0.3, "x": 2.0}


def test_mini_batch_fit(spark):
    cases = [(66, 32, None, 0, 30), (64, 32, None, 0, 0), (5, 32, None, 0, 27), (0, 32, None, 0, 0), (227, 32, 7, 3, 0), (227, 32, 16, 0, 29)]
    for n, size, cap, drop, pad in cases:
        out = batches.mini_batch_fit(spark.createDataFrame([(n,)], "n long"), "n", size, cap).first()
        assert (out.n_drop, out.n_pad) == (drop, pad), (n, size, cap)


def test_neutral_padding_moves_no_group(spark):
    base = rows(spark, [1.0, 0.0, 1.0], "aab").withColumn("batch", F.lit(0))
    out = batches.neutral_padding(base, ["batch"], "rid", "uid", "score", 8)
    assert out.count() == 8
    pads = out.where("is_pad").collect()
    assert len(pads) == 5 and {p.score for p in pads} == {0.0} and len({p.uid for p in pads}) == 5
    kept = sorted((r.rid, r.uid, r.score) for r in out.where("not is_pad").collect())
    assert kept == [("0", "a", 1.0), ("1", "a", 0.0), ("2", "b", 1.0)]


def test_same_reward_rows_leave_first(spark):
    marked = groups.mark_zero_variance(rows(spark, [1.0, 0.0] * 3 + [0.0] * 4, "aabbccdddd").withColumn("batch", F.lit(0)), ["uid"], "score")
    out = batches.drop_to_fit(marked, ["batch"], "rid", "zero_adv", 4, 1)
    gone = out.where("drop_reason is not null")
    assert gone.count() == 6
    assert gone.where("drop_reason = 'same_reward'").count() == 4


def test_shuffle_is_a_permutation_with_aligned_columns(spark):
    base = spark.range(200).select(F.col("id").alias("rid"), (F.col("id") * 2).alias("twice"), F.lit(0).alias("batch"))
    out = batches.shuffled(base, "s", "rid", ["batch"])
    got = out.orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 201))
    assert all(r.twice == 2 * r.rid for r in got) and [r.rid for r in got] != list(range(200))


def test_penalties(spark):
    one = spark.range(1)
    turn = lambda r, n, train=True: one.select(groups.turn_penalty(F.lit(r), F.lit(n), 40, 25, 0.2, F.lit(train))).first()[0]
    assert [turn(1.0, 20), turn(1.0, 40), turn(1.0, 40, False), turn(0.0, 40)] == [1.0, 0.8, 1.0, 0.0]
    prompt = lambda r, n, solved: one.select(groups.prompt_penalty(F.lit(r), F.lit(n), 30000, 40960, 0.2, F.lit(True), F.lit(solved))).first()[0]
    assert [prompt(1.0, 40960, True), prompt(0.0, 40960, False), prompt(1.0, 30000, True)] == [0.8, 0.0, 1.0]


def test_median_length_reward(spark):
    data = [("a", 1.0, 10), ("a", 1.0, 20), ("a", 1.0, 400), ("a", 0.0, 1), ("b", 0.0, 5), ("c", 1.0, 0)]
    df = spark.createDataFrame(data, "uid string, reward double, len long")
    out = groups.median_length_reward(df, ["uid"], "reward", "len")
    got = {(r.uid, r.len): r.shaped for r in out.collect()}
    assert got == {("a", 10): 1.0, ("a", 20): 1.0, ("a", 400): 0.1, ("a", 1): 0.0, ("b", 5): 0.0, ("c", 0): 1.0}


def test_single_row_group_has_no_advantage(spark):
    out = groups.group_advantage(rows(spark, [1.0, 0.0, 1.0], "aab"), ["uid"], "score").orderBy("rid").collect()
    assert out[2].advantage == 0.0 and round(out[0].advantage, 4) == 0.7071 and out[0].advantage == -out[1].advantage


def test_quota_rounds(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([2, 3, 4, 5])], "run string, round int, v long")
    assert groups.quota_rounds(df, ["run"], "round", "v", 5, 10).count() == 2
    assert groups.quota_rounds(df, ["run"], "round", "v", 100, 3).count() == 3
