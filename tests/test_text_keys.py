"""Joins and counts by the digest of a text."""

from pyspark.sql import functions as F

from rungauge.operators import curation, joins


def test_purity_counts_by_digest(spark):
    train = spark.createDataFrame([("a", "x"), ("a", " "), (None, "y"), (None, None), ("b", "z")], "id string, text string")
    held = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    out = curation.purity(train, held, "id", "text").first()
    assert (out.n_rows, out.n_missing_ids, out.n_missing_texts, out.n_held_out, out.n_repeated_ids, out.clean) == (5, 2, 2, 2, 1, False)
    empty = curation.purity(train.limit(0), held.limit(0), "id", "text").first()
    assert (empty.n_rows, empty.n_repeated_ids, empty.clean) == (0, 0, True)
    plan = curation.purity(train, held, "id", "text")._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and not any("text" in line or "id#" in line for line in exchanged)


def test_hot_prompt_is_one_class(spark):
    n = 100_000
    left = spark.range(n).select("id", F.lit("same prompt").alias("prompt"))
    right = spark.range(n).select(F.col("id").alias("other"), F.lit(' "same prompt" ').alias("captured"), (F.col("id") + 0.5).alias("prompt"))
    out = joins.prompt_matches(left, "prompt", right, "captured", ["other"])
    assert out.agg(F.count("*").alias("n"), F.min("n_matches").alias("lo"), F.max("n_matches").alias("hi"), F.max("first_match.other").alias("f")).first() == (n, n, n, 0)
    lone = spark.createDataFrame([(1, None), (2, "")], "id int, prompt string")
    assert {(r.id, r.n_matches) for r in joins.prompt_matches(lone, "prompt", right, "captured", ["other"]).collect()} == {(1, 0), (2, 0)}


def test_nodes_resolve_by_digest(spark):
    asked = spark.createDataFrame([("a b",), ("a b",), ("c",), ("d",), ("e",), ("f g",), ("f",), (None,)], "node string")
    known = spark.createDataFrame([("a b",), ("c x",), ("c x",), ("d x",), ("d y",), ("f g",), (None,)], "full string")
    got = {(r.node, r.full, r.state) for r in joins.resolve_nodes(asked, known, "node", "full").collect()}
    assert got == {
        ("a b", "a b", "exact"), ("c", "c x", "truncated"), ("d", None, "ambiguous"), ("e", None, "unavailable"),
        ("f g", "f g", "shared"), ("f", "f g", "shared"), (None, None, "unavailable"),
    }


def paired(left, right, how, **options):
    out = joins.by_prompt_hash(left, "prompt", right, "captured", how, **options)
    return sorted(out.drop("prompt", "prompt_key").collect(), key=repr)


def test_pairs_of_a_hot_prompt_in_blocks(spark):
    left = spark.createDataFrame([(i, p) for i, p in enumerate(["hot"] * 5 + ["cold", "alone", None, '"said"', "said"])], "id int, prompt string")
    rows = [(i, "hot") for i in range(40)] + [(7, "hot")] * 9 + [(50, "cold"), (50, "cold"), (None, "hot"), (51, None), (52, "other"), (53, "said"), (54, '"\\"said\\""')]
    right = spark.createDataFrame(rows, "other int, captured string")
    for how in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        assert paired(left, right, how, paired_rows=3) == paired(left, right, how)
    got = [(r.id, r.other) for r in paired(left, right, "left", paired_rows=3)]
    hot = [other for other, text in rows if text == "hot"]
    want = [(i, other) for i in range(5) for other in hot] + [(5, 50), (5, 50), (6, None), (7, None), (8, 54), (9, 53)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # One block holds every copy of one row, so the prompt's other blocks are empty.
    copies = spark.createDataFrame([(1, "hot")] * 20, "other int, captured string")
    assert paired(left.limit(5), copies, "left", paired_rows=3) == paired(left.limit(5), copies, "inner")
    assert len(paired(left.limit(5), copies, "left", paired_rows=3)) == 100


def test_hot_pairs_are_made_in_many_tasks(spark):
    n, setting = 1000, "spark.sql.autoBroadcastJoinThreshold"
    left = spark.range(n).select("id", F.lit("same prompt").alias("prompt"))
    right = spark.range(n).select(F.col("id").alias("other"), F.lit('"same prompt"').alias("captured"))
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        out = joins.by_prompt_hash(left, "prompt", right, "captured", paired_rows=100)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.select("id", "other").distinct().count() == out.count() == n * n
    finally:
        spark.conf.set(setting, before)
    assert any("Exchange hashpartitioning" in line and "_block#" in line for line in plan.splitlines())


def test_prompt_hash_gives_every_pair(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    turns = [(0, "system", "s"), (1, "user", "same"), (2, "user", "same"), (3, "assistant", "same"), (4, "user", "other"), (5, "user", None), (6, "user", '"same"')]
    rows = [(conv, turn, role, text) for conv in range(3) for turn, role, text in turns] + [(2, 4, "user", "other")]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    users = [(conv, turn, text) for conv, turn, role, text in rows if role == "user"]
    want = []
    for conv, turn, text in users:
        met = [(c, t) for c, t, other in users if text is not None and other == text]
        want += [(conv, turn, *pair, len(met), *min(met)) for pair in met] or [(conv, turn, None, None, 0, None, None)]
    names = ["conv_id", "turn", "other_conv", "other_turn", "n_matches", "first_conv", "first_turn"]
    got = entry.queries()["j02_prompt_hash"](spark, folder).select(names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    connection = duckdb.connect()
    connection.execute(f"create view conversations as select * from read_parquet('{folder}/conversations.parquet/*.parquet')")
    sql = connection.execute(f"select {', '.join(names)} from ({entry.oracle_sql()['j02_prompt_hash']})").fetchall()
    assert sorted(sql, key=repr) == sorted(want, key=repr)
