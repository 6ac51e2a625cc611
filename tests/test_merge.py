"""Turn merge on known token arrays, and against a brute-force fold."""

import random

import pytest
from pyspark.sql import functions as F

from rungauge.functions import arrays
from rungauge.functions.codec import PieceCodec, continuation_of
from rungauge.operators import merge
from rungauge.shared import cut_lineage

SCHEMA = "rollout string, turn int, prompt array<int>, response array<int>, logp array<double>"


def turns(spark, *rollouts):
    data = [(r, i, p, s, [-0.1] * len(s)) for r, pairs in rollouts for i, (p, s) in enumerate(pairs)]
    return spark.createDataFrame(data, SCHEMA)


def rows_of(df, max_prompt, max_response, codec=None, fill=False, policy="split", **options):
    links = merge.continuity(df, ["rollout"], "turn", codec, fill, **options)
    merged = merge.merged_rows(links, ["rollout"], "turn", max_prompt, max_response, policy, **options)
    rows = merge.training_rows(merged, df, ["rollout"], "turn", max_prompt, max_response, links, fill, **options).orderBy("rollout", "row_start").collect()
    return rows, merge.merge_metrics(merged, ["rollout"]).first()


CHAIN = ("c", [([1], [2]), ([1, 2, 3], [4]), ([1, 2, 3, 4, 5], [6]), ([1, 2, 3, 4, 5, 6, 7], [8])])


def test_budget_opens_a_new_row(spark):
    rows, m = rows_of(turns(spark, CHAIN), 8, 3)
    assert [r.response for r in rows] == [[2, 3, 4], [6, 7, 8]]
    assert [r["mask"] for r in rows] == [[1, 0, 1], [1, 0, 1]]
    assert [r.prompt for r in rows] == [[1], [1, 2, 3, 4, 5]]
    assert (m.n_budget_splits, m.n_merge_mismatch_rows, m.n_unmerged_rollouts) == (1, 0, 0)


def test_blocked_split_truncates_and_counts(spark):
    rows, m = rows_of(turns(spark, CHAIN), 4, 3)
    assert [r.response for r in rows] == [[2, 3, 4]] and rows[0].truncated
    assert (m.n_budget_splits, m.n_budget_splits_blocked) == (0, 2)


def test_break_policies(spark):
    df = turns(spark, ("bad", [([1], [2]), ([9], [3])]), ("good", [([4], [5]), ([4, 5, 6], [7])]))
    rows, m = rows_of(df, 50, 50)
    assert [(r.rollout, r.response) for r in rows] == [("bad", [2]), ("bad", [3]), ("good", [5, 6, 7])] and m.n_merge_mismatch_rows == 1
    rows, _ = rows_of(df, 50, 50, policy="drop")
    assert [(r.rollout, r.response) for r in rows] == [("good", [5, 6, 7])]
    rows, _ = rows_of(df, 50, 50, policy="keep_terminal")
    assert [(r.rollout, r.response) for r in rows] == [("bad", [3]), ("good", [5, 6, 7])]


def test_missing_prompt_is_rebuilt(spark):
    df = merge.fill_prompts(turns(spark, ("r", [([1], [2]), ([], [3]), ([], [4])])), ["rollout"], "turn")
    assert [r.prompt for r in df.orderBy("turn").collect()] == [[1], [1, 2], [1, 2, 3]]
    rows, _ = rows_of(df, 50, 50)
    assert [r.response for r in rows] == [[2, 3, 4]] and rows[0]["mask"] == [1, 1, 1]


def test_reward_placement(spark):
    rows, _ = rows_of(turns(spark, ("r", [([1], [2]), ([1, 2, 3], [4])])), 50, 50)
    df = spark.createDataFrame([(rows[0]["mask"], 0.75)], "mask array<int>, reward double")
    assert merge.place_rewards(df, "reward", True).first().scores == [0.0, 0.0, 0.75]
    # The last response is empty: the reward falls on the last sampled token, not on the observation.
    df = spark.createDataFrame([([1, 1, 0], 0.5)], "mask array<int>, reward double")
    assert merge.place_rewards(df, "reward", True).first().scores == [0.0, 0.5, 0.0]
    assert merge.place_rewards(df, "reward", False).first().scores == [0.0, 0.0, 0.5]
    assert [round(x, 3) for x in rows[0].logp] == [-0.1, 0.0, -0.1]


def test_advantages_skip_observations(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 0.0, 1.0], [0.2, 100.0, -200.0, 300.0, 0.4], [1, 0, 0, 0, 1])],
                               "r array<double>, v array<double>, m array<int>")
    out = df.select(arrays.advantages(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.8).alias("g")).first().g
    assert out[0]["return"] == pytest.approx(0.792)
    out = df.select(arrays.advantages(F.col("r"), F.col("v"), F.col("m"), 1.0, 1.0).alias("g")).first().g
    assert out[0]["return"] == pytest.approx(1.0) and out[4]["return"] == pytest.approx(1.0)


def test_divergence(spark):
    data = [([1, 2, 3], [1, 2, 9]), ([1, 2, 3], [1, 2]), ([1, 2], [1, 2, 3]), ([7], [8])]
    out = merge.divergence(spark.createDataFrame(data, "a array<int>, b array<int>"), "a", "b").collect()
    assert [(r.diverge_index, r.diverge_kind) for r in out] == [(2, "token_differs"), (2, "ran_out"), (2, "ran_out"), (0, "token_differs")]


def brute(pairs, max_prompt, max_response):
    """Rows (start, prompt, response, mask) by a plain loop over the turns of one rollout."""
    rows, context, current = [], None, None
    for t, (prompt, response) in enumerate(pairs):
        if context is not None and prompt[: len(context)] == context:
            seen = prompt[len(context):]
            if len(current[2]) + len(seen) + len(response) > max_response and len(prompt) <= max_prompt:
                rows.append(current)
                current = [t, prompt, list(response), [1] * len(response)]
            else:
                current[2] += seen + response
                current[3] += [0] * len(seen) + [1] * len(response)
        else:
            if current:
                rows.append(current)
            current = [t, prompt, list(response), [1] * len(response)]
        context = prompt + response
    rows.append(current)
    return [(s, p[:max_prompt], r[:max_response], m[:max_response]) for s, p, r, m in rows]


def filled(pairs):
    """Empty later prompts written out, by a plain loop."""
    out = []
    for prompt, response in pairs:
        out.append((out[-1][0] + out[-1][1] if not prompt and out else prompt, response))
    return out


@pytest.mark.parametrize("limits,options", [((1000, 1000), {}), ((12, 6), {}), ((30, 9), {"target_rows": 9})])
def test_empty_prompts_are_filled_on_the_way_as_when_written_out(spark, options, limits):
    rng = random.Random(limits[0])
    rollouts = []
    for name in range(25):
        pairs, context = [], [rng.randint(1, 9)]
        for _ in range(rng.choice([1, 4, 12])):
            lost = rng.random() < 0.5
            prompt = context if lost else context + [rng.randint(1, 9) for _ in range(rng.randint(0, 2))]
            if not lost and rng.random() < 0.2:
                prompt = [0, *prompt[1:]]
            response = [rng.randint(1, 9) for _ in range(rng.randint(1, 3))]
            pairs.append(([] if lost else prompt, response))
            context = (prompt if not lost or len(pairs) > 1 else []) + response
        rollouts.append((str(name), pairs))
    df = turns(spark, *rollouts)
    want = {(name, s): (p, r, m) for name, pairs in rollouts for s, p, r, m in brute(filled(pairs), *limits)}
    rows, _ = rows_of(df, *limits, fill=True, **options)
    assert {(r.rollout, r.row_start): (r.prompt, r.response, r["mask"]) for r in rows} == want
    written = merge.fill_prompts(df, ["rollout"], "turn", **options)
    assert {(r.rollout, r.turn): r.prompt for r in written.collect()} == {(n, i): p for n, pairs in rollouts for i, (p, _) in enumerate(filled(pairs))}


def test_ten_thousand_empty_prompts_in_a_row(spark):
    pairs = [([1], [2])] + [([], [3] if i % 50 == 0 else []) for i in range(10_000)]
    whole = [1, 2] + [3] * 200
    pairs += [(whole + [7], [8]), (whole[:-1] + [9, 7, 8], [5])]
    df = turns(spark, ("r", pairs))
    rows, m = rows_of(df, 50_000, 50_000, fill=True)
    assert [r.response for r in rows] == [whole[1:] + [7, 8], [5]] and m.n_merge_mismatch_rows == 1
    sizes = {r.turn: r.n for r in merge.fill_prompts(df, ["rollout"], "turn").selectExpr("turn", "size(prompt) as n").collect()}
    assert [sizes[t] for t in (0, 1, 2, 51, 52, 10_000)] == [1, 2, 3, 3, 4, 202]


def windows(plan):
    """Column names that enter each window of a plan."""
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    own = [{a.name() for a in (plan.child().output().apply(i) for i in range(plan.child().output().size()))}] if plan.nodeName() == "Window" else []
    return own + [w for child in children for w in windows(child)]


def test_ids_stay_out_of_windows(spark, monkeypatch):
    written, cut = [], merge.cut_lineage
    monkeypatch.setattr(merge, "cut_lineage", lambda df, label: (written.append(df), cut(df, label))[1])
    rows, _ = rows_of(turns(spark, CHAIN), 8, 3)
    entered = [w for df in written for w in windows(df._jdf.queryExecution().optimizedPlan())]
    assert len(rows) == 2 and entered and not any(w & {"prompt", "response", "observation", "logp"} for w in entered)


@pytest.mark.parametrize("options", [{}, {"target_rows": 7}])
def test_random_rollouts_match_the_loop(spark, options):
    rng = random.Random(3)
    rollouts = []
    for name, n in [("hot", 40), ("a", 6), ("b", 3), ("d", 1)]:
        pairs, prompt = [], [rng.randint(1, 9) for _ in range(3)]
        for _ in range(n):
            response = [rng.randint(1, 9) for _ in range(rng.randint(1, 4))]
            pairs.append((list(prompt), response))
            prompt = prompt + response + [rng.randint(1, 9) for _ in range(rng.randint(0, 3))]
            if rng.random() < 0.15:
                prompt = [rng.randint(1, 9) for _ in range(2)]
        rollouts.append((name, pairs))
    rows, _ = rows_of(turns(spark, *rollouts), 25, 10, **options)
    got = {(r.rollout, r.row_start): (r.prompt, r.response, r["mask"]) for r in rows}
    want = {(name, s): (p, r, m) for name, pairs in rollouts for s, p, r, m in brute(pairs, 25, 10)}
    assert got == want


PIECES = [bytes([i]) for i in range(256)] + [b"the ", b"tests", b" passed", "é".encode(), b"ed"]


def codec():
    return PieceCodec(PIECES)


def sampled(text):
    return list(text.encode())


def test_codec_goes_there_and_back():
    c = codec()
    for text in ("the tests passed", "", "é𝄞 the", "thethe tests"):
        assert c.data(c.encode(text)) == text.encode()
    assert c.encode("the tests passed") == [256, 257, 258] and c.encode("passed") != sampled("passed")
    assert PieceCodec([b"a"], lambda text: [0] * len(text)).encode("aaa") == [0, 0, 0]
    with pytest.raises(ValueError):
        PieceCodec([b"a"]).encode("b")


def test_codec_continuations():
    c, said = codec(), "assistant: the tests passed"
    context = sampled(said)
    assert c.continuation(c.encode(said + "\nuser: thanks"), context) == c.encode("\nuser: thanks")
    assert c.continuation(c.encode(said), context) == []  # the same text
    assert c.continuation(c.encode("assistant: tests passed"), context) is None  # something else
    assert c.continuation(c.encode(said), sampled(said + " and more")) is None  # a shorter prompt
    assert c.continuation(c.encode("caf") + [259, 1], sampled("caf") + [0xC3]) == [0xA9, 1]  # a cut inside a letter
    assert c.continuation([9999], [1]) is None and c.continuation([1], [-1]) is None  # no such ids


def test_ranks_file_gives_pieces(tmp_path):
    import base64

    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in [(2, b"ab"), (0, b"a"), (1, b"b")]))
    assert PieceCodec.from_ranks(str(path)).encode("abba") == [2, 1, 0]


def test_retokenised_turns_merge_by_text(spark):
    said, c = "the tests passed", codec()
    df = turns(spark, ("r", [(c.encode("go: "), sampled(said)), (c.encode("go: " + said + "!"), [65]), (c.encode("og: "), [66]), ([], [67]), (c.encode("og: BC?"), [68])]))
    pieces = PIECES  # workers can not import this module
    rows, m = rows_of(df, 500, 500, codec=continuation_of(lambda: PieceCodec(pieces)), fill=True)
    assert [bytes(c.data(r.response)).decode() for r in rows] == [said + "!A", "BC?D"]
    assert rows[0]["mask"] == [1] * 16 + [0, 1] and (m.n_text_level_merges, m.n_merge_mismatch_rows) == (1, 1)
    assert len(rows_of(df, 500, 500, fill=True)[0]) == 3  # without a codec the seam breaks


def test_text_continuation_with_a_codec(spark):
    @F.udf("array<int>")
    def codec(prompt, context):
        # Ids above 100 spell the same text as the id minus 100.
        plain = lambda ids: [i % 100 for i in ids]
        if prompt is None or plain(prompt)[: len(context)] != plain(context):
            return None
        return prompt[len(context):]

    df = turns(spark, ("r", [([1], [2]), ([1, 102, 3], [4]), ([1, 9, 3], [5])]))
    plain, _ = rows_of(df, 50, 50)
    rows, m = rows_of(df, 50, 50, codec=codec)
    assert len(plain) == 3 and len(rows) == 2 and m.n_text_level_merges == 1
    assert rows[0].response == [2, 3, 4]


def test_rows_of_a_rollout_meet_in_place(spark, monkeypatch, tmp_path):
    """Ids are shuffled once for the links and once for the rows; rollouts too long for that give the same rows."""
    turns = [(k, i, list(range(1, 3 * i + 2)), [3 * i + 2], [-0.5]) for k in (1, 2, None) for i in range(6)]
    path = str(tmp_path / "turns")
    spark.createDataFrame(turns, "r long, turn int, prompt array<int>, response array<int>, logp array<double>").write.parquet(path)
    df, found = spark.read.parquet(path), []
    for most in (merge.DEALT_TURNS, 3):
        monkeypatch.setattr(merge, "DEALT_TURNS", most)
        written = []
        monkeypatch.setattr(merge, "cut_lineage", lambda rows, label="rows": written.append(rows) or cut_lineage(rows, label))
        links = merge.continuity(df, ["r"], "turn")
        rows = merge.training_rows(merge.merged_rows(links, ["r"], "turn", 100, 100), df, ["r"], "turn", 100, 100)
        found.append(sorted(map(str, rows.collect())))
        assert ("mask" in written[-1].columns) == (most > 3)
    assert found[0] == found[1] and len(found[0]) == 3
