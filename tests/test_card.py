"""Dataset-card distributions and counts against a plain reading."""

import random

from pyspark.sql import functions as F

from rungauge.operators import curation

SCHEMA = ("run string, instance_id string, segment string, flags array<string>, n_turns int, n_tokens long, max_turn_tokens int, "
          "wall_seconds double, n_compactions int, image string")


def plain(values):
    values = sorted(values)
    at = lambda p: values[min(len(values) - 1, int(p * len(values)))]
    return len(values), round(sum(values) / len(values), 9), at(0.5), at(0.9), values[-1]


def test_distributions_and_counts(spark):
    draw = random.Random(3)
    rows = []
    for i in range(40):
        wall, compactions = draw.choice([None, 10.0, 20.5]), draw.choice([None, 0, 2])
        for segment in ("main", "post", "compact")[: draw.randint(1, 3)]:
            flags = draw.choice([[], ["a"], ["a", "post_segments_missing"]])
            rows.append(("r", str(i), segment, flags, draw.randint(0, 5), draw.randint(0, 9), draw.randint(0, 9), wall, compactions, f"m{i % 4}"))
    df = spark.createDataFrame(rows, SCHEMA)
    rollouts = {}
    for r in rows:
        rollouts.setdefault(r[1], []).append(r)
    turns = {i: sum(r[4] for r in s if r[2] != "compact") for i, s in rollouts.items()}
    whole = [i for i, s in rollouts.items() if not any("post_segments_missing" in r[3] for r in s)]
    want = {
        "rollout_turns": plain(turns.values()), "complete_rollout_turns": plain([turns[i] for i in whole]), "wall_seconds": plain([s[0][7] or 0 for s in rollouts.values()]),
        "max_turn_tokens": plain([r[6] for r in rows if r[2] != "compact"]),
        **{f"tokens_{k}": plain([r[5] for r in rows if r[2] == k]) for k in ("main", "post", "compact")}, **{f"turns_{k}": plain([r[4] for r in rows if r[2] == k]) for k in ("main", "post")},
    }
    for options in ({}, {"target_rows": 3}):  # slices, too
        got = {r.measure: (r.n, round(r["mean"], 9), r.p50, r.p90, r["max"]) for r in curation.card_distributions(df, **options).collect()}
        assert got == want
    calls = [("assistant", False, ["x", "y"]), ("assistant", True, ["x"]), ("user", None, ["x"]), ("assistant", None, ["x"]), ("assistant", False, None)]
    messages = spark.createDataFrame(calls, "role string, synthetic boolean, tools array<string>")
    counts = {(r.kind, r.name): r.n for r in curation.card_counts(df, messages).collect()}
    assert (counts["tool", "x"], counts["tool", "y"], counts["run", "r"]) == (2, 1, len(rows))
    assert counts["compactions", "unknown(>=1)"] == sum(s[0][8] is None for s in rollouts.values())
    assert counts["flag", "a"] == sum("a" in r[3] for r in rows) and counts["image", "m1"] == 10
    assert curation.card_distributions(df.limit(0)).count() == 0
    assert curation.card_counts(df.limit(0), messages.where(F.lit(False))).count() == 0
