"""Tensors compared block by block, whatever pieces they come in, against a plain comparison by position."""

import math
import random

import pytest

from rungauge.operators import joins

SCHEMA = "name string, start long, v array<double>"


def cut(rng, tensor):
    """Random pieces of {position: value}, each of neighbouring positions."""
    out, run = [], []
    for p in sorted(tensor):
        if run and (p != run[-1] + 1 or rng.random() < 0.2):
            out.append((run[0], [tensor[q] for q in run]))
            run = []
        run.append(p)
    return out + ([(run[0], [tensor[q] for q in run])] if run else [])


@pytest.mark.parametrize("width", [1, 4, 7, 4096])
def test_blocks_match_positions(spark, width):
    rng = random.Random(width)
    value = lambda: rng.choice([None, 0.0, 1.5, -2.0, rng.random()])
    sides = [{f"t{i}": {p: value() for p in rng.sample(range(-20, 40), rng.randint(1, 50))} for i in range(8)} for _ in range(2)]
    sides[0]["only_new"], sides[1]["only_old"] = {3: 1.0, 4: 2.0}, {-1: 5.0}
    frames = [spark.createDataFrame([(n, s, v) for n, t in side.items() for s, v in cut(rng, t)] + [("empty", 0, [])], SCHEMA).repartition(3) for side in sides]
    got = {r["name"]: r for r in joins.weight_drift(*[joins.tensor_blocks(f, "name", "start", "v", width) for f in frames]).collect()}
    assert set(got) == set(sides[0]) | set(sides[1])
    for name, r in got.items():
        new, old = (side.get(name, {}) for side in sides)
        both = [(new[p], old[p]) for p in new.keys() & old.keys()]
        change = sum((a - b) ** 2 for a, b in both if a is not None and b is not None)
        norm = sum(b * b for _, b in both if b is not None)
        assert r["n_unmatched"] == len(new.keys() ^ old.keys())
        if not both:
            assert r["change"] is None and r["relative"] == 0.0
            continue
        assert r["change"] == pytest.approx(math.sqrt(change)) and r["norm"] == pytest.approx(math.sqrt(norm))
