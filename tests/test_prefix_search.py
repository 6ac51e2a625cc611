"""The frontier search asks each (trace, prefix) pair once, from the smallest up, also after a restart."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rungauge.operators import prefix_search as ps

CANDIDATES = [("a", 2), ("a", 5), ("a", 9), ("b", 1), ("b", 4), ("c", 3), ("c", 3), (None, 1), ("d", None), ("e", 7)]
PASSING = {("a", 5), ("a", 9), ("b", 1), ("e", 7)}


def recorder(folder, passing=frozenset(PASSING), fail=None):
    """An evaluator that writes down what it is asked, one file per load."""

    def load():
        import uuid

        path = f"{folder}/{uuid.uuid4().hex}"
        open(path, "w").close()

        def evaluate(batch):
            with open(path, "a") as out:
                for row in batch.to_pylist():
                    if (row["trace"], row["k"]) == fail:
                        raise RuntimeError("container lost")
                    out.write(f"{row['trace']} {row['k']} {row['note']}\n")
            return pa.array([(t, k) in passing for t, k in zip(batch["trace"].to_pylist(), batch["k"].to_pylist())])

        return evaluate

    return load


def asked(folder):
    return sorted(line.strip() for name in os.listdir(folder) for line in open(f"{folder}/{name}"))


@pytest.fixture
def candidates(spark):
    return spark.createDataFrame(CANDIDATES, "trace string, k int").withColumns({"note": F.lit("n"), "extra": F.lit(1)})


def settled(found):
    return {r["trace"]: (r["k_prefix"], r["n_evaluated"], r["drop_reason"]) for r in ps.shortest(found, "trace", "k").collect()}


WANT = {"a": (5, 2, None), "b": (1, 1, None), "c": (None, 1, "replay_drift"), "e": (7, 1, None)}


def test_each_pair_once_and_none_after_the_first_that_passes(candidates, tmp_path):
    found = ps.search(candidates, "trace", "k", recorder(tmp_path))
    assert settled(found) == WANT
    assert asked(tmp_path) == ["a 2 n", "a 5 n", "b 1 n", "c 3 n", "e 7 n"]


def test_wider_rounds_ask_more_and_find_the_same(candidates, tmp_path):
    found = ps.search(candidates, "trace", "k", recorder(tmp_path), width=3)
    assert {t: w[::2] for t, w in settled(found).items()} == {t: w[::2] for t, w in WANT.items()}
    assert len(asked(tmp_path)) == 7


def test_a_restart_goes_on_from_the_memo(spark, candidates, tmp_path):
    first, second, memo = tmp_path / "first", tmp_path / "second", str(tmp_path / "memo")
    first.mkdir(), second.mkdir()
    with pytest.raises(Exception, match="container lost"):
        ps.search(candidates, "trace", "k", recorder(first, fail=("a", 5)), memo=memo)
    known = {f"{r['trace']} {r['k']} n" for r in spark.read.parquet(memo).collect()}
    assert known == {"a 2 n", "b 1 n", "c 3 n", "e 7 n"}  # the round before the loss
    assert settled(ps.search(candidates, "trace", "k", recorder(second), memo=memo)) == WANT
    assert asked(second) == ["a 5 n"]
    assert settled(ps.search(candidates, "trace", "k", recorder(second), memo=memo)) == WANT and len(asked(second)) == 1


def test_an_evaluator_without_an_answer_and_no_candidates(candidates, tmp_path):
    none = ps.search(candidates, "trace", "k", lambda: lambda batch: pa.nulls(batch.num_rows))
    assert {r["k_prefix"] for r in ps.shortest(none, "trace", "k").collect()} == {None}
    assert ps.search(candidates.limit(0), "trace", "k", recorder(tmp_path)).count() == 0
    with pytest.raises(Exception, match="1 answers for"):
        ps.search(candidates.coalesce(1), "trace", "k", lambda: lambda batch: pa.array([True]))
