"""The pipeline's stages against plain-Python versions, each on its own input."""

import collections

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from rungauge.llm import sharding, toxicity

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def rows():
    rnd = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    out = [(i, " ".join(rnd.choice(words, rnd.integers(20, 60)))) for i in range(150)]
    out = [(i, t + (" you zorgling thing." if i % 5 == 0 else "")) for i, t in out]
    out += [(200 + i, out[i][1] + " tail") for i in range(0, 150, 7)] + [(300 + i, out[i][1]) for i in range(0, 150, 11)]
    out += [(400, f"intro {ITEM} end"), (401, " ".join(ITEM.split()[:9])), (402, None), (403, ""), (404, "..."), (1, out[1][1]), (1, out[1][1]), (None, "some text of nobody")]
    return [(i, t, ("a", "b", None)[n % 3] if i != 1 else "a") for n, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    # Columns named like the stages' own.
    df.withColumns({c: F.lit(c) for c in ("row", "score", "clauses", "k", "h", "copies", "key", "n")}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int("zorgling" in (t or ""))) for i, t, _ in rows() if i is not None and i < 150]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def pairs(df):
    return collections.Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, root).write.parquet(path)
        before, after = pairs(docs), pairs(spark.read.parquet(path))
        if name == "toxicity":
            model = toxicity.fitted(docs.select("doc_id", "text"), spark.read.parquet(f"{root}/labels.parquet"))
            quick = model.lexicon.pattern()
            want = collections.Counter({(i, t): n for (i, t), n in before.items() if model.score(*model.features(t, quick)) < toxicity.REJECT})
            assert after == want and not any("zorgling" in (t or "") for _, t in after)
            assert all(p in after for p in before if "zorgling" not in (p[1] or ""))
        elif name == "near_duplicates":
            unique = sorted(before, key=str)
            shingled = {p: c for p, (_, c) in zip(unique, brute.near_classes([(n, t) for n, (_, t) in enumerate(unique)]))}
            assert set(after.values()) == {1} and set(after) <= set(before)
            assert collections.Counter(shingled[p] for p in after) == collections.Counter(set(shingled.values()))
        elif name == "decontamination":
            item = brute.words(ITEM)
            windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
            dirty = lambda t: any(tuple(w[i : i + 10]) in windows for w in [brute.words(t)] for i in range(len(w) - 9))
            assert after == collections.Counter({p: n for p, n in before.items() if not dirty(p[1])}) and after != before
        elif name == "mixing":
            assert set(after) <= set(before) and max(after.values()) <= 3
            size = lambda t: len((t or "").split())
            source = {(r.doc_id, r.text): r.source for r in docs.collect()}
            total = sum(size(t) * n for (_, t), n in before.items())
            assert abs(sum(size(t) * n for (_, t), n in after.items()) - total) <= 60 * len(set(source.values()))
        else:
            got = spark.read.parquet(path).collect()
            assert after == before and sorted(r.position for r in got) == list(range(len(got)))
            assert all(sharding.place(r.position, len(got), 24, 10) == (r.shard, r.slot) for r in got)
        if name != "sharding":
            assert spark.read.parquet(path).columns == names
        docs = spark.read.parquet(path)


def test_run_and_empty_documents(spark, root, folder):
    assert corpus_pipeline.run(spark, root).count() > 50
    docs = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    empty = folder(documents=docs, labels=spark.read.parquet(f"{root}/labels.parquet"), benchmark=spark.read.parquet(f"{root}/benchmark.parquet"))
    assert corpus_pipeline.run(spark, empty).count() == 0
