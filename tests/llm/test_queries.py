"""The contract queries on small made-up tables: against SQL, brute force, and their laws."""

import collections
import hashlib
import os
import sys
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle  # noqa: E402

from rungauge.llm import bagminhash, decontamination, mixing, sharding, topk  # noqa: E402
from rungauge.llm import queries as q  # noqa: E402
from rungauge.llm.registry import ORACLES  # noqa: E402

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(2_500))


def text_rows():
    rnd = np.random.default_rng(3)
    vocabulary = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(rnd.choice(vocabulary, rnd.integers(1, 120)))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " one more word") for i in range(0, 60, 3)]
    rows += [(200 + i, rows[i][1].upper() + "!") for i in range(0, 60, 4)]
    rows += [(300, None), (301, ""), (302, ""), (303, "?! ."), (304, "one two"), (305, "One, two"), (306, "one two three four five"), (307, LONG), (308, LONG + " end")]
    rows += [(309, f"see {ITEM.upper()} here {ITEM[:55]}"), (310, "é𝄞ß über " + ITEM), (311, "one two " * 50), (312, "one two " * 45), (None, "a b c"), (None, None), (5, rows[5][1]), (5, "other text"), (309, f"see {ITEM.upper()} here {ITEM[:55]}")]
    return rows


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """A data folder with nulls, ties, repeats, empty and long texts, and columns whose names clash with the operators' own."""
    folder = str(tmp_path_factory.mktemp("data"))
    rows = text_rows()
    sources = ["b", "a", None, "ab", "é", "z"]
    full = [(i, t, sources[n % 2 if n % 3 else n % 6]) for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("row", "key", "node", "h", "size", "target", "segment", "position", "shard")})
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(1, ITEM), (2, "one two three"), (3, None), (4, ""), (10, " ".join(ITEM.split()[1:])), (None, "t1"), (5, "no such words at all in there " * 3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rnd = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rnd.normal(size=8)]) for i in range(700)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(300)] + [(2000, None), (2001, [1.0, None] * 4), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2100, [0.5] * 8), (None, [1.0] * 8)]
    vectors += [(-100, [-0.0005] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def connection(root):
    import duckdb

    c = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        c.execute(f"create view {name} as select * from read_parquet('{root}/{name}.parquet/*.parquet')")
    return c


@pytest.mark.parametrize("name", ["op2_mix_sources", "op6_decontaminate", "op8_top_k"])
def test_against_sql(spark, connection, root, name):
    assert oracle.compare(spark, connection, root, q.query.__globals__["QUERIES"][name], ORACLES[name]) is None


def test_mix_laws(spark, root):
    rows = q.mix_sources(spark, root).collect()
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    total = collections.Counter()
    for r in rows:
        total[r.target] += r.taken
    by_target = collections.Counter({r.target: 0 for r in rows})
    n_sources = collections.Counter(t for t, _ in {(r.target, r.source_size) for r in rows})
    for t in by_target:
        assert abs(total[t] - t * n_sources[t]) <= 3 * n_sources[t]
    assert sorted(map(str, rows)) == sorted(map(str, q.mix_sources(spark, root).collect()))


def test_mix_thresholds_are_nested(spark):
    rows = spark.createDataFrame([("s", h * 7919 % 1000, 10) for h in range(100)], "source string, h long, size long").cache()
    taken = []
    for budget in (95.0, 250.0, 800.0):
        edge = mixing.boundaries(rows, spark.createDataFrame([("s", budget)], "source string, budget double")).first()
        below = {r.h for r in rows.collect() if r.h < edge.edge}
        assert len(below) == budget // 10 and edge.rest == pytest.approx(budget % 10)
        taken.append(below)
    assert taken[0] < taken[1] < taken[2]


def test_shards(spark, root):
    rows = q.shard_rows(spark, root).collect()
    counts = collections.Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(24)) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in counts)
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in text_rows())
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    again = sorted(map(str, (r.asDict() for r in q.shard_rows(spark, root).collect())))
    assert again == sorted(map(str, (r.asDict() for r in rows)))


def test_shards_do_not_depend_on_layout(spark):
    df = spark.createDataFrame([(i,) for i in range(500)], "doc_id long")
    one = {(r.doc_id, r.shard, r.slot) for r in sharding.sharded(df.repartition(7), ["doc_id"], 5).collect()}
    two = {(r.doc_id, r.shard, r.slot) for r in sharding.sharded(df.coalesce(1), ["doc_id"], 5).collect()}
    assert one == two and all(sharding.place(i, 500, 5) == (s, t) and sharding.row_at(s, t, 500, 5) == i for i, s, t in sorted(one)[:20])


@pytest.mark.parametrize("n", [1, 2, 3, 24, 1000, 4097])
def test_feistel_is_a_permutation(n):
    p = sharding.permuted(np.arange(n), n, 9)
    assert sorted(p) == list(range(n)) and (sharding.permuted(p, n, 9, inverse=True) == np.arange(n)).all()


def test_near_duplicates(spark, root):
    rows = text_rows()
    got = sorted(map(str, ((r.doc_id, r.class_id) for r in q.near_duplicates(spark, root).collect())))
    assert got == sorted(map(str, brute.near_classes(rows)))


@pytest.mark.parametrize("load, members", [(30, 4096), (2_000_000, 3), (10**9, 10**9)])
def test_large_clusters_are_cut_into_blocks(spark, documents, monkeypatch, load, members):
    monkeypatch.setattr(bagminhash, "LOAD", load)
    monkeypatch.setattr(bagminhash, "MEMBERS", members)
    rnd = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # copies with more and more words changed: links only between some of them
        words = list(base)
        for at in rnd.integers(0, 120, i % 12):
            words[at] = f"new{i}at{at}"
        rows.append((i, " ".join(words)))
    got = sorted((r.doc_id, r.class_id) for r in bagminhash.near_duplicates(documents(rows)).collect())
    assert got == sorted(brute.near_classes(rows))


def test_signatures_estimate_weighted_similarity():
    rnd = np.random.default_rng(1)
    a = {f"s{i}": int(w) for i, w in enumerate(rnd.integers(1, 40, 60))}
    b = {k: max(1, w + int(rnd.integers(-12, 12))) for k, w in a.items() if rnd.random() < 0.9}
    texts = [" ".join(w for k, n in d.items() for w in [k] * n) for d in (a, b)]
    data = " ".join(texts).encode()
    bags = bagminhash.Bags(np.frombuffer(data, np.uint8), np.array([0, len(texts[0]) + 1, len(data)]), width=1)
    x, y = bags.signatures(4096)
    common = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b)
    assert abs((x == y).mean() - common / (sum(a.values()) + sum(b.values()) - common)) < 0.03


def test_proximity(documents, spark):
    docs = documents([(1, "x alpha beta gamma y"), (2, "alpha z beta gamma"), (3, "gamma beta alpha"), (4, "alpha z z z beta gamma")])
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    hits = lambda slop: {r.doc_id for r in decontamination.decontaminated(docs, items, width=3, slop=slop).filter("contaminated").collect()}
    assert hits(0) == {1} and hits(1) == {1, 2}


def test_benchmark_in_blocks(documents, spark, monkeypatch):
    docs = documents([(i, t) for i, t in text_rows()])
    items = spark.createDataFrame([(i, t) for i, t in text_rows()[:40]] + [(99, ITEM)], "item_id long, text string")
    whole = sorted(map(str, decontamination.decontaminated(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 50)
    assert sorted(map(str, decontamination.decontaminated(docs, items).collect())) == whole


def test_top_k_of_any_share(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    v = rnd.integers(-50, 50, (600, 5))
    df = spark.createDataFrame([(i, [int(x) for x in row]) for i, row in enumerate(v)], "id long, v array<long>")
    monkeypatch.setattr(topk, "SHARE", 7)
    monkeypatch.setattr(topk, "BLOCK", 16)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, "id % 20 = 0", k=4).collect()}
    for i in range(0, 600, 20):
        best = sorted((-int(v[i] @ v[j]), j) for j in range(600) if j != i)[:4]
        assert [got[i, r + 1] for r in range(4)] == [(j, -s) for s, j in best]


def test_empty_tables(spark, folder, documents):
    empty = folder(
        documents=documents([]), benchmark=spark.createDataFrame([], "item_id long, text string"), embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>"),
        labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), pages=spark.createDataFrame([], "page_id long, url string, html string"),
        conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"),
    )
    for name, run in q.query.__globals__["QUERIES"].items():
        assert run(spark, empty).count() == 0, name


def test_empty_benchmark(documents, spark):
    found = decontamination.decontaminated(documents([(1, "a b")]), spark.createDataFrame([], "item_id long, text string")).first()
    assert not found.contaminated and found.n_words == 2


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_proximity_stays_in_a_document(spark):
    from rungauge.llm import decontamination

    docs = spark.createDataFrame([(1, "x one two three"), (2, "four five six y"), (3, "one three two four five six"), (4, "")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(7, "one two three four five six")], "item_id long, text string")
    for slop, layout in ((1, docs), (2, docs), (1, docs.repartition(4))):
        got = {r.doc_id: (r.n_hit, r.contaminated) for r in decontamination.decontaminated(layout, items, width=6, slop=slop).collect()}
        assert got == {1: (0, False), 2: (0, False), 3: (6, True), 4: (0, False)}
