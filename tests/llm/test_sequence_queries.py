"""Runs, conversation tries and archives: against SQL, brute force and exact round trips, on odd tables too."""

import gzip
import hashlib
import os
import random
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle  # noqa: E402

from rungauge.llm import periodic_runs, prefix_trie, warc  # noqa: E402
from rungauge.llm import sequence_queries as q  # noqa: E402
from rungauge.llm.registry import ORACLES, QUERIES  # noqa: E402

CLASHES = ("runs", "collapsed", "n", "a", "p", "h", "words", "top", "key", "depth", "place", "level", "payload", "digest")


def brute_runs(words, shortest=12):
    """All maximal stretches with their smallest period, period by period."""
    found = {}
    for period in range(1, len(words) // 2 + 1):
        i = 0
        while i + period < len(words):
            start = i
            while i + period < len(words) and words[i] == words[i + period]:
                i += 1
            if i > start and i - start + period >= max(shortest, 2 * period):
                found.setdefault((start, i - start + period), period)
            i += i == start
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))


def without_repeats(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def run_texts():
    rnd = random.Random(11)
    texts = [None, "", " \n", "one", "a " * 11, "a " * 12, "a b " * 6, "a b " * 6 + "a", "x y z " * 4 + "x y q " + "x y z " * 5]
    texts += ["long " * 60_000, " ".join(f"w{i % 4999}" for i in range(25_000)), " a b\x0b" * 9, "\x00\x01 " * 13]
    for _ in range(150):
        words = [f"w{rnd.randrange(rnd.choice([1, 2, 3, 50]))}" for _ in range(rnd.choice([0, 13, 40, 150]))]
        if words and rnd.random() < 0.6:
            a = rnd.randrange(len(words))
            p = 1 + rnd.randrange(max(1, (len(words) - a) // 2))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        texts.append(rnd.choice([" ", "\t\n"]).join(words))
    return texts


def test_runs_against_brute_force(spark):
    texts = run_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string").repartition(3)
    for shortest in (12, 5):
        found = {r["id"]: r for r in periodic_runs.without_runs(docs, "body", shortest).collect()}
        for i, text in enumerate(texts):
            words = periodic_runs_words(text)
            if len(words) > 10_000:  # brute force is quadratic
                continue
            want = brute_runs(words, shortest)
            assert [tuple(r) for r in found[i]["runs"]] == want, (i, shortest)
            assert found[i]["collapsed"] == without_repeats(words, want)
        assert [tuple(r) for r in found[9]["runs"]] == [(0, 60_000, 1)] and found[9]["collapsed"] == "long"
        assert [tuple(r) for r in found[10]["runs"]] == [(0, 25_000, 4_999)]


def periodic_runs_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_run_query_against_sql_and_digests(spark, folder):
    rows = [(i, t) for i, t in enumerate(run_texts()) if t is None or len(t) < 100_000]
    rows += [(None, "a " * 30), (-7, "a b " * 10), (3, rows[20][1]), (3, rows[20][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHES})
    root = folder(documents=docs.repartition(3))
    connection = oracle.duckdb.connect()
    connection.execute(f"create view documents as select * from '{root}/documents.parquet/*.parquet'")
    assert oracle.compare(spark, connection, root, QUERIES["op11_find_runs"], ORACLES["op11_find_runs"]) is None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in q.find_runs(spark, root).collect():
        if r["doc_id"] is None:  # no id, no turning
            assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (1, 0, 30, 1, 30_000)
            assert r["runs_sha256"] == sha("0,30,1\n") and r["collapsed_sha256"] == sha("a")
        if r["doc_id"] == 0:
            assert r["n_runs"] == 0 and r["start"] is None and r["runs_sha256"] == r["collapsed_sha256"] == sha("")


def test_runs_of_an_empty_table(spark, folder):
    root = folder(documents=spark.createDataFrame([], "doc_id long, text string"))
    assert q.find_runs(spark, root).count() == 0


def brute_trie(paths):
    """Nodes of {conv: [(turn, tokens), ...]}."""
    members = {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(conv)
    out = {}
    for node, convs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        children = [n for n in under if len(n) == len(node) + 1]
        leaves = [n for n in under if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * n[-1][1] for n in under if n)
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[min(convs), len(node)] = (parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


@pytest.mark.parametrize("members,queue,target", [(1000, 1000, None), (2, 1, None), (3, 2, 6), (4, 1, 4)])
def test_trie_against_brute_force_with_small_shards_queues_and_slices(spark, members, queue, target):
    rnd = random.Random(members)
    paths = {}
    for conv in range(-5, 40):
        path = [(f"t{rnd.randrange(2)}", 0) for _ in range(rnd.choice([0, 1, 3, 6]))]
        paths[conv] = [(t, len(t) + int(t[1:])) for t, _ in path]
    paths[50] = [("t1", 3)] * 30  # much longer than all others
    paths.update({60 + i: paths[50][:9] for i in range(12)})  # equal ones
    turns = [(conv, i, t, n) for conv, path in paths.items() for i, (t, n) in enumerate(path)]
    df = spark.createDataFrame(turns, "conv_id long, place int, digest string, tokens long")
    convs = spark.createDataFrame([(c,) for c in paths], "conv_id long")
    found = prefix_trie.trie(df, convs, ["place"], members, queue, target).collect()
    assert {(r[0], r[1]): tuple(r)[2:] for r in found} == brute_trie(paths) and len(found) == len(brute_trie(paths))


def test_queue_spills_and_keeps_the_order():
    queue, rnd, got = prefix_trie.SpillingQueue(7), random.Random(3), []
    entries = [(rnd.randrange(50), rnd.randrange(9), i) for i in range(500)]
    for i, entry in enumerate(entries):
        queue.push(entry)
        if i % 5 == 4:
            got.append(queue.pop())
    while queue.least() is not None:
        got.append(queue.pop())
    assert sorted(got) == sorted(entries) and len(queue.runs) == 0
    tail = got[100:]
    assert tail == sorted(tail)


def test_trie_query_against_sql(spark, folder):
    rnd = random.Random(12)
    rows = []
    for conv in [*range(-45, 130), 10_000]:
        if conv % 20 == 0 and conv % 3 == 0:
            continue  # some conversations that others begin with are absent
        for turn in range(rnd.choice([1, 1, 2, 5])):
            rows.append((conv, turn, rnd.choice(["user", "assistant", None]), rnd.choice(["hi there", "", None, "a  b\nc", "é"])))
    rows += [(21, None, "user", "first"), (21, 0, "user", "tie"), (21, 0, "user", "tie"), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(200 + i, t, "user", "same") for i in range(40) for t in range(4)] + [(300, t, "user", f"n{t}" * (t % 3)) for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in CLASHES})
    root = folder(conversations=df.repartition(3))
    connection = oracle.duckdb.connect()
    connection.execute(f"create view conversations as select * from '{root}/conversations.parquet/*.parquet'")
    assert oracle.compare(spark, connection, root, QUERIES["op12_prefix_trie"], ORACLES["op12_prefix_trie"]) is None


def test_trie_of_no_conversations(spark, folder):
    root = folder(conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert q.conversation_trie(spark, root).count() == 0


def page_rows():
    body, long = "<p>" + "x" * 1200 + "</p>", "é𝄞 word " * 300_000
    rows = [(i, f"http://h{i}.net/", f"<p>{i}</p>" * (i * 40)) for i in range(30)]
    rows += [(100 + i, f"http://copy.net/{i}", body) for i in range(40)] + [(90, "http://a/", body), (139, "http://b/", body), (139, "http://b/", body), (139, None, body)]
    rows += [(200, None, None), (201, "", ""), (202, "http://s/", "short"), (203, "http://s/", "short"), (None, "http://n/", "z" * 1000), (None, "http://m/", "z" * 1000), (204, "a\r\nb: c", long)]
    rows += [(300 + i, "u", "y" * (999 + i)) for i in (0, 1)] + [(310 + i, "u", "y" * (999 + i)) for i in (0, 1)] + [(7, "http://h7.net/", "<p>7</p>" * 280)]
    return rows


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(page_rows(), "page_id long, url string, html string").withColumns({c: F.lit("x") for c in CLASHES}).repartition(3)


def test_archive_query_against_sql(spark, folder, pages):
    root = folder(pages=pages)
    connection = oracle.duckdb.connect()
    connection.execute(f"create view pages as select * from '{root}/pages.parquet/*.parquet'")
    assert oracle.compare(spark, connection, root, QUERIES["op13_write_archives"], ORACLES["op13_write_archives"]) is None


def test_archives_round_trip_by_ranges(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 2)
    folder = f"file://{tmp_path}/archives"
    index = warc.write_archives(warc.planned(pages, "page_id", "url", "html"), folder)
    rows = index.collect()
    assert len(rows) == len(page_rows())
    long = {r[2] for r in page_rows() if len((r[2] or "").encode()) >= warc.SHORTEST}
    assert sum(r["record_type"] == "response" for r in rows) == len(long) + sum((r[2] or "") not in long for r in page_rows())
    for r in rows:  # each record stands alone at its offset, whatever reads it
        with open(tmp_path / "archives" / r["file"], "rb") as file:
            file.seek(r["offset"])
            record = gzip.decompress(file.read(r["length"]))
        assert record.startswith(b"WARC/1.0\r\nWARC-Type: " + r["record_type"].encode()) and record.endswith(b"\r\n\r\n")
        assert record.count(b"\r\nWARC-Target-URI:") == (r["url"] is not None)
    spans = sorted((r["file"], r["offset"], r["offset"] + r["length"]) for r in rows)
    assert all(a[0] != b[0] or a[2] == b[1] for a, b in zip(spans, spans[1:]))  # no gap, no overlap
    chosen = index.filter("key in ('0', '3', '29', '139', '204', '120')")
    read = warc.read_records(chosen, folder).collect()
    texts = {i: (t or "").encode() for i, _, t in page_rows()}
    assert len(read) == chosen.count() and all(r["intact"] for r in read)
    for r in read:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        assert r["payload"] is None or bytes(r["payload"]) == texts[int(r["key"])]
        assert r["payload_digest"] == hashlib.sha1(texts[int(r["key"])]).hexdigest()


def test_reads_join_neighbours_and_leave_gaps_out():
    import pyarrow as pa

    rows = [{"file": "a", "offset": i * 100, "length": 100} for i in range(50)]
    rows += [{"file": "a", "offset": 5000 + 2 * warc.GAP_BYTES, "length": 10}, {"file": "b", "offset": 0, "length": warc.READ_BYTES}, {"file": "b", "offset": warc.READ_BYTES, "length": 5}]
    runs = list(warc._ranges(iter([pa.RecordBatch.from_pylist(rows[:20]), pa.RecordBatch.from_pylist(rows[20:])])))
    assert [len(r) for r in runs] == [50, 1, 1, 1] and [r for run in runs for r in run] == rows


def test_a_record_that_changed_gives_no_digest(spark, tmp_path):
    folder = str(tmp_path / "archives")
    pages = spark.createDataFrame([(1, "u", "first"), (2, "u", "other")], "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(warc.planned(pages, "page_id", "url", "html"), folder)
    rows = {r["key"]: r for r in index.collect()}
    swapped = spark.createDataFrame([{**rows["1"].asDict(), "offset": rows["2"]["offset"], "length": rows["2"]["length"]}, rows["2"].asDict()], warc.INDEX)
    found = sorted((r["payload_digest"] is None) for r in warc.resolved(swapped, folder).collect())
    assert found == [False, True]


def test_archives_of_no_pages(spark, folder):
    root = folder(pages=spark.createDataFrame([], "page_id long, url string, html string"))
    assert q.write_archives(spark, root).count() == 0


def test_crc_in_sql():
    crc = lambda n: oracle.duckdb.connect().execute(f"select {q.CRC_SQL.format(n)}").fetchall()[0][0]
    assert [crc(n) for n in (0, 7, -12, 10**15)] == [zlib.crc32(str(n).encode()) for n in (0, 7, -12, 10**15)]
