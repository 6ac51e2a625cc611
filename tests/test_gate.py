"""The result gate: one change per rule must be rejected; unreadable is never a failure."""

import copy
import hashlib
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from rungauge.operators import grader
from rungauge.sources import readers, sinks

EVENT = "struct<kind:string,nodes:array<string>,nodeid:string,when:string,outcome:string,wasxfail:boolean,exitstatus:int>"
SCHEMA = (
    "instance_id string, n_f2p int, smith_rc int, timed_out boolean, error string, eval struct<resolved:boolean,timed_out:boolean,pytest_rc:int,"
    "n_f2p:int,n_f2p_pass:int,n_p2p:int,n_p2p_ok:int,f2p_statuses:map<string,string>,p2p_statuses:map<string,string>,grader_protocol:string,"
    "evaluation_state:string,reward_eligible:boolean,report_intact:boolean,restore_rc:int,collection_rc:int,p2p_scope:string,collected_nodes:array<string>,"
    f"node_mapping:map<string,string>,collection_sha256:string,report_sha256:string,requested_nodes_sha256:string,collection_events:array<{EVENT}>,test_events:array<{EVENT}>>"
)
A, B = "t/a.py::one", "t/a.py::two[x é 😀]"


def digest(events):
    return hashlib.sha256("".join(json.dumps(e, ensure_ascii=True) + "\n" for e in events).encode()).hexdigest()


def good():
    tests = [{"kind": "test", "nodeid": n, "when": w, "outcome": "passed", "wasxfail": False} for n in (A, B) for w in ("setup", "call", "teardown")]
    row = {
        "instance_id": "a", "n_f2p": 1, "smith_rc": 0, "timed_out": False,
        "eval": {
            "resolved": True, "timed_out": False, "pytest_rc": 0, "n_f2p": 1, "n_f2p_pass": 1, "n_p2p": 1, "n_p2p_ok": 1,
            "f2p_statuses": {A: "PASSED"}, "p2p_statuses": {"t/a.py::two[x": "PASSED"}, "grader_protocol": "pytest-structured-v1",
            "evaluation_state": "complete", "reward_eligible": True, "report_intact": True, "restore_rc": 0, "collection_rc": 0,
            "p2p_scope": "f2p_same_files", "collected_nodes": [A, B], "node_mapping": {A: A, "t/a.py::two[x": B},
            "requested_nodes_sha256": hashlib.sha256(json.dumps([A, "t/a.py::two[x"], ensure_ascii=True, separators=(",", ":")).encode()).hexdigest(),
            "collection_events": [{"kind": "collection", "nodes": [A, B]}, {"kind": "session_finish", "exitstatus": 0}],
            "test_events": tests + [{"kind": "session_finish", "exitstatus": 0}],
        },
    }
    return sign(row)


def sign(row):
    ev = row["eval"]
    ev["collection_sha256"], ev["report_sha256"] = digest(ev["collection_events"]), digest(ev["test_events"])
    return row


def judge(spark, row):
    df = spark.createDataFrame([(json.dumps(row),)], "j string").select(F.from_json("j", SCHEMA).alias("r")).select("r.*")
    out = df.select(grader.eval_violations().alias("a"), grader.evidence_violations().alias("b")).first()
    return list(out.a) + list(out.b)


def test_good_row_passes(spark):
    assert judge(spark, good()) == []


def change(path, value):
    def apply(row):
        target = row
        for p in path[:-1]:
            target = target[p]
        target[path[-1]] = value
    return apply


def drop_teardown(row):
    row["eval"]["test_events"] = [e for e in row["eval"]["test_events"] if e.get("when") != "teardown"]


def fail_call(row):
    row["eval"]["test_events"][1]["outcome"] = "failed"


def repeat_call(row):
    row["eval"]["test_events"].insert(0, dict(row["eval"]["test_events"][1]))


def fail_collection(row):
    row["eval"]["collection_events"][1]["exitstatus"] = 2


MUTATIONS = {
    "unavailable": change(["eval", "evaluation_state"], "unavailable"),
    "timeout": change(["eval", "timed_out"], True),
    "not_eligible": change(["eval", "reward_eligible"], False),
    "not_intact": change(["eval", "report_intact"], False),
    "restore": change(["eval", "restore_rc"], 128),
    "collection_rc": change(["eval", "collection_rc"], 2),
    "protocol": change(["eval", "grader_protocol"], "other"),
    "missing_events": change(["eval", "test_events"], []),
    "bad_hash": change(["eval", "report_sha256"], "0"),
    "failed_call": fail_call,
    "missing_teardown": drop_teardown,
    "duplicate_call": repeat_call,
    "bad_mapping": change(["eval", "node_mapping"], {A: B, "t/a.py::two[x": A}),
    "collection_failure": fail_collection,
    "bool_rc": change(["eval", "pytest_rc"], False),
    "bool_count": change(["eval", "n_f2p_pass"], True),
    "runner_error": change(["error"], "lost"),
    "count_mismatch": change(["n_f2p"], 2),
    "unknown_status": change(["eval", "f2p_statuses"], {A: "FINE"}),
    "missing_outside_timeout": change(["eval", "p2p_statuses"], {"t/a.py::two[x": "MISSING"}),
    "resolved_lies": change(["eval", "resolved"], False),
}


@pytest.mark.parametrize("name", sorted(MUTATIONS))
def test_one_change_is_rejected(spark, name):
    row = copy.deepcopy(good())
    MUTATIONS[name](row)
    if name not in ("bad_hash", "missing_events"):
        sign(row)
    assert judge(spark, row), name


def test_gate_fails_closed(spark):
    rows = [dict(good(), instance_id=i) for i in "abc"]
    rows[2]["timed_out"] = True
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", SCHEMA).alias("r")).select("r.*")
    df = df.withColumn("violations", grader.eval_violations()).withColumn("unreadable", F.lit(False))
    plan = spark.createDataFrame([("a",), ("b",), ("c",)], "instance_id string")
    whole = grader.gate(plan, df, "instance_id", 80).first()
    assert whole.complete and (whole.n_expected, whole.n_resolved, whole.n_trajectory_timeout) == (3, 3, 1)
    part = grader.gate(plan, df.where("instance_id <> 'b'"), "instance_id", 80).first()
    assert not part.complete and part.n_resolved is None and part.problems == ["missing=1"]
    none = grader.gate(plan, df.limit(0), "instance_id", 80).first()
    assert not none.complete and none.n_resolved is None


def test_scan_reports_unreadable_results(spark, tmp_path):
    for run, iid, text in [("base", "a", json.dumps(good())), ("base", "b", '{"instance_id": '), ("probe", "a", json.dumps(good(), indent=1))]:
        folder = tmp_path / run / iid
        folder.mkdir(parents=True)
        (folder / "result.json").write_text(text)
    out = readers.read_results(spark, str(tmp_path), SCHEMA.replace("instance_id string, ", ""), r"/([^/]+)/([^/]+)/result\.json$")
    got = {(r.run, r.instance_id): (r.unreadable, r.eval.resolved if r.eval else None) for r in out.collect()}
    assert got == {("base", "a"): (False, True), ("base", "b"): (True, None), ("probe", "a"): (False, True)}


def many(n):
    """A valid row of ``n`` tests, half of them named by their first word."""
    row, names = good(), [f"t/a.py::n{i}" if i % 2 else f"t/a.py::n{i}[x y]" for i in range(n)]
    ev, keys = row["eval"], [name.split()[0] for name in names]
    tests = [{"kind": "test", "nodeid": name, "when": w, "outcome": "passed", "wasxfail": False} for w in ("teardown", "setup", "call") for name in reversed(names)]
    ev |= {"f2p_statuses": {k: "PASSED" for k in keys[: n // 2]}, "p2p_statuses": {k: "PASSED" for k in keys[n // 2 :]}, "collected_nodes": names, "node_mapping": dict(zip(keys, names))}
    ev |= {"n_f2p": n // 2, "n_f2p_pass": n // 2, "n_p2p": n - n // 2, "n_p2p_ok": n - n // 2}
    row["n_f2p"] = n // 2
    ev["collection_events"][0]["nodes"], ev["test_events"] = names, tests + ev["test_events"][-1:]
    ev["requested_nodes_sha256"] = hashlib.sha256(json.dumps(keys, ensure_ascii=True, separators=(",", ":")).encode()).hexdigest()
    return sign(row)


def test_evidence_takes_time_in_proportion_to_the_tests(spark):
    took = []
    for n in (100, 1_000, 10_000):
        start = time.time()
        assert judge(spark, many(n)) == []
        took.append(time.time() - start)
    assert took[2] < 30
    wrong = many(1_000)
    wrong["eval"]["test_events"][1_500]["outcome"] = "failed"
    assert "status_disagrees" in judge(spark, sign(wrong))


def test_statuses_of_all_phase_patterns(spark):
    """Every combination of reports of one test, repeats and foreign phases too, against a plain reading."""
    from itertools import product

    def plain(reports):
        first = {w: next((r for r in reports if r[1] == w), None) for w in grader.PHASES}
        setup, call, teardown = first["setup"], first["call"], first["teardown"]
        is_ = lambda r, o: r is not None and r[2] == o
        if is_(setup, "failed") or is_(teardown, "failed"):
            return "ERROR"
        if is_(call, "failed"):
            return "FAILED"
        if setup is None or not is_(teardown, "passed"):
            return None
        if is_(setup, "skipped"):
            return "XFAIL" if setup[3] else "SKIPPED"
        if call is None:
            return None
        if is_(call, "skipped"):
            return "XFAIL" if call[3] else "SKIPPED"
        return "XPASS" if call[3] else "PASSED"

    options = [None, ("passed", False), ("failed", False), ("skipped", True), ("skipped", False), ("passed", True)]
    reports, want = [], {}
    for i, picked in enumerate(product(options, repeat=3)):
        own = [(f"n{i}", w, *o) for w, o in zip(("call", "teardown", "setup"), picked) if o]
        own += [(f"n{i}", "call", "failed", False), (f"n{i}", "setup", "failed", False)] if i % 3 == 0 and own else []
        own += [(f"n{i}", "other", "failed", False)] * (i % 2)
        reports += own
        want[f"n{i}"] = plain(own)
    random.Random(1).shuffle(order := list(dict.fromkeys(r[0] for r in reports)))
    reports = [r for n in order for r in reports if r[0] == n]
    df = spark.createDataFrame([(reports,)], "r array<struct<nodeid:string,when:string,outcome:string,wasxfail:boolean>>")
    got = df.select(grader.phase_statuses(F.col("r")).alias("s")).first().s
    assert {x.node: x.status for x in got} == {n: s for n, s in want.items() if s}


def opened_files(df):
    """Files that the scans of an executed plan handed to tasks and read content from."""
    def leaves(plan):
        while plan.nodeName() == "AdaptiveSparkPlan" or "QueryStage" in plan.nodeName():
            plan = plan.plan() if "QueryStage" in plan.nodeName() else plan.executedPlan()
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        return [x for c in children for x in leaves(c)] if children else [plan]

    scans = [p for p in leaves(df._jdf.queryExecution().executedPlan()) if p.nodeName().startswith("Scan binaryFile")]
    return sum(p.metrics().apply("numFiles").value() for p in scans if "content" in p.requiredSchema().simpleString())


def session(said, ts=None, role="user"):
    return json.dumps(({"ts": ts} if ts is not None else {}) | {"request": {"messages": [{"role": "system", "content": "x"}, {"role": role, "content": said}]}})


def test_session_files(spark, tmp_path):
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    stem, files = "0" * 32, {}
    files[f"{stem}.json"] = (session("  fix it\n", 100.0), 100)
    files[f"{'1' * 32}.json"] = (session('"say \\"hi\\" "', 5000.0), 5000)
    files[f"{'2' * 32}.json"] = (session([{"type": "text", "text": "fix"}, {"type": "image", "text": "no"}, {"type": "text", "text": " it"}], 200.0), 200)  # the key of the first
    files[f"{'3' * 32}.json"] = (session("late by its own time", 90_000.0), 150)
    files[f"{'4' * 32}.json"] = (session("no time in it"), 150)
    files[f"{'5' * 32}.json"] = ('{"ts": 5', 150)
    files[f"{'6' * 32}.json"] = (session("nobody asks", 150.0, role="assistant"), 150)
    files[f"{stem}.compact2.json"] = ('{"ts": 300.0}', 300)
    files[f"{stem}.post2.json"] = ('{"ts": 90000.0}', 90_000)
    files[f"{stem}.other.json"] = files["x.json"] = ("{}", 150)
    (tmp_path / "below").mkdir()
    for name, (text, modified) in files.items():
        path = tmp_path / ("below" if name.startswith("4") else "") / name
        path.write_text(text)
        os.utime(path, (modified, modified))
    found = lambda df: sorted((r.key, r.segment, r.segment_index, r.ts) for r in df.collect())
    main = [(md5("fix it"), "main", 0, 200.0), (md5('say "hi"'), "main", 0, 5000.0), (md5("no time in it"), "main", 0, 150.0)]
    windowed = readers.read_sessions(spark, str(tmp_path), since=50.0, until=400.0)
    assert found(windowed) == sorted([main[0], main[2], (stem, "compact", 2, 300.0)])
    assert opened_files(windowed) == 7  # one main file and one segment were changed too late, two names are no session's
    everything = readers.read_sessions(spark, str(tmp_path))
    late = (md5("late by its own time"), "main", 0, 90_000.0)
    assert found(everything) == sorted([*main, late, (stem, "compact", 2, 300.0), (stem, "post", 2, 90_000.0)])
    assert opened_files(everything) == 7  # the main files; segments are known by name and time
    only = readers.read_sessions(spark, str(tmp_path), since=50.0, until=400.0, main_only=True)
    assert found(only) == sorted([main[0], main[2]]) and opened_files(only) == 6
    assert found(readers.read_sessions(spark, [str(tmp_path)], until=120.0)) == [(md5("fix it"), "main", 0, 100.0)]


def test_archive_prefers_the_plain_copy(spark, tmp_path):
    import gzip

    (tmp_path / "a.json").write_text('{"v": 1}')
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"v": 2}')
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write('{"v": 3}')
    pattern = r"/([^/]+\.json)(?:\.gz)?$"
    out = readers.read_archive(spark, str(tmp_path), pattern).collect()
    assert {r.logical_name: (r.is_gz, json.loads(r.value)["v"]) for r in out} == {"a.json": (False, 1), "b.json": (True, 3)}
    (tmp_path / "c.json.gz").write_bytes(b"no gzip at all")
    with pytest.raises(Exception):
        readers.read_archive(spark, str(tmp_path), pattern).collect()


def test_publish_never_replaces(spark, tmp_path):
    path = str(tmp_path / "summary")
    done = spark.createDataFrame([(True, 3)], "complete boolean, n int")
    with pytest.raises(sinks.Refused):
        sinks.publish(done.withColumn("complete", F.lit(False)), path)
    sinks.publish(done, path)
    with pytest.raises(sinks.Refused):
        sinks.publish(done, path)
    assert spark.read.json(path).count() == 1


def test_ledger_resumes(spark, tmp_path):
    path = str(tmp_path / "ledger")
    sinks.append_results(spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int"), path, "id")
    sinks.append_results(spark.createDataFrame([("b", 2), ("c", 2), ("c", 2)], "id string, v int"), path, "id")
    assert sorted((r.id, r.v) for r in spark.read.schema("id string, v int").json(path).collect()) == [("a", 1), ("b", 1), ("c", 2)]


def test_split_refuses_overlap_and_duplicates(spark):
    from rungauge.operators import curation

    held = spark.createDataFrame([("h",)], "id string")
    ok = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    curation.require_pure(ok, held, "id", "text")
    for extra in [("h", "z"), ("a", "z"), ("c", "  ")]:
        with pytest.raises(ValueError):
            curation.require_pure(ok.unionByName(spark.createDataFrame([extra], "id string, text string")), held, "id", "text")


def test_texts_equal_up_to_blanks_share_a_side(spark):
    from rungauge.operators import curation

    data = [(f"t{i}", f"task number {i}") for i in range(100)] + [("twin", "task   number\n7 ")]
    out = curation.bucket_split(spark.createDataFrame(data, "id string, text string"), "id", "text")
    side = {r.id: r.split for r in out.collect()}
    assert len(side) == 101 and side["twin"] == side["t7"] and set(side.values()) == {"train", "validation"}
    group = hashlib.sha256(b"task number 3").hexdigest()
    bucket = int(hashlib.sha256(("critic-v1:" + group).encode()).hexdigest(), 16) % 10
    assert out.where("id = 't3'").first().bucket == bucket


def test_gate_from_files(spark, tmp_path):
    def put(path, row):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(row if isinstance(row, str) else json.dumps(row))

    def run(name, shards=("s0", "s1")):
        out = grader.gate_files(spark, str(tmp_path / name / "ids.json"), [str(tmp_path / name / s) for s in shards], SCHEMA, 80).first()
        return out, dict(p.rsplit("=", 1) for p in out.problems)

    def row(i):
        return dict(good(), instance_id=i)

    manifest = '["a", "b", "c"]\n'
    for name in ("whole", "wrong"):
        put(f"{name}/ids.json", manifest)
        put(f"{name}/s0/a/result.json", row("a"))
        put(f"{name}/s0/a/other.json", "not read")
        put(f"{name}/s1/b/result.json", row("b"))
        put(f"{name}/s1/c/result.json", row("c"))
    out, _ = run("whole")
    assert out.complete and (out.n_expected, out.n_resolved) == (3, 3) and out.ids_sha256 == hashlib.sha256(manifest.encode()).hexdigest()
    put("wrong/s0/a/result.json", row("b"))  # another task's result
    put("wrong/s1/c/result.json", dict(good(), instance_id=None))
    put("wrong/s1/deep/d/result.json", row("d"))
    put("wrong/s0/b/result.json", "")  # b is there twice, once unreadable
    put("wrong/s0/e/result.json", row("e"))
    os.symlink(tmp_path / "wrong/s1/b", tmp_path / "wrong/s0/f")
    out, problems = run("wrong")
    want = {"misplaced:id_disagrees": 1, "misplaced:missing_id": 1, "misplaced:unexpected_layout": 1, "missing": 2, "duplicate": 1, "unreadable": 1, "extra": 1}
    assert not out.complete and out.n_resolved is None
    links = int(problems.pop("misplaced:unexpected_layout"))
    want.pop("misplaced:unexpected_layout")
    assert links in (1, 2) and {k: int(v) for k, v in problems.items()} == want
    for bad in ("[]", '["a", "a"]', '["a", " "]', "[1]", '{"a": 1}', '["a"] x', ""):
        put("whole/ids.json", bad)
        with pytest.raises(ValueError, match="distinct ids"):
            run("whole")
    put("whole/ids.json", manifest)
    for shards in ((), ("s0", "s0"), ("s0", "s0/a"), ("s0", "s0/")):
        with pytest.raises(ValueError, match="overlap"):
            run("whole", shards)


def test_escaped_texts_are_those_of_json(spark):
    texts = ["", "a", "ü", "aü", "üa", "aüéb😀c😀😀", "😀", "t/a.py::x[€-\"\\]", "编码 ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    assert {r.t: r.j for r in df.select("t", grader.ascii_json(F.col("t")).alias("j")).collect()} == {t: json.dumps(t) for t in texts}
