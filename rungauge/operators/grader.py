"""Grading: test logs and event streams to statuses, evidence checks, gates, redaction."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungauge.functions import text as tx
from rungauge.functions.guards import truthy, violations
from rungauge.operators.trajectories import REDACTED_KEYS
from rungauge.shared import cut_lineage
from rungauge.sources.readers import read_manifest, read_shards

# Fixed values of the test report formats.
ANSI = r"\x1b\[[0-?]*[ -/]*[@-~]"
STATUSES = "PASSED|FAILED|ERROR|SKIPPED|XFAIL|XPASS"
STATUS_FIRST = rf"^\s*({STATUSES})\s+(.+?)\s*$"
STATUS_LAST = rf"^\s*(.+?)\s+({STATUSES})(?:\s+\[\s*\d+%\])?\s*$"
PASSING = ["PASSED", "XFAIL"]
PHASES = ["setup", "call", "teardown"]
OUTCOMES = ["passed", "failed", "skipped"]
PROTOCOL = "pytest-structured-v1"
SCOPE = "f2p_same_files"


def log_statuses(logs: DataFrame, run: Sequence[str], text: str) -> DataFrame:
    """Status per (run, test) from a log; different repeats are CONFLICT, counted beside."""
    lines = logs.select(*run, F.explode(tx.lines(F.regexp_replace(text, ANSI, ""))).alias("_line"))
    line = F.col("_line")
    first, last = line.rlike(STATUS_FIRST), line.rlike(STATUS_LAST)
    found = lines.where(first | last).select(
        *run,
        F.when(first, F.regexp_extract(line, STATUS_FIRST, 1)).otherwise(F.regexp_extract(line, STATUS_LAST, 2)).alias("_status"),
        F.when(first, F.regexp_extract(line, STATUS_FIRST, 2)).otherwise(F.regexp_extract(line, STATUS_LAST, 1)).alias("_node"),
    )
    node = F.substring_index("_node", " - ", 1)
    per = found.groupBy(*run, node.alias("node")).agg(
        F.min("_status").alias("_lo"), F.max("_status").alias("_hi"), F.count("*").alias("n_lines")
    )
    return per.select(
        *run, "node", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise("CONFLICT").alias("status"), "n_lines"
    )


def run_phase_statuses(events: DataFrame, run: Sequence[str]) -> DataFrame:
    """Status per (run, nodeid) from setup, call and teardown reports.

    A repeated phase is CONFLICT; success needs every phase; a real failure
    counts even when later phases are missing.
    """
    valid = F.col("when").isin(PHASES) & F.col("outcome").isin(OUTCOMES) & F.col("wasxfail").isNotNull()
    columns = []
    for phase in PHASES:
        here = F.col("when") == phase
        columns += [
            F.count_if(here).alias(f"_n_{phase}"),
            F.max(F.when(here, F.col("outcome"))).alias(f"_o_{phase}"),
            F.bool_or(F.when(here, F.col("wasxfail"))).alias(f"_x_{phase}"),
        ]
    per = events.groupBy(*run, "nodeid").agg(*columns, F.count_if(~truthy(valid)).alias("_invalid"))
    setup, call, teardown = (F.col(f"_o_{p}") for p in PHASES)
    status = (
        F.when(F.col("_invalid") > 0, "INVALID")
        .when(F.greatest(*[F.col(f"_n_{p}") for p in PHASES]) > 1, "CONFLICT")
        .when(truthy(setup == "failed") | truthy(teardown == "failed"), "ERROR")
        .when(truthy(call == "failed"), "FAILED")
        .when(setup.isNull() | ~truthy(teardown == "passed"), "MISSING")
        .when(setup == "skipped", F.when(F.col("_x_setup"), "XFAIL").otherwise("SKIPPED"))
        .when(call.isNull(), "MISSING")
        .when(call == "skipped", F.when(F.col("_x_call"), "XFAIL").otherwise("SKIPPED"))
        .otherwise(F.when(F.col("_x_call"), "XPASS").otherwise("PASSED"))
    )
    return per.select(*run, "nodeid", status.alias("status"))


def package_statuses(events: DataFrame, run: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Status per (run, package, test): one run followed by one outcome, else CONFLICT; a run alone is MISSING."""
    at = F.struct(*order)
    is_run, ended = F.col("action") == "run", F.col("action").isin("pass", "fail", "skip")
    per = events.where(F.col("test").isNotNull() & (F.col("test") != "") & (is_run | ended)).groupBy(*run, "package", "test").agg(
        F.count_if(is_run).alias("_runs"),
        F.count_if(ended).alias("_ends"),
        F.max(F.when(is_run, at)).alias("_run_at"),
        F.min(F.when(ended, at)).alias("_end_at"),
        F.max(F.when(ended, F.col("action"))).alias("_action"),
    )
    one = (F.col("_runs") == 1) & (F.col("_ends") == 1) & (F.col("_run_at") < F.col("_end_at"))
    named = F.when(F.col("_action") == "pass", "PASSED").when(F.col("_action") == "fail", "FAILED").otherwise("SKIPPED")
    status = F.when(one, named).when((F.col("_runs") == 1) & (F.col("_ends") == 0), "MISSING").otherwise("CONFLICT")
    return per.select(*run, "package", "test", status.alias("status"))


def package_outcomes(events: DataFrame, run: Sequence[str]) -> DataFrame:
    """Outcome per (run, package), apart from its tests; a second outcome is CONFLICT."""
    ended = F.col("action").isin("pass", "fail", "skip")
    per = events.where((F.col("test").isNull() | (F.col("test") == "")) & ended).groupBy(*run, "package").agg(
        F.count("*").alias("_n"), F.max("action").alias("_a")
    )
    named = F.when(F.col("_a") == "pass", "PASSED").when(F.col("_a") == "fail", "FAILED").otherwise("SKIPPED")
    return per.select(*run, "package", F.when(F.col("_n") == 1, named).otherwise("CONFLICT").alias("status"))


def collection_audit(events: DataFrame, run: Sequence[str]) -> DataFrame:
    """Per run: exactly one collection of unique non-empty ids, one finish with 0, no error; else the cause."""
    nodes = F.when(F.col("kind") == "collection", F.col("nodes"))
    finish = F.col("kind") == "session_finish"
    bad_ids = (
        nodes.isNull() | (F.size(nodes) == 0) | F.exists(nodes, lambda n: n.isNull() | (n == ""))
        | (F.size(F.array_distinct(nodes)) < F.size(nodes))
    )
    per = events.groupBy(*run).agg(
        F.count_if(F.col("kind") == "collection").alias("_c"),
        F.count_if(finish).alias("_f"),
        F.count_if(finish & truthy(F.col("exitstatus") == 0)).alias("_f0"),
        F.count_if(F.col("kind") == "collection_error").alias("_e"),
        F.count_if((F.col("kind") == "collection") & truthy(bad_ids)).alias("_b"),
    )
    cause = (
        F.when((F.col("_c") != 1) | (F.col("_f") != 1) | (F.col("_f0") != 1) | (F.col("_e") > 0), "incomplete_or_failed")
        .when(F.col("_b") > 0, "invalid_or_duplicate_ids")
    )
    return per.select(*run, cause.isNull().alias("valid"), cause.alias("cause"))


# --- evaluation rows ---------------------------------------------------------------


def _status_rules(statuses: Column, total: Column, passed: Column, timed_out: Column, name: str):
    values = F.map_values(statuses)
    allowed = ["PASSED", "XFAIL", "FAILED", "ERROR", "SKIPPED", "XPASS"]
    legal = F.forall(values, lambda v: v.isin(allowed) | (truthy(timed_out) & (v == "MISSING")))
    named = F.forall(F.map_keys(statuses), lambda k: k != "")
    recount = F.size(F.filter(values, lambda v: v.isin(PASSING)))
    return [
        (f"{name}_inconsistent", statuses.isNull() | (F.size(statuses) != total)),
        (f"{name}_unknown_status", statuses.isNotNull() & ~truthy(legal & named)),
        (f"{name}_pass_count", statuses.isNotNull() & ~truthy(recount == passed)),
    ]


def eval_violations(ev: str = "eval") -> Column:
    """Every broken rule of one result row, as names; an empty array is a valid row.

    Columns come from a scan with a declared schema, so a value of another type
    (a boolean where a number belongs) is already null, and null breaks the rule.
    A row with a protocol, or with evidence but no protocol, is structured: its
    evidence is judged too, whatever its flags say.
    """
    e = lambda f: F.col(f"{ev}.{f}")
    counts = ["n_f2p", "n_f2p_pass", "n_p2p", "n_p2p_ok"]
    evidence = ["evaluation_state", "report_intact", "collection_events", "test_events", "node_mapping"]
    structured = F.greatest(*[e(f).isNotNull() for f in ["grader_protocol", *evidence]])
    timed_out, resolved, rc = e("timed_out"), e("resolved"), e("pytest_rc")
    expected = ~timed_out & (e("n_f2p_pass") == e("n_f2p")) & (e("n_p2p_ok") == e("n_p2p"))
    rules = [
        ("runner_error", F.col("error").isNotNull() & (F.col("error") != "")),
        ("missing_eval", F.col(ev).isNull()),
        ("unknown_protocol", structured & ~truthy(e("grader_protocol") == PROTOCOL)),
        (
            "evaluation_incomplete",
            structured & (~truthy(e("evaluation_state") == "complete") | ~truthy(e("reward_eligible"))),
        ),
        (
            "evidence_incomplete",
            structured & (~truthy(e("report_intact")) | ~truthy(e("restore_rc") == 0) | ~truthy(e("collection_rc") == 0)),
        ),
        ("resolved_not_boolean", resolved.isNull()),
        ("eval_timed_out_not_boolean", timed_out.isNull()),
        ("timed_out_not_boolean", F.col("timed_out").isNull()),
        ("smith_rc_not_integer", ~truthy(F.col("smith_rc") >= 0)),
        ("pytest_rc_not_integer", ~truthy(rc >= 0)),
        *[(f"{c}_not_integer", ~truthy(e(c) >= 0)) for c in counts],
        (
            "invalid_counts",
            ~truthy((e("n_f2p") > 0) & (e("n_f2p_pass") <= e("n_f2p")) & (e("n_p2p_ok") <= e("n_p2p"))),
        ),
        ("n_f2p_mismatch", ~truthy((F.col("n_f2p") >= 1) & (F.col("n_f2p") == e("n_f2p")))),
        *_status_rules(e("f2p_statuses"), e("n_f2p"), e("n_f2p_pass"), timed_out, "f2p_statuses"),
        *_status_rules(e("p2p_statuses"), e("n_p2p"), e("n_p2p_ok"), timed_out, "p2p_statuses"),
        ("inconsistent_timeout", truthy(timed_out) & (~truthy(rc == 124) | truthy(resolved))),
        ("unavailable_rc", ~truthy(timed_out) & ~truthy(rc.isin(0, 1))),
        ("resolved_disagrees", ~truthy(resolved == expected)),
    ]
    # Without an eval object only the first two rules speak.
    own = F.when(F.col(ev).isNull(), violations(rules[:2])).otherwise(violations(rules))
    return F.concat(own, F.when(truthy(structured), evidence_violations(ev)).otherwise(F.array().cast("array<string>")))


def ascii_json(value: Column) -> Column:
    """A text as a JSON string with every non-ASCII character escaped."""
    unit = lambda u: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(u)), 4, "0"))

    def escape(ch: Column) -> Column:
        return tx.let(
            F.ascii(ch),
            lambda code: F.when(code < 128, ch).when(code < 0x10000, unit(code)).otherwise(
                F.concat(
                    unit(F.shiftright(code - 0x10000, 10) + 0xD800), unit((code - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00)
                )
            ),
        )

    def text(quoted: Column) -> Column:
        # Runs of ASCII characters are one piece, every other character (two code units or one) is one of its own.
        wide = F.array_join(F.transform(F.split(quoted, r"(?![\udc00-\udfff])(?:(?<=[^\x00-\x7f])|(?=[^\x00-\x7f]))"), escape), "")
        return F.when(quoted.rlike(r"[^\x00-\x7f]"), wide).otherwise(quoted)

    whole = F.to_json(F.struct(value.alias("v")))
    return tx.let(tx.let(whole, lambda j: F.substring(j, F.lit(6), F.length(j) - 6)), text)


def event_line(event: Column) -> Column:
    """The report line of one event, byte for byte as its writer wrote it."""
    nodes = F.array_join(F.transform(event["nodes"], ascii_json), ", ")
    flag = F.when(event["wasxfail"], "true").otherwise("false")
    test = F.concat(
        F.lit('{"kind": "test", "nodeid": '), ascii_json(event["nodeid"]), F.lit(', "when": "'), event["when"],
        F.lit('", "outcome": "'), event["outcome"], F.lit('", "wasxfail": '), flag, F.lit("}\n"),
    )
    collection = F.concat(F.lit('{"kind": "collection", "nodes": ['), nodes, F.lit("]}\n"))
    finish = F.concat(F.lit('{"kind": "session_finish", "exitstatus": '), event["exitstatus"].cast("string"), F.lit("}\n"))
    error = F.concat(F.lit('{"kind": "collection_error", "nodeid": '), ascii_json(event["nodeid"]), F.lit("}\n"))
    return F.coalesce(
        F.when(event["kind"] == "test", test)
        .when(event["kind"] == "collection", collection)
        .when(event["kind"] == "session_finish", finish)
        .when(event["kind"] == "collection_error", error),
        F.lit("?\n"),
    )


def events_digest(events: Column) -> Column:
    return F.sha2(F.array_join(F.transform(events, event_line), ""), 256)


def nodes_digest(nodes: Column) -> Column:
    """Digest of a list of ids as compact JSON."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(nodes, ascii_json), ","), F.lit("]")), 256)


def _status(setup: Column, call: Column, teardown: Column) -> Column:
    """Status of one test from its phase reports; null when a success is not fully reported."""
    return (
        F.when(truthy(setup["outcome"] == "failed") | truthy(teardown["outcome"] == "failed"), "ERROR")
        .when(truthy(call["outcome"] == "failed"), "FAILED")
        .when(setup.isNull() | ~truthy(teardown["outcome"] == "passed"), None)
        .when(setup["outcome"] == "skipped", F.when(setup["wasxfail"], "XFAIL").otherwise("SKIPPED"))
        .when(call.isNull(), None)
        .when(call["outcome"] == "skipped", F.when(call["wasxfail"], "XFAIL").otherwise("SKIPPED"))
        .otherwise(F.when(call["wasxfail"], "XPASS").otherwise("PASSED"))
    )


def phase_statuses(reports: Column) -> Column:
    """array<struct<node, status>> of all tests with a status, from the phase reports of one run.

    Reports are sorted once by node and phase; the first of each phase counts, so a
    node's phases are neighbours and nothing is searched.
    """
    rank = lambda r: F.array_position(F.array(*[F.lit(p) for p in PHASES]), r["when"])
    known = F.filter(reports, lambda r: truthy(r["when"].isin(PHASES)) & r["nodeid"].isNotNull())
    placed = F.transform(known, lambda r, i: F.struct(r["nodeid"].alias("node"), rank(r).alias("phase"), i.alias("i"), r["outcome"].alias("outcome"), r["wasxfail"].alias("wasxfail")))

    def firsts(rows: Column) -> Column:
        before = lambda i: F.get(rows, i - 1)
        return F.filter(rows, lambda x, i: (i == 0) | (before(i)["node"] != x["node"]) | (before(i)["phase"] != x["phase"]))

    def statuses(rows: Column) -> Column:
        def of(x: Column, i: Column, phase: int) -> Column:
            near = [F.get(rows, i + d) for d in range(phase)]  # a phase stands at most as far from the node's first as its rank
            return F.coalesce(*[F.when((c["node"] == x["node"]) & (c["phase"] == phase), c) for c in near])

        begins = lambda x, i: (i == 0) | (F.get(rows, i - 1)["node"] != x["node"])
        each = F.transform(rows, lambda x, i: F.when(begins(x, i), F.struct(x["node"].alias("node"), _status(of(x, i, 1), of(x, i, 2), of(x, i, 3)).alias("status"))))
        return F.filter(each, lambda x: x["status"].isNotNull())

    return tx.let(tx.let(F.array_sort(placed), firsts), statuses)


def evidence_violations(ev: str = "eval") -> Column:
    """Broken rules of the structured evidence of one row: every outcome is recomputed, no flag is trusted."""
    e = lambda f: F.col(f"{ev}.{f}")
    collection, tests = e("collection_events"), e("test_events")
    collections = F.filter(collection, lambda x: x["kind"] == "collection")
    f2p, p2p = e("f2p_statuses"), e("p2p_statuses")
    # What several rules look at, computed once per row.
    shared = F.struct(
        F.size(collections).alias("n_collections"),
        F.try_element_at(collections, F.lit(1))["nodes"].alias("available"),
        F.transform(F.filter(collection, lambda x: x["kind"] == "session_finish"), lambda x: x["exitstatus"]).alias("c_finish"),
        F.transform(F.filter(tests, lambda x: x["kind"] == "session_finish"), lambda x: x["exitstatus"]).alias("t_finish"),
        F.filter(tests, lambda x: x["kind"] == "test").alias("reports"),
        F.coalesce(phase_statuses(F.filter(tests, lambda x: x["kind"] == "test")), F.array().cast("array<struct<node:string,status:string>>")).alias("statuses"),
        F.concat(F.map_keys(f2p), F.map_keys(p2p)).alias("requested"),
        F.map_entries(e("node_mapping")).alias("mapping"),
        F.map_values(e("node_mapping")).alias("used"),
        F.transform(F.map_keys(f2p), lambda n: F.substring_index(n, "::", 1)).alias("files"),
    )
    return tx.let(shared, lambda v: _evidence_rules(e, v, f2p, p2p, collection, tests))


def _evidence_rules(e, v: Column, f2p: Column, p2p: Column, collection: Column, tests: Column) -> Column:
    available, reports, used, requested = v["available"], v["reports"], v["used"], v["requested"]
    first_word = lambda n: F.try_element_at(F.split(tx.strip(n), rf"[{tx.BLANK}]+"), F.lit(1))

    # Sets of texts are compared as sets, which takes time in proportion to their sizes.
    within = lambda part, whole: F.size(F.array_except(part, whole)) == 0
    apart = lambda left, right: F.size(F.array_intersect(left, right)) == 0
    none = F.array().cast("array<string>")

    same = F.transform(F.filter(v["mapping"], lambda x: truthy(x["key"] == x["value"])), lambda x: x["key"])
    other = F.filter(v["mapping"], lambda x: ~truthy(x["key"] == x["value"]))
    other_keys, other_nodes = F.transform(other, lambda x: x["key"]), F.transform(other, lambda x: x["value"])
    words = F.array_sort(F.transform(available, first_word))
    repeated = tx.let(words, lambda w: F.filter(w, lambda x, i: (i > 0) & truthy(x == F.get(w, i - 1))))
    # A collected node maps to itself; another one to the only node that begins with its first word.
    exact = (
        within(same, available) & within(other_nodes, available) & apart(other_keys, available) & apart(other_keys, repeated)
        & F.forall(other, lambda x: truthy(first_word(x["value"]) == x["key"]))
    )

    def agrees(statuses: Column) -> Column:
        pair = lambda node, status: F.concat(node, F.lit("\x1f"), status)
        found = F.transform(statuses, lambda x: pair(x["node"], x["status"]))

        def told(claims: Column) -> Column:
            claimed = F.map_values(F.map_zip_with(e("node_mapping"), claims, lambda _, full, status: pair(full, status)))
            return claims.isNull() | within(F.filter(claimed, lambda x: x.isNotNull()), found)

        return within(used, F.transform(statuses, lambda x: x["node"])) & told(f2p) & told(p2p)

    phase_keys = F.transform(reports, lambda r: F.concat_ws("\x1f", r["nodeid"], r["when"]))
    valid_report = within(F.transform(reports, lambda r: r["nodeid"]), used) & F.forall(
        reports,
        lambda r: r["nodeid"].isNotNull() & r["when"].isin(PHASES) & r["outcome"].isin(OUTCOMES) & r["wasxfail"].isNotNull(),
    )
    seen = F.array_distinct(F.transform(reports, lambda r: r["nodeid"]))
    keys = F.transform(v["mapping"], lambda x: x["key"])
    return violations(
        [
            ("restore_rc", ~truthy(e("restore_rc") == 0)),
            ("collection_rc", ~truthy(e("collection_rc") == 0)),
            ("scope", ~truthy(e("p2p_scope") == SCOPE)),
            ("collection_events", ~truthy(F.size(collection) > 0)),
            ("test_events", ~truthy(F.size(tests) > 0)),
            ("collection_hash", ~truthy(events_digest(collection) == e("collection_sha256"))),
            ("report_hash", ~truthy(events_digest(tests) == e("report_sha256"))),
            ("collection_unknown", ~truthy(F.forall(collection, lambda x: x["kind"].isin("collection", "session_finish")))),
            ("collection_incomplete", ~truthy((v["n_collections"] == 1) & (v["c_finish"] == F.array(F.lit(0))))),
            (
                "collected_nodes",
                ~truthy(
                    (F.size(available) > 0) & F.forall(available, lambda n: n.isNotNull() & (n != ""))
                    & (F.size(F.array_distinct(available)) == F.size(available)) & (e("collected_nodes") == available)
                ),
            ),
            ("requested_hash", ~truthy(nodes_digest(requested) == e("requested_nodes_sha256"))),
            (
                "mapping_cover",
                ~truthy(
                    (F.size(F.array_except(keys, requested)) == 0)
                    & (F.size(F.array_except(requested, keys)) == 0)
                ),
            ),
            (
                "mapping_exact",
                ~truthy(((F.size(v["mapping"]) == 0) | truthy(exact)) & (F.size(F.array_distinct(used)) == F.size(used))),
            ),
            (
                "p2p_outside_scope",
                ~truthy(within(F.transform(F.map_keys(p2p), lambda n: F.substring_index(n, "::", 1)), F.coalesce(v["files"], none))),
            ),
            ("execution_finish", ~truthy(v["t_finish"] == F.array(e("pytest_rc")))),
            (
                "execution_unknown",
                ~truthy(F.forall(tests, lambda x: x["kind"].isin("collection", "session_finish", "test"))),
            ),
            ("invalid_phase", ~truthy(valid_report)),
            ("duplicate_phase", ~truthy(F.size(F.array_distinct(phase_keys)) == F.size(phase_keys))),
            (
                "missing_reports",
                ~truthy((F.size(F.array_except(used, seen)) == 0) & (F.size(F.array_except(seen, used)) == 0)),
            ),
            ("status_disagrees", ~truthy(agrees(v["statuses"]))),
            ("resolved_nonzero_rc", truthy(e("resolved")) & ~truthy(e("pytest_rc") == 0)),
        ]
    )


def gate(planned: DataFrame, results: DataFrame, key: str, step: int, manifest: str | None = None) -> DataFrame:
    """One row: the run's summary when it is whole and every row valid, else its problems.

    ``results`` carries ``violations`` and ``unreadable``, and may carry ``misplaced``:
    such a row speaks for no id and is a problem of its own.  Counts of what was
    resolved are null unless the run is complete, so a failed gate can not be
    read as a score.  Problems are counted by kind; the rows behind them are
    ``gate_problems``.  ``manifest`` is the digest of the plan's file, for the summary.
    """
    # Judging a row is costly, so what the gate needs of it is written once.
    facts = cut_lineage(
        results.select(
            key,
            F.col("eval.resolved").alias("resolved"),
            F.col("eval.timed_out").alias("eval_timed_out"),
            "timed_out",
            "smith_rc",
            "unreadable",
            F.slice("violations", 1, 1).alias("violations"),
            *(["misplaced"] if "misplaced" in results.columns else []),
        ),
        "gate",
    )
    problems = gate_problems(planned, facts, key).groupBy("problem").agg(F.count("*").alias("n"))
    # Kinds of problems are few; ids behind them are not gathered.
    kinds = problems.agg(
        F.array_sort(F.collect_list(F.concat_ws("=", "problem", F.col("n").cast("string")))).alias("problems"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_problems"),
    )
    n_expected = planned.agg(F.count("*")).scalar()
    placed = facts.where("misplaced is null") if "misplaced" in facts.columns else facts
    sums = placed.agg(
        F.count("*").alias("n_observed"),
        F.count_if(truthy(F.col("resolved"))).alias("_r"),
        F.count_if(truthy(F.col("timed_out"))).alias("_t"),
        F.count_if(truthy(F.col("eval_timed_out"))).alias("_e"),
        F.count_if(truthy(F.col("smith_rc") == 124)).alias("_o"),
    )
    one = kinds.withColumn("_one", F.lit(1))
    out = sums.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")  # one row each
    complete = (F.col("n_problems") == 0) & (F.col("n_observed") > 0)
    return out.withColumn("n_expected", n_expected).select(
        *([] if manifest is None else [F.lit(manifest).alias("ids_sha256")]),
        F.lit(step).alias("checkpoint_step"),
        complete.alias("complete"),
        "n_expected",
        "n_observed",
        F.when(complete, F.col("_r")).alias("n_resolved"),
        F.when(complete, F.col("_r") / F.col("n_expected")).alias("resolved_rate"),
        F.when(complete, F.col("_t")).alias("n_trajectory_timeout"),
        F.when(complete, F.col("_e")).alias("n_eval_timeout"),
        F.when(complete, F.col("_o")).alias("n_outer_timeout_rc124"),
        "n_problems",
        "problems",
    )


def gate_problems(planned: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Rows (id, problem): duplicate and missing ids, ids outside the plan, unreadable, invalid and misplaced rows."""
    stray = None
    if "misplaced" in results.columns:
        stray = results.where("misplaced is not null").select(F.col(key).alias("id"), F.concat(F.lit("misplaced:"), "misplaced").alias("problem"))
        results = results.where("misplaced is null")
    plan = planned.select(F.col(key).alias("_id")).groupBy("_id").agg(F.count("*").alias("_planned"))
    got = results.groupBy(F.col(key).alias("_rid")).agg(
        F.count("*").alias("_seen"),
        F.bool_or(F.coalesce("unreadable", F.lit(False))).alias("_unreadable"),
        F.max(F.when(F.size("violations") > 0, F.element_at("violations", 1))).alias("_violation"),
    )
    joined = plan.join(got, F.col("_id") == F.col("_rid"), "full")
    found = violations(
        [
            ("duplicate_planned", F.col("_planned") > 1),
            ("missing", F.col("_rid").isNull()),
            ("extra", F.col("_id").isNull()),
            ("duplicate", F.col("_seen") > 1),
            ("unreadable", F.col("_unreadable")),
        ]
    )
    invalid = F.when(F.col("_violation").isNotNull(), F.array(F.concat(F.lit("invalid:"), F.col("_violation"))))
    out = joined.select(
        F.coalesce("_id", "_rid").alias("id"),
        F.explode(F.concat(found, F.coalesce(invalid, F.array().cast("array<string>")))).alias("problem"),
    )
    return out if stray is None else out.unionByName(stray)


def gate_files(spark: SparkSession, manifest: str, shards: Sequence[str], schema: str, step: int, key: str = "instance_id") -> DataFrame:
    """The gate of a run from its files: manifest and shard folders to the one summary row.

    ``key`` of a readable result is compared with its folder; an unreadable one is
    known by its folder only.
    """
    planned, digest = read_manifest(spark, manifest, key)
    rows = read_shards(spark, shards, schema, key)
    none = F.array().cast("array<string>")
    judged = rows.withColumn("violations", F.when(F.col("unreadable"), none).otherwise(eval_violations()))
    return gate(planned, judged.withColumn(key, F.coalesce(key, "folder")), key, step, digest)


# --- redaction and audits -------------------------------------------------------------


def redact_map(values: Column) -> Column:
    """A flat map with secret-named values replaced."""
    return F.transform_values(
        values, lambda k, v: F.when(F.lower(k).isin(REDACTED_KEYS), F.lit("<redacted>")).otherwise(v)
    )


def _redacted(value, path, touched):
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            if k.lower() in REDACTED_KEYS:
                touched.append(path + k)
                out[k] = "<redacted>"
            else:
                out[k] = _redacted(v, path + k + ".", touched)
        return out
    if isinstance(value, list):
        return [_redacted(v, f"{path}{i}.", touched) for i, v in enumerate(value)]
    return value


@F.pandas_udf(
    T.StructType([T.StructField("json", T.StringType()), T.StructField("touched", T.ArrayType(T.StringType()))])
)
def redact_json(values: pd.Series) -> pd.DataFrame:
    """JSON text of any depth with secret-named fields replaced, and the paths that were."""
    texts, paths = [], []
    for text in values:
        touched: list[str] = []
        try:
            texts.append(None if text is None else json.dumps(_redacted(json.loads(text), "", touched), ensure_ascii=False))
        except ValueError:
            texts.append("<unparsed>")  # what can not be read can not be shown
            touched = ["<unparsed>"]
        paths.append(touched)
    return pd.DataFrame({"json": texts, "touched": paths})


def usage_audit(calls: DataFrame, keys: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Calls whose own token count is off the reported usage, by kind.

    ``pairs`` maps a kind to (own count, reported count).  Off means further than
    2 tokens and further than a twentieth; nothing is said where either is missing.
    """
    columns = []
    for kind, (got, expected) in pairs.items():
        known = truthy((F.col(expected) > 0) & (F.col(got) > 0))
        off = F.abs(F.col(got) - F.col(expected)) > F.greatest(F.lit(2), F.floor(F.col(expected) / 20))
        columns += [F.count_if(known).alias(f"n_{kind}"), F.count_if(known & off).alias(f"n_{kind}_mismatch")]
    return calls.groupBy(*keys).agg(*columns)


def sampled_ids(tokens: Column) -> Column:
    """Sampled ids from texts ``token_id:<n>``: all of them, or null when any has another form."""
    strict = r"^token_id:([0-9]+)$"
    ids = F.transform(tokens, lambda t: F.regexp_extract(t, strict, 1).try_cast("long"))
    return F.when((F.size(tokens) > 0) & F.forall(tokens, lambda t: truthy(t.rlike(strict))), ids)


def sampled_id_state(tokens: Column, stored: Column) -> Column:
    """ok, missing, mixed or disagree: what a response says about its sampled ids."""
    has = F.exists(tokens, lambda t: truthy(t.rlike(r"^token_id:[0-9]+$")))
    ids = sampled_ids(tokens)
    return (
        F.when(~truthy(F.size(tokens) > 0) | ~truthy(has), "missing")
        .when(ids.isNull(), "mixed")
        .when(stored.isNotNull() & (stored != ids), "disagree")
        .otherwise("ok")
    )


def trace_statistics(events: DataFrame, key: str, type_: str, tool: str, status: str, body: str) -> DataFrame:
    """Per trace: events and tool calls by kind as long rows, and token sums, overflows and errors.

    Counts by kind stay rows (key, kind, n): a trace with many kinds or events is
    never gathered.
    """
    low = F.lower(F.col(body))
    overflow = low.contains("contextoverflow") | low.contains("maximum context length") | low.contains("context overflow")

    def tokens(names: str) -> Column:
        found = tx.all_matches(F.col(body), rf'"(?:{names})"\s*:\s*(\d+)', 1)
        return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.try_cast("long"), F.lit(0)))

    kinds = F.array_compact(
        F.array(
            F.concat(F.lit("event:"), F.col(type_)),
            F.when(F.col(type_) == "tool_use", F.concat(F.lit("tool:"), F.col(tool), F.lit(":"), F.col(status))),
            F.when(F.lower(F.col(type_)).contains("compact"), F.lit("compaction")),
            F.when(overflow, F.lit("overflow")),
            F.when(F.col(type_) == "error", F.lit("error")),
        )
    )
    rows = events.select(
        key, F.explode(kinds).alias("kind"), tokens("prompt_tokens|input_tokens").alias("_p"), tokens("completion_tokens|output_tokens").alias("_c")
    )
    # Token sums are taken once per event, on its own event row.
    own = F.col("kind").startswith("event:")
    return rows.groupBy(key, "kind").agg(
        F.count("*").alias("n"),
        F.sum(F.when(own, F.col("_p")).otherwise(0)).cast("long").alias("prompt_tokens"),
        F.sum(F.when(own, F.col("_c")).otherwise(0)).cast("long").alias("completion_tokens"),
    )
