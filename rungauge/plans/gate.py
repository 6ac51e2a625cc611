"""Gate queries: result rows and their evidence, built from rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungauge.operators import grader as gd
from rungauge.plans import bindings as b
from rungauge.plans.registry import query
from rungauge.session import spread, spread_table, table
from rungauge.shared import fresh_folder
from rungauge.sources.files import write_files


EVENT = "struct<kind:string,nodes:array<string>,nodeid:string,when:string,outcome:string,wasxfail:boolean,exitstatus:int>"


def result_rows(spark, root, faults=True):
    """Rollouts as result rows; with ``faults`` some break one rule each, by the id.

    Status maps, and the structured evidence of every third row, are made from
    the counts, so a rollout of any length stays one row.
    """
    i = F.col("rollout_id")
    fault = lambda condition: condition if faults else F.lit(False)
    n_f2p, n_pass = F.col("n_f2p") + 1, F.col("n_f2p_pass")
    n_p2p, n_ok = F.col("n_p2p"), F.col("n_p2p_ok")

    def statuses(prefix: str, total, good, other):
        keys = F.transform(F.sequence(F.lit(1).cast("long"), total), lambda k: F.concat(F.lit(f"t.py::{prefix}"), k.cast("string")))
        values = F.transform(F.sequence(F.lit(1).cast("long"), total), lambda k: F.when(k <= good, "PASSED").otherwise(other))
        empty = F.create_map().cast("map<string,string>")
        return F.when(total > 0, F.map_from_arrays(keys, values)).otherwise(empty)

    timed_out = i % 17 == 3
    resolved = ~timed_out & (n_pass == n_f2p) & (n_ok == n_p2p)
    rows = spread(b.rollouts(spark, root), "rollout_id", b.table(spark, root, "orders")).select(
        i.alias("id"), F.when(fault(i % 13 == 2), "lost").alias("error"), (i % 19 == 1).alias("timed_out"), F.when(i % 23 == 1, 124).otherwise(0).alias("smith_rc"),
        (n_f2p + F.when(fault(i % 67 == 13), 1).otherwise(0)).alias("n_f2p"), n_f2p.alias("f"), n_pass.alias("fp"), n_p2p.alias("p"), n_ok.alias("ok"),
        timed_out.alias("t"), (resolved | fault(i % 31 == 5)).alias("resolved"),
        F.when(timed_out, F.when(fault(i % 2 == 1), 1).otherwise(124)).when(fault(i % 41 == 7), 2).otherwise(F.when(resolved, 0).otherwise(1)).alias("rc"),
        statuses("f", n_f2p, n_pass, F.when(fault(i % 29 == 4), "LOST").otherwise("FAILED")).alias("f2p"), statuses("p", n_p2p, n_ok, F.lit("FAILED")).alias("p2p"),
    )

    def event(**given):
        return F.struct(*[given.get(f.split(":")[0], F.lit(None)).cast(f.split(":")[1]).alias(f.split(":")[0]) for f in EVENT[7:-1].split(",")])

    def reports(entry):
        call = F.when(entry["value"] == "PASSED", "passed").otherwise("failed")
        return F.array(*[event(kind=F.lit("test"), nodeid=entry["key"], when=F.lit(w), outcome=call if w == "call" else F.lit("passed"), wasxfail=F.lit(False)) for w in ("setup", "call", "teardown")])

    i = F.col("id")
    nodes = F.concat(F.map_keys("f2p"), F.map_keys("p2p"))
    collection = F.array(event(kind=F.lit("collection"), nodes=nodes), event(kind=F.lit("session_finish"), exitstatus=F.lit(0)))
    tests = F.concat(F.flatten(F.transform(F.concat(F.map_entries("f2p"), F.map_entries("p2p")), reports)), F.array(event(kind=F.lit("session_finish"), exitstatus=F.col("rc"))))
    rows = rows.withColumn("nodes", nodes).withColumn("collection", collection).withColumn("tests", tests)
    st = i % 3 == 0
    only = lambda c: F.when(st, c)
    ev = F.struct(
        "resolved", F.when(~fault(i % 37 == 6), F.col("t")).alias("timed_out"), F.col("rc").alias("pytest_rc"),
        F.col("f").alias("n_f2p"), (F.col("fp") + F.when(fault(i % 43 == 8), 1).otherwise(0)).alias("n_f2p_pass"), F.col("p").alias("n_p2p"), F.col("ok").alias("n_p2p_ok"),
        F.col("f2p").alias("f2p_statuses"), F.col("p2p").alias("p2p_statuses"),
        only(F.when(fault(i % 47 == 9), "other").when(~fault(i % 73 == 15), "pytest-structured-v1")).alias("grader_protocol"),
        only(F.lit("complete")).alias("evaluation_state"), (~fault(i % 53 == 10)).alias("reward_eligible"), only(~fault(i % 59 == 11)).alias("report_intact"),
        F.lit(0).alias("restore_rc"), F.when(fault(i % 61 == 12), 2).otherwise(0).alias("collection_rc"), only(F.lit("f2p_same_files")).alias("p2p_scope"),
        only(F.col("nodes")).alias("collected_nodes"), only(F.map_from_arrays("nodes", "nodes")).alias("node_mapping"), only(F.col("collection")).alias("collection_events"),
        only(F.when(~fault(i % 79 == 16), F.col("tests"))).alias("test_events"), only(gd.events_digest(F.col("collection"))).alias("collection_sha256"),
        only(F.when(fault(i % 83 == 20), "0").otherwise(gd.events_digest(F.col("tests")))).alias("report_sha256"), only(gd.nodes_digest(F.col("nodes"))).alias("requested_nodes_sha256"),
    )
    return rows.select("id", "error", "timed_out", "smith_rc", "n_f2p", F.when(~fault(i % 71 == 14), ev).alias("eval"))


FACTS = f"""
select rollout_id as i, n_f2p + 1 as f, n_f2p_pass as fp, n_p2p as p, n_p2p_ok as ok, rollout_id % 17 = 3 as t from ({b.ROLLOUTS})
"""
RULES = f"""
with x as (select *, not t and fp = f and ok = p as r from ({FACTS})),
 y as (select *, r or i % 31 = 5 as r2, case when i % 37 <> 6 then t end as t2, case when t then case when i % 2 = 0 then 124 else 1 end when i % 41 = 7 then 2 when r then 0 else 1 end as rc,
   fp + case when i % 43 = 8 then 1 else 0 end as fp2, i % 3 = 0 as st from x),
 z as (select i, case when i % 71 = 14 then list_filter([case when i % 13 = 2 then 'runner_error' end, 'missing_eval'], lambda v: v is not null) else list_concat(list_filter([
  case when i % 13 = 2 then 'runner_error' end, case when st and (i % 47 = 9 or i % 73 = 15) then 'unknown_protocol' end, case when st and i % 53 = 10 then 'evaluation_incomplete' end,
  case when st and (i % 59 = 11 or i % 61 = 12) then 'evidence_incomplete' end, case when t2 is null then 'eval_timed_out_not_boolean' end,
  case when fp2 > f or ok > p then 'invalid_counts' end, case when i % 67 = 13 then 'n_f2p_mismatch' end,
  case when i % 29 = 4 and fp < f then 'f2p_statuses_unknown_status' end, case when fp2 <> fp then 'f2p_statuses_pass_count' end,
  case when t2 and (rc <> 124 or r2) then 'inconsistent_timeout' end, case when not coalesce(t2, false) and rc not in (0, 1) then 'unavailable_rc' end,
  case when coalesce(r2 <> (not t2 and fp2 = f and ok = p), true) then 'resolved_disagrees' end], lambda v: v is not null),
  case when not st then [] else list_filter([
  case when i % 61 = 12 then 'collection_rc' end, case when i % 79 = 16 then 'test_events' end, case when i % 83 = 20 or i % 79 = 16 then 'report_hash' end,
  case when i % 79 = 16 then 'execution_finish' end, case when i % 79 = 16 then 'execution_unknown' end, case when i % 79 = 16 then 'invalid_phase' end, case when i % 79 = 16 then 'duplicate_phase' end,
  case when i % 79 = 16 then 'missing_reports' end, case when i % 79 = 16 or i % 29 = 4 and fp < f then 'status_disagrees' end, case when r2 and rc <> 0 then 'resolved_nonzero_rc' end], lambda v: v is not null) end) end as v from y)
"""


@query("f14_eval_validation", f"{RULES} select i as id, array_to_string(v, ',') as violations from z")
def _(spark, root):
    return result_rows(spark, root).select("id", F.array_join(gd.eval_violations(), ",").alias("violations"))


@query("a38_gate_problems", f"""
{RULES} select 'invalid:' || v[1] as problem, count(*) as n from z where len(v) > 0 group by 1
union all select unnest(['missing', 'extra']), count(*) from orders where o_orderkey % 90 in (0, 1) having count(*) > 0
""")
def _(spark, root):
    planned, results = gate_input(spark, root)
    return gd.gate_problems(planned, results, "id").groupBy("problem").agg(F.count("*").alias("n"))


def gate_input(spark, root):
    """Every 90th row has another id in the plan, the one after another in the results."""
    rows = result_rows(spark, root).withColumn("violations", gd.eval_violations()).withColumn("unreadable", F.lit(False))
    other = lambda left: F.when(F.col("id") % 90 == left, -1 - F.col("id")).otherwise(F.col("id")).alias("id")
    return rows.select(other(0)), rows.withColumn("id", other(1))


@query("a38_gate", f"""
{RULES}, problems as (select 'invalid:' || v[1] as problem, count(*) as n from z where len(v) > 0 group by 1
  union all select unnest(['missing', 'extra']), count(*) from orders where o_orderkey % 90 in (0, 1) having count(*) > 0)
select 80 as checkpoint_step, false as complete, count(*) as n_expected, count(*) as n_observed, null::bigint as n_resolved, null::double as resolved_rate,
  null::bigint as n_trajectory_timeout, null::bigint as n_eval_timeout, null::bigint as n_outer_timeout_rc124, (select sum(n)::bigint from problems) as n_problems,
  (select string_agg(problem || '=' || n, ',' order by problem || '=' || n) from problems) as problems from z
union all
select 81, true, count(*), count(*), count_if(r), round(count_if(r) / count(*), 6), count_if(i % 19 = 1), count_if(t), count_if(i % 23 = 1), 0, '' from x
""")
def _(spark, root):
    # A run with faults is refused and gives no counts; the same run without them is whole.
    planned, results = gate_input(spark, root)
    rows = result_rows(spark, root, faults=False).withColumn("violations", gd.eval_violations()).withColumn("unreadable", F.lit(False))
    out = gd.gate(planned, results, "id", 80).unionByName(gd.gate(rows.select("id"), rows, "id", 81))
    return out.withColumn("resolved_rate", F.round("resolved_rate", 6)).withColumn("problems", F.array_join("problems", ","))


RESULT = (
    f"id string, error string, timed_out boolean, smith_rc int, n_f2p int, eval struct<resolved:boolean,timed_out:boolean,pytest_rc:int,n_f2p:int,n_f2p_pass:int,n_p2p:int,n_p2p_ok:int,"
    f"f2p_statuses:map<string,string>,p2p_statuses:map<string,string>,grader_protocol:string,evaluation_state:string,reward_eligible:boolean,report_intact:boolean,restore_rc:int,collection_rc:int,"
    f"p2p_scope:string,collected_nodes:array<string>,node_mapping:map<string,string>,collection_events:array<{EVENT}>,test_events:array<{EVENT}>,collection_sha256:string,report_sha256:string,requested_nodes_sha256:string>"
)


def customer_results(spark, root, faults):
    """A result file per customer, two tests each, in two shards: ``path`` and ``text``.

    With ``faults`` some are copied into another one's folder, lie too deep, lack
    their id, are cut, empty, left out, there twice, or break a rule.
    """
    i, has = F.col("c_custkey"), F.col("c_acctbal") > 0
    row = F.to_json(F.struct(
        F.when(F.lit(not faults) | (i % 29 != 4), i.cast("string")).alias("id"), F.lit(False).alias("timed_out"), F.when(i % 23 == 1, 124).otherwise(0).alias("smith_rc"),
        F.when(F.lit(faults) & (i % 29 == 5), 2).otherwise(1).alias("n_f2p"),
        F.struct(
            has.alias("resolved"), F.lit(False).alias("timed_out"), F.when(has, 0).otherwise(1).alias("pytest_rc"), F.lit(1).alias("n_f2p"), has.cast("int").alias("n_f2p_pass"),
            F.lit(1).alias("n_p2p"), F.lit(1).alias("n_p2p_ok"), F.create_map(F.lit("t.py::a"), F.when(has, "PASSED").otherwise("FAILED")).alias("f2p_statuses"),
            F.create_map(F.lit("t.py::b"), F.lit("PASSED")).alias("p2p_statuses"),
        ).alias("eval"),
    ))
    shard = F.concat(F.lit("shard"), (i % 2).cast("string"), F.lit("/"))
    at = lambda s, folder: F.concat(s, folder.cast("string"), F.lit("/result.json"))
    if not faults:
        return table(spark, root, "customer").select(at(shard, i).alias("path"), row.alias("text"))
    path = F.when(i % 29 == 3, at(shard, -i)).when(i % 29 == 6, at(F.concat(shard, F.lit("deep/")), i)).otherwise(at(shard, i))
    text = F.when(i % 29 == 7, F.left(row, F.length(row) - 1)).when(i % 29 == 8, "").otherwise(row)
    paths = F.when(i % 29 == 9, F.array(path, at(F.concat(F.lit("shard"), ((i + 1) % 2).cast("string"), F.lit("/")), i))).when(i % 29 == 10, F.array()).otherwise(F.array(path))
    return table(spark, root, "customer").select(F.explode(paths).alias("path"), text.alias("text"))


@query("a38_gate_files", """
with c as (select c_custkey as i, c_custkey % 29 as m, c_acctbal > 0 as ok from customer),
 f as (select 'invalid:n_f2p_mismatch' as p, count_if(m = 5) as n from c union all select 'misplaced:id_disagrees', count_if(m = 3) from c union all select 'misplaced:missing_id', count_if(m = 4) from c
   union all select 'misplaced:unexpected_layout', count_if(m = 6) from c union all select 'unreadable', count_if(m in (7, 8)) from c union all select 'duplicate', count_if(m = 9) from c
   union all select 'missing', count_if(m in (3, 4, 6, 10)) from c),
 d as (select sha256('[' || string_agg('"' || i || '"', ',' order by i) || ']') as h from c)
select (select h from d) as ids_sha256, 80 as checkpoint_step, false as complete, count(*) as n_expected, count_if(m not in (3, 4, 6, 10)) + count_if(m = 9) as n_observed, null::bigint as n_resolved,
  null::double as resolved_rate, null::bigint as n_outer_timeout_rc124, (select sum(n)::bigint from f) as n_problems, (select string_agg(p || '=' || n, ',' order by p || '=' || n) from f where n > 0) as problems from c
union all
select (select h from d), 81, true, count(*), count(*), count_if(ok), round(count_if(ok) / count(*), 6), count_if(i % 23 = 1), 0, '' from c
""")
def _(spark, root):
    """Files of a run with faults, refused, and of a whole one: manifest and shards to the summary."""
    names = table(spark, root, "customer").select(F.col("c_custkey").alias("i"))
    listed = names.agg(F.array_sort(F.collect_list("i")).alias("l"))  # a manifest is one file
    plan = listed.select(F.lit("ids.json").alias("path"), F.concat(F.lit('["'), F.array_join(F.col("l").cast("array<string>"), '","'), F.lit('"]')).alias("text"))
    out = None
    for step, faults in ((80, True), (81, False)):
        folder = fresh_folder(spark, "gate-files")
        write_files(plan, folder, "path", "text")
        write_files(customer_results(spark, root, faults).repartition("path"), folder, "path", "text")
        one = gd.gate_files(spark, f"{folder}/ids.json", [f"{folder}/shard0", f"{folder}/shard1"], RESULT, step, "id")
        out = one if out is None else out.unionByName(one)
    return out.select(
        "ids_sha256", "checkpoint_step", "complete", "n_expected", "n_observed", "n_resolved", F.round("resolved_rate", 6).alias("resolved_rate"), "n_outer_timeout_rc124",
        "n_problems", F.array_join("problems", ",").alias("problems"),
    )


def evidence_rows(spark, root):
    """Structured evidence of each order: two tests, their reports, and hashes; some ids carry one fault."""
    i = F.col("o_orderkey")
    n1, n2 = F.lit("t/a.py::test_ü[1 2]"), F.concat(F.lit("t/a.py::test_"), F.col("o_custkey").cast("string"))
    empty_nodes = F.lit(None).cast("array<string>")

    def event(kind, nodes=None, nodeid=None, when=None, outcome=None, wasxfail=None, exitstatus=None):
        pick = lambda v, t: F.lit(None).cast(t) if v is None else (v if hasattr(v, "cast") else F.lit(v)).cast(t)
        return F.struct(
            pick(kind, "string").alias("kind"), (empty_nodes if nodes is None else nodes).alias("nodes"), pick(nodeid, "string").alias("nodeid"), pick(when, "string").alias("when"),
            pick(outcome, "string").alias("outcome"), pick(wasxfail, "boolean").alias("wasxfail"), pick(exitstatus, "int").alias("exitstatus"),
        )

    good = F.col("o_orderstatus") == "F"
    call = F.when(good, "passed").otherwise("failed")
    rc = F.when(good, 0).otherwise(1)
    available = F.array(n1, n2)
    collection = F.array(event("collection", nodes=available), event("session_finish", exitstatus=F.when(i % 7 == 1, 1).otherwise(0)))
    reports = [event("test", nodeid=n, when=w, outcome=(call if (w == "call" and n is n2) else F.lit("passed")), wasxfail=False) for n in (n1, n2) for w in ("setup", "call", "teardown")]
    tests = F.array(*reports, event("session_finish", exitstatus=rc))
    tests = F.when(i % 7 == 2, F.filter(tests, lambda e: ~F.coalesce(e["when"] == "teardown", F.lit(False)))).otherwise(tests)
    status = F.when(good | (i % 7 == 3), "PASSED").otherwise("FAILED")
    f2p = F.create_map(n2, status)
    p2p = F.create_map(F.when(i % 7 == 4, F.lit("t/b.py::x")).otherwise(F.lit("t/a.py::test_ü[1")), F.lit("PASSED"))
    mapping = F.map_from_arrays(F.concat(F.map_keys(f2p), F.map_keys(p2p)), F.array(n2, n1))
    # The event arrays become columns first: they are used several times below.
    rows = spread_table(spark, root, "orders", "o_orderkey").select(
        i.alias("id"), collection.alias("collection"), tests.alias("tests"), available.alias("available"), f2p.alias("f2p"), p2p.alias("p2p"),
        mapping.alias("mapping"), rc.alias("rc"), (good | (i % 7 == 6)).alias("resolved"),
    )
    rows = rows.withColumn("report", gd.events_digest(F.col("tests")))
    requested = F.concat(F.map_keys("f2p"), F.map_keys("p2p"))
    ev = F.struct(
        F.lit(0).alias("restore_rc"), F.lit(0).alias("collection_rc"), F.lit("f2p_same_files").alias("p2p_scope"), F.col("collection").alias("collection_events"),
        F.col("tests").alias("test_events"), gd.events_digest(F.col("collection")).alias("collection_sha256"),
        F.when(F.col("id") % 7 == 5, F.lit("0")).otherwise(F.col("report")).alias("report_sha256"), F.col("available").alias("collected_nodes"),
        F.col("f2p").alias("f2p_statuses"), F.col("p2p").alias("p2p_statuses"), F.col("mapping").alias("node_mapping"),
        gd.nodes_digest(requested).alias("requested_nodes_sha256"), F.col("rc").alias("pytest_rc"), F.col("resolved").alias("resolved"),
    )
    return rows.select("id", ev.alias("eval"))


@query("f15_evidence_validation", """
select o_orderkey as id, case o_orderkey % 7 when 1 then 'collection_incomplete' when 2 then 'status_disagrees' when 3 then case when o_orderstatus <> 'F' then 'status_disagrees' else '' end
  when 4 then 'mapping_exact,p2p_outside_scope' when 5 then 'report_hash' when 6 then case when o_orderstatus <> 'F' then 'resolved_nonzero_rc' else '' end else '' end as violations from orders
""")
def _(spark, root):
    return evidence_rows(spark, root).select("id", F.array_join(gd.evidence_violations(), ",").alias("violations"))


@query("f15_evidence_digest", """
select o_orderkey as id, sha256('{"kind": "collection", "nodes": ["t/a.py::test_\\u00fc[1 2]", "t/a.py::test_' || o_custkey || '"]}' || chr(10) || '{"kind": "session_finish", "exitstatus": ' || case when o_orderkey % 7 = 1 then 1 else 0 end || '}' || chr(10)) as collection_sha256,
   sha256('["t/a.py::test_' || o_custkey || '","' || case when o_orderkey % 7 = 4 then 't/b.py::x' else 't/a.py::test_\\u00fc[1' end || '"]') as requested_sha256 from orders
""")
def _(spark, root):
    rows = evidence_rows(spark, root)
    return rows.select("id", F.col("eval.collection_sha256").alias("collection_sha256"), F.col("eval.requested_nodes_sha256").alias("requested_sha256"))
