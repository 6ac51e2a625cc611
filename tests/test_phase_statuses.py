"""Phase reports of a table: status per run and test, beside the status list of one run."""

from rungauge.operators import grader
from rungauge.plans import QUERIES


def test_table_of_reports(spark):
    rows = [
        ("r", "a", "setup", "passed", False), ("r", "a", "call", "passed", False), ("r", "a", "teardown", "passed", False),
        ("r", "b", "setup", "passed", False), ("r", "b", "call", "failed", False),
        ("r", "c", "call", "passed", False), ("r", "c", "call", "passed", False),
        ("r", "d", "setup", "skipped", True), ("r", "d", "teardown", "passed", False),
        ("s", "a", "setup", "passed", False), ("s", "a", "teardown", "passed", False),
        ("s", "b", "setup", "passed", None),
    ]
    df = spark.createDataFrame(rows, "run string, nodeid string, `when` string, outcome string, wasxfail boolean")
    got = {(r.run, r.nodeid): r.status for r in grader.run_phase_statuses(df, ["run"]).collect()}
    assert got == {
        ("r", "a"): "PASSED", ("r", "b"): "FAILED", ("r", "c"): "CONFLICT", ("r", "d"): "XFAIL", ("s", "a"): "MISSING", ("s", "b"): "INVALID",
    }


def test_query_on_line_items(spark, tmp_path):
    """A quantity that is not known is no expected failure."""
    rows = [(1, 2, 1, n, q, "R", "F", 1.0) for n, q in ((3, 1.0), (1, None), (2, 1.0))]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_extendedprice double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [tuple(r) for r in QUERIES["t18_phase_statuses"](spark, str(tmp_path)).select("run", "nodeid", "status").collect()] == [(1, "n0", "PASSED")]
