"""Command line check: python tests/check.py <folder> [name prefix ...]"""

import logging
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from rungauge.session import build_session  # noqa: E402


def main() -> int:
    root, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = build_session("check", "local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    logging.disable(logging.CRITICAL)
    connection = oracle.connect(root)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = oracle.compare(spark, connection, root, query, sqls[name])
                kind = "sql"
            else:
                problem = None if query(spark, root).count() > 0 else "no rows"
                kind = "rows"
        except Exception as error:  # report and go on
            problem, kind = f"{type(error).__name__}: {str(error)[:700]}", "error"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {kind:5} {time.time() - start:6.2f}s {name}"
              + (f"\n      {problem[:1500]}" if problem else ""), flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
