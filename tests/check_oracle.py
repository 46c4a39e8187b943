"""Compare queries with their checks: python tests/check_oracle.py SF_DIR [name ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from lendgrain.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, checks = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            if name in checks:
                verdict = compare(spark, con, queries[name], checks[name], sf_dir)
            else:
                verdict = f"(rows only: {queries[name](spark, sf_dir).count()})"
        except Exception as exc:
            verdict = "ERROR " + str(exc).strip()[:900]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += verdict is not None and not verdict.startswith("(rows")
        print(f"{name:36s} {time.time() - start:6.2f}s {verdict or 'ok'}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
