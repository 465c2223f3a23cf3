"""Command line: compare registered queries with their SQL and print timings.

    python tests/check_all.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from catalog import load  # noqa: E402
from cohortcast.session import build_session  # noqa: E402
from tests.compare import connect, differences  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = build_session(
        "check", "local[8]",
        conf={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
              "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry, con, bad = load(), connect(sf_dir), 0
    for name, fn in registry.queries.items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            rows = [tuple(x) for x in df.collect()]
            took = time.time() - start
            start = time.time()
            sql = registry.oracles.get(name)
            diff = differences(df, con, sql, rows) if sql else []
            verdict = "no sql" if not sql else ("ok" if not diff else "DIFF")
        except Exception as error:  # noqa: BLE001
            took, rows, verdict, diff = time.time() - start, [], "FAIL", [str(error)[:1500]]
        bad += verdict in ("DIFF", "FAIL")
        print(f"{verdict:7} {name:32} rows={len(rows):<7} {took:6.2f}s sql={time.time() - start:5.2f}s",
              flush=True)
        for line in diff:
            print("        ", line)
    print("bad:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
