"""Command line check: ``python tests/check_all.py [sf_dir] [name-part ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowsieve.plans.catalogue import load_catalogue, runnable  # noqa: E402
from flowsieve.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    connection = connect(sf_dir)
    failed = 0
    for name, query in load_catalogue().items():
        if parts and not any(part in name for part in parts):
            continue
        start = time.time()
        try:
            if query.sql:
                problem = compare(spark, sf_dir, runnable(query), query.sql, connection)
                status = "ok" if problem is None else f"DIFF {problem[:600]}"
            else:
                status = f"rows {len(runnable(query)(spark, sf_dir).collect())}"
        except Exception as error:  # noqa: BLE001
            status = f"ERROR {type(error).__name__} {str(error)[:900]}"
            if parts:
                traceback.print_exc()
        failed += status.startswith(("DIFF", "ERROR"))
        print(f"{time.time() - start:6.1f}s {name:40s} {status}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
