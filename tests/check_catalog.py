"""Compares registered queries with their SQL twins: python tests/check_catalog.py [sf] [names]."""

from __future__ import annotations

import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from reviewmill.session import build_session  # noqa: E402
from tests.compare import compare, connect  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="check-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, bad = oracle_sql(), 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                note = "ok" if not problems else "DIFF"
            else:
                problems, note = [], f"rows only: {df.count()}"
        except Exception as problem:  # noqa: BLE001
            problems, note = [str(problem)[:600]], "ERROR"
            if wanted:
                print(traceback.format_exc()[-1500:])
        bad += bool(problems)
        print(f"{name:28s} {note:12s} {time.time() - start:6.2f}s", *problems, sep="  ", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
