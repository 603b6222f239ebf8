"""Run registered queries in Spark and their DuckDB oracles side by side.

usage: python tools/check_oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ringwise.catalog import ORACLE, QUERIES  # noqa: E402
from ringwise.checks.compare import compare, duck  # noqa: E402
from ringwise.session import checkpoint_dir, get_spark  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = get_spark()
    checkpoint_dir(spark)
    con = duck(sf)
    bad = 0
    for name in sorted(QUERIES):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in ORACLE:
                rep = compare(df, con, ORACLE[name])
            else:
                rep = {"ok": None, "spark_rows": df.count(), "oracle": "none"}
        except Exception as exc:  # report and continue
            rep = {"ok": False, "error": f"{type(exc).__name__}: {str(exc)[:600]}"}
        if rep.get("ok") is False:
            bad += 1
        print(f"{name:32s} {time.time() - t0:6.1f}s {rep}", flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
