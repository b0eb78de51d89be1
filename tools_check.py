"""Run registered queries against their DuckDB oracles and print a summary.

usage: python tools_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import sys
import time

from bookdesk.plans import registry
from bookdesk.plans.compare import compare, duck_connect
from bookdesk.session import build_session


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    registry.load_all()
    spark = build_session()
    con = duck_connect(sf)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            r = compare(spark, name, fn, registry.ORACLES.get(name), sf, con)
        except Exception as e:  # report and go on
            r = {"name": name, "status": "ERROR", "error": str(e)[:800]}
        r["sec"] = round(time.time() - t, 2)
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
            print("PROBLEM " + json.dumps(r, default=str)[:2500])
        else:
            print(f"RESULT {r['status']:9s} {name:40s} rows={r.get('spark_rows')} {r['sec']}s")
    print(f"-- {bad} problems")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
