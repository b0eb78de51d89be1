"""Summarise the executed plan of every registered query (after AQE) as a
markdown table: scans, shuffles, join strategies, windows, Python nodes.

usage: python tools_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import re
import sys

from bookdesk.plans import registry
from bookdesk.session import build_session

NODES = [
    ("scans", r"FileScan parquet|Scan parquet"),
    ("shuffles", r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|ShuffleQueryStage"),
    ("broadcast joins", r"BroadcastHashJoin"),
    ("sort-merge joins", r"SortMergeJoin"),
    ("aggregates", r"HashAggregate\(keys=\[[^\]]+\], functions=\[[^\]]*\]\)|ObjectHashAggregate|SortAggregate"),
    ("windows", r"\bWindow \[|WindowGroupLimit"),
    ("python", r"ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|BatchEvalPython"),
    ("top-k", r"TakeOrderedAndProject"),
]


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    registry.load_all()
    spark = build_session()
    print(f"# Executed plans of the registered queries ({sf}, local[8], AQE on)\n")
    print("Counts of node mentions in the final adaptive plan after one full run "
          "(noop sink); an exchange that is reused is counted where it is mentioned.\n")
    print("| query | " + " | ".join(n for n, _ in NODES) + " |")
    print("| --- |" + " --- |" * len(NODES))
    for name in sorted(registry.QUERIES):
        df = registry.QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        text = df._jdf.queryExecution().executedPlan().toString()
        # the final plan of an adaptive query lists each stage once
        counts = [len(re.findall(rx, text)) for _, rx in NODES]
        print(f"| `{name}` | " + " | ".join(str(c) for c in counts) + " |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
