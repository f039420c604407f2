"""Summarise executed physical plans (operator counts, scans) of registered queries.

Usage: python tools/plan_summary.py SF_DIR name [name ...]  -> markdown on stdout
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gapscope.plans.catalog import QUERIES  # noqa: E402
from gapscope.session import build_session  # noqa: E402

OPS = ["Exchange hashpartitioning", "Exchange rangepartitioning", "BroadcastExchange", "BroadcastHashJoin",
       "SortMergeJoin", "WindowGroupLimit", "Window ", "CartesianProduct", "BroadcastNestedLoopJoin",
       "FileScan", "ArrowEvalPython", "BatchEvalPython", "InMemoryTableScan", "Generate"]


def main() -> None:
    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session(shuffle_partitions=16)
    print("| query | operators in the executed plan | scans (ReadSchema / pushed filters) |")
    print("| --- | --- | --- |")
    for n in names:
        df = QUERIES[n](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        ops = ", ".join(f"{k.strip()} ×{c}" for k in OPS if (c := len(re.findall(re.escape(k), plan))))
        scans = sorted(set(re.findall(r"FileScan parquet \[([^\]]*)\]", plan)))
        pushed = sorted(set(x for x in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if x))
        desc = "; ".join(s[:80] for s in scans[:3])
        if pushed:
            desc += " — pushed: " + "; ".join(p[:60] for p in pushed[:2])
        print(f"| `{n}` | {ops} | {desc} |")
    spark.stop()


if __name__ == "__main__":
    main()
