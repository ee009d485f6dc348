"""Write PLANS.md: the physical-plan shape of every registered query.

Usage: python scripts/plan_summary.py [sf_dir]

For each query: shuffles (by kind), join strategies, aggregates, windows,
Python evaluations, scans with pushed filters. Counts come from the initial
adaptive plan (before runtime re-planning), with subquery plans included.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from glossa.plans.catalog import QUERIES  # noqa: E402
from glossa.session import build_session  # noqa: E402

PATTERNS = {
    "hash shuffles": r"Exchange hashpartitioning",
    "round-robin": r"Exchange RoundRobinPartitioning",
    "single-partition": r"Exchange SinglePartition",
    "broadcast joins": r"BroadcastHashJoin",
    "sort-merge joins": r"SortMergeJoin",
    "hash aggs": r"HashAggregate\(keys",
    "sort aggs": r"SortAggregate\(key",
    "windows": r"\bWindow \[",
    "python": r"ArrowEvalPython|MapInPandas",
    "top-k": r"TakeOrderedAndProject",
}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 16)
    lines = ["# Physical-plan shapes", "",
             "Generated by `scripts/plan_summary.py` from the initial adaptive plans at "
             f"`{sf_dir}` (AQE may still turn a sort-merge join into a broadcast at run time). "
             "Identical subqueries are shown once per use in a plan but run once.", "",
             "| query | " + " | ".join(PATTERNS) + " | pushed filters |",
             "|---|" + "---|" * (len(PATTERNS) + 1)]
    for name, q in QUERIES.items():
        plan = q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        counts = [str(len(re.findall(p, plan))) for p in PATTERNS.values()]
        pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))
        lines.append(f"| {name} | " + " | ".join(counts) + f" | {'; '.join(pushed)[:80]} |")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
