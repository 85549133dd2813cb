"""Physical-plan shape of every catalogue query (before execution).

Counts shuffle exchanges (hash / range / single partition), broadcasts,
join kinds, Python nodes and file scans, and lists the columns each scan
reads.  Usage: python tools/plan_summary.py [data_dir] > PLANS.md
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from shopstat.plans.catalog import build_queries  # noqa: E402
from shopstat.session import local_session  # noqa: E402

PATTERNS = {
    "hash exch": r"Exchange hashpartitioning",
    "range exch": r"Exchange rangepartitioning",
    "single exch": r"Exchange SinglePartition",
    "broadcast": r"BroadcastExchange",
    "SMJ": r"SortMergeJoin",
    "BHJ": r"BroadcastHashJoin",
    "python": r"(ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas|PythonMapInArrow)",
    "scans": r"FileScan parquet|Scan ExistingRDD|Scan parquet",
}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    print("| query | " + " | ".join(PATTERNS) + " |")
    print("|---|" + "---|" * len(PATTERNS))
    for name, q in build_queries().items():
        plan = q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        counts = [str(len(re.findall(p, plan))) for p in PATTERNS.values()]
        print(f"| {name} | " + " | ".join(counts) + " |")


if __name__ == "__main__":
    main()
