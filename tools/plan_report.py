"""Physical-plan summary of every named analysis (after AQE has run it).

Usage: python tools/plan_report.py [sf_dir]
Per analysis: warehouse scans, exchanges, join strategies, windows, sorts,
and Python evaluation nodes.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scenaria.plans.catalog import QUERIES  # noqa: E402
from scenaria.session import local_session  # noqa: E402


def summary(plan: str) -> dict:
    final = plan.split("== Initial Plan ==")[0]
    return {
        "lineitem_scans": final.count("lineitem.parquet"),
        "exchanges": final.count("Exchange hashpartitioning") + final.count("Exchange SinglePartition"),
        "reused": final.count("ReusedExchange"),
        "broadcast_joins": final.count("BroadcastHashJoin"),
        "sort_merge_joins": final.count("SortMergeJoin"),
        "windows": final.count("Window ["),
        "sorts": final.count("Sort ["),
        "python_nodes": final.count("EvalPython"),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(cores=os.environ.get("CORES", "*"))
    cols = None
    for name, q in QUERIES.items():
        df = q(spark, sf_dir)
        df.collect()
        s = summary(df._jdf.queryExecution().executedPlan().toString())
        if cols is None:
            cols = list(s)
            print("| analysis | " + " | ".join(cols) + " |")
            print("|---" * (len(cols) + 1) + "|")
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()
