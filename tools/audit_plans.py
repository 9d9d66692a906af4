"""Print what in the physical plans deserves a look: single-partition windows, nested-loop joins,
Cartesian products, row-at-a-time Python.

usage: python tools/audit_plans.py [--sf DIR] [--match text]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

MARKS = {
    "window on one partition": r"Window [^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition",
    "nested loop": r"BroadcastNestedLoopJoin[^\n]*",
    "cartesian": r"CartesianProduct[^\n]*",
    "row Python": r"BatchEvalPython[^\n]*",
}


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.001")
    parser.add_argument("--match", default="")
    args = parser.parse_args()
    from basketwise.plans import catalogue
    from basketwise.session import local_session

    spark = local_session("audit")
    spark.sparkContext.setLogLevel("OFF")
    for name, fn in catalogue.QUERIES.items():
        if args.match not in name or name.startswith("model_") or name == "permutation_importance":
            continue
        plan = fn(spark, args.sf)._jdf.queryExecution().executedPlan().toString()
        for label, pattern in MARKS.items():
            for hit in re.findall(pattern, plan):
                print(f"{name}: {label}: {hit.strip()[:160]}", flush=True)


if __name__ == "__main__":
    main()
