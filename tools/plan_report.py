"""Summarise the physical plans of the run-analysis queries into PLANS.md.

usage: python tools/plan_report.py [SF_DIR]

For each query: scans (columns read, pushed filters), exchanges by kind, joins
(strategy and type), aggregates, windows, generators and Python nodes, taken
from the final adaptive plan after running the query once.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    c = Counter()
    scans = []
    for line in plan.splitlines():
        s = line.strip(" +-:*()0123456789")
        if "FileScan" in line:
            cols = re.search(r"FileScan \w+ \[([^\]]*)\]", line)
            pushed = re.search(r"PushedFilters: \[([^\]]*)\]", line)
            table = re.search(r"/runlens-table-(\w+)-[0-9a-f]{32}|/(\w+)\.parquet", line)
            scans.append((table.group(1) or table.group(2) if table else "file", cols.group(1).count(",") + 1 if cols else 0,
                          pushed.group(1) if pushed else ""))
        if "Exchange" in s and not s.startswith("Reused"):
            for key in ("RoundRobinPartitioning", "hashpartitioning", "rangepartitioning", "SinglePartition"):
                if key in line:
                    c[key] += 1
            if s.startswith("BroadcastExchange"):
                c["BroadcastExchange"] += 1
        for key in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
                    "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window", "Generate",
                    "ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "ReusedExchange", "TakeOrderedAndProject"):
            if s.startswith(key):
                c[key] += 1
    return {"counts": c, "scans": scans}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from runlens.session import get_spark
    from runlens.plans.catalog import queries
    from runlens.session import ship_package

    spark = get_spark("local[8]", 16)
    spark.conf.set("spark.sql.maxMetadataStringLength", "500")
    ship_package(spark)
    out = ["# Physical plans of the registered queries", "",
           f"Final adaptive plans at `{sf_dir}` on local[8] (regenerate with `python tools/plan_report.py`).",
           "The plan of the result only: tables that a query writes on its way have their own.",
           "Exchange kinds: RR = round robin, hash/range = keyed shuffles, "
           "BX = broadcast. Scans list table:columns-read and pushed filters.", "",
           "| query | scans | RR | hash | range | BX | joins | aggregates | windows | python |",
           "|---|---|---|---|---|---|---|---|---|---|"]
    for name, fn in queries().items():
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        c = s["counts"]
        scans = "; ".join(f"{t}:{n}" + (f" [{p}]" if p else "") for t, n, p in s["scans"])
        joins = ", ".join(f"{k.replace('HashJoin', 'HJ').replace('MergeJoin', 'MJ')}×{v}" for k, v in c.items()
                          if "Join" in k) or "-"
        aggs = c["HashAggregate"] + c["ObjectHashAggregate"] + c["SortAggregate"]
        py = c["ArrowEvalPython"] + c["BatchEvalPython"] + c["MapInArrow"] + c["MapInPandas"]
        out.append(f"| {name} | {scans} | {c['RoundRobinPartitioning']} | {c['hashpartitioning']} | "
                   f"{c['rangepartitioning']} | {c['BroadcastExchange']} | {joins} | {aggs} | {c['Window']} | {py} |")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")
    print("\n".join(out))


if __name__ == "__main__":
    main()
