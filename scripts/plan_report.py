"""Write PLANS.md: physical-plan facts of every query key.

    python scripts/plan_report.py [--sf /root/testdata/sf0.01]

Columns: shuffle exchanges, of them carrying text; broadcast exchanges;
sort-merge / broadcast-hash joins; window operators; sort/hash aggregates;
Arrow Python UDF nodes.  Plans are the pre-AQE physical plans (AQE can only
turn more joins into broadcasts at run time).
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--out", default=os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"))
    args = ap.parse_args()

    from lexiflow.plans.queries import QUERIES
    from lexiflow.plans.inspect import plan_facts
    from lexiflow.session import get_spark

    spark = get_spark("plan_report")
    rows = []
    for key, fn in QUERIES.items():
        if key in ("train_predict", "train_compare"):
            continue
        f = plan_facts(fn(spark, args.sf))
        text_ex = sum(1 for name, cols in f.nodes if name == "Exchange" and ({"text", "raw_text", "payload"} & set(cols)))
        rows.append(
            (
                key,
                f.count("Exchange"),
                text_ex,
                f.count("BroadcastExchange"),
                f.count("SortMergeJoin"),
                f.count("BroadcastHashJoin"),
                f.count("Window"),
                f.count("SortAggregate"),
                f.count("HashAggregate") + f.count("ObjectHashAggregate"),
                f.count("ArrowEvalPython"),
            )
        )
    head = ["key", "shuffles", "shuffles with text columns", "broadcasts", "SMJ", "BHJ", "windows", "sort aggs", "hash aggs", "Arrow UDF"]
    lines = [
        "# Physical plans per query key",
        "",
        f"Generated by `scripts/plan_report.py` at `{args.sf}` (pre-AQE plans; fixture views included).",
        "'Shuffles with text columns' counts exchanges whose input names a text column.  Text",
        "inside an aggregation buffer or a struct key is not named there: the de-duplication",
        "shuffle (row in a `min(struct)` buffer) and the duplicate counts (text as a grouping-set",
        "key) carry text but count under 'shuffles' only.  Training keys are left out (their",
        "plans are pyspark.ml stages).  Jobs that run while a result is built (written tables,",
        "such as the split's keys and cut points or value counts) are not in these plans.",
        "",
        "| " + " | ".join(head) + " |",
        "|" + "---|" * len(head),
    ]
    lines += ["| " + " | ".join(str(x) for x in r) + " |" for r in rows]
    with open(args.out, "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines) + "\n")
    print(f"wrote {args.out} ({len(rows)} keys)")
    spark.stop()


if __name__ == "__main__":
    main()
