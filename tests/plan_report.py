"""Write PLANS.md: for every registered query, the shape of its executed plan at sf0.01.

    python tests/plan_report.py /root/testdata/sf0.01 > PLANS.md

Counts shuffles (Exchange), broadcasts, windows without a partition key and sort-merge joins,
and lists what reaches each parquet scan of the driver's tables (columns, pushed filters).
Queries that use the ordered index also run one or two small jobs at definition time
(range sampling + a write to the checkpoint folder); those are not part of this plan.
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def shape(plan: str) -> dict:
    lines = plan.splitlines()
    return {
        "shuffles": sum(1 for ln in lines if re.search(r"\bExchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", ln)),
        "single": sum(1 for ln in lines if "Exchange SinglePartition" in ln),
        "broadcasts": sum(1 for ln in lines if "BroadcastExchange" in ln),
        "smj": sum(1 for ln in lines if "SortMergeJoin" in ln),
        "bhj": sum(1 for ln in lines if "BroadcastHashJoin" in ln),
        "python": any(k in plan for k in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF")),
    }


def scans(plan: str) -> list[str]:
    out = []
    for m in re.finditer(r"FileScan parquet \[([^\]]*)\][^\n]*?Location: \w+(?:\([^)]*\))?\s*\[file:[^\]]*/(\w+)\.parquet\][^\n]*?PushedFilters: \[([^\]]*)\]", plan):
        cols, table, filt = m.group(1), m.group(2), m.group(3)
        cols = ",".join(re.sub(r"#\d+L?", "", c) for c in cols.split(", "))
        out.append(f"{table}({cols})" + (f" filters[{filt}]" if filt else ""))
    return sorted(set(out))


def slice_report(spark, sf_dir: str) -> None:
    """Files that a slice of a stored array opens, and the filters that reach them."""
    from pyspark.sql import functions as F

    from lithos.operators import arrays as A
    from lithos.operators.position import with_ordered_index
    from lithos.plans import roles as R
    from lithos.session import ensure_checkpoint_dir

    rows = with_ordered_index(R.survey(spark, sf_dir), list(R.LINEITEM_ORDER), name="pos").select(
        F.lit("path-1").alias("array_id"), "pos", F.col("depth").alias("distance"), "azimuth", "dip")
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/plan-report/path"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges are not merged here
    A.write_ranged(rows, target, "path")
    part = A.read_range(spark, target, "path", "path-1", 10_000, 12_000)
    plan = part._jdf.queryExecution().executedPlan().toString()
    print("\n## A slice of a stored array\n")
    print(f"Rows [10000, 12000) of an array of {rows.count()} rows in {len(spark.read.parquet(target).inputFiles())} files: "
          f"{len(part.inputFiles())} file(s) opened, {part.count()} rows, filters pushed: "
          f"{re.search(r'PushedFilters: (.*?), ReadSchema', plan).group(1)}.")


def main(sf_dir: str) -> None:
    from lithos.session import local_session
    from lithos.plans.queries import QUERIES

    spark = local_session(8, 16)
    print("# PLANS\n")
    print(__doc__.split("\n\n", 2)[2].strip() + "\n")
    print(f"Generated at `{sf_dir}` on local[8], AQE on (final adaptive plans may coalesce or switch joins at runtime).\n")
    print("| query | shuffles | to one partition (global aggregate, bounded window) | broadcast | sort-merge join | broadcast join | python | driver-table scans |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = shape(plan)
        sc = "; ".join(scans(plan)) or "(materialised intermediate)"
        print(f"| `{name}` | {s['shuffles']} | {s['single']} | {s['broadcasts']} | {s['smj']} | {s['bhj']} | "
              f"{'yes' if s['python'] else 'no'} | {sc} |")
    slice_report(spark, sf_dir)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
