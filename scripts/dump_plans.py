"""Write the physical plans of headline queries to docs/PLANS.md.

usage: python scripts/dump_plans.py [sf_dir]
"""
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from stockspark.plans.catalog import load_all  # noqa: E402
from stockspark.session import build_session  # noqa: E402

HEADLINE = ["v1_compare", "v1_only_warehouse", "v3_vendor_compare", "v5_rollup_account", "tolerance_tolerant_max_floor",
            "order_totals", "supplier_order_totals", "lifecycle_commands"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=16)
    q = load_all()
    out = ["# Physical plans of headline queries", "",
           f"Generated by `scripts/dump_plans.py` on `{sf}` (local[8], AQE on; initial plans before",
           "runtime re-optimisation). Look for `PushedFilters` / `ReadSchema` on the scans, the number",
           "of `Exchange` nodes, and the join types.", ""]
    for name in HEADLINE:
        df = q[name][0](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        # keep the plan readable: shorten very long expression lines
        lines = [ln if len(ln) < 400 else ln[:400] + " ..." for ln in plan.splitlines()]
        out += [f"## {name}", "", (q[name][0].__doc__ or "").strip(), "", "```", *lines, "```", ""]
    with open(os.path.join(ROOT, "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
