"""Physical plans of the registered queries: no cartesian products, and the
parquet scans receive pushed filters and pruned read schemas."""
import os

import pytest

import __spark_entry__ as E
from stockspark.plans.catalog import load_all

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(load_all()))
def test_no_join_without_keys(spark, name):
    """Neither cartesian products nor nested loops; imports, streams and rounds included."""
    plan = plan_of(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_v1_pushdown_and_pruning(spark):
    plan = plan_of(E.queries()["v1_compare"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,O)" in plan
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)" in plan
    part_scans = [line for line in plan.splitlines() if "part.parquet" in line]
    assert part_scans and all("ReadSchema: struct<p_partkey:bigint,p_brand:string,p_type:string>" in line
                              for line in part_scans)


def test_v1_presence_picks_join_type(spark):
    q = E.queries()
    assert "FullOuter" in plan_of(q["v1_compare"](spark, SF))
    only_wh = plan_of(q["v1_only_warehouse"](spark, SF))
    assert "LeftAnti" in only_wh and "FullOuter" not in only_wh
    both = plan_of(q["v1_both_differences"](spark, SF))
    assert "Inner" in both and "FullOuter" not in both


def test_book_scans_are_pruned(spark):
    plan = plan_of(E.queries()["order_totals"](spark, SF))
    li = [line for line in plan.splitlines() if "lineitem.parquet" in line]
    assert li and all("l_shipdate" not in line.split("ReadSchema:")[1] for line in li if "ReadSchema:" in line)


def test_v1_join_reuses_aggregate_partitioning(spark):
    plan = plan_of(E.queries()["v1_compare"](spark, SF))
    # one hash exchange per side (the keep-last aggregate); the full outer join reuses it
    assert plan.count("Exchange hashpartitioning(key") == 2
