"""Tolerance grading: the worked example and the edge rows of FIXTURES F5."""
from stockspark.config import TolerancePolicy
from stockspark.operators import tolerance as T

RUN = "2026-01-01 00:00:00"


def grade(spark, rows, policy):
    df = spark.createDataFrame(rows, "sku string, ec_qty int, wh_qty int, use_low_stock boolean, low_stock_max int")
    return {r["sku"]: r for r in T.evaluate(df, policy, RUN).collect()}


def test_golden_row(spark):
    rows = [("S1", 100, 102, False, 0)]
    t = grade(spark, rows, TolerancePolicy(mode="tolerant"))["S1"]
    assert t["tolerance_units"] == 5 and t["comparison"] == "Match" and t["applied_severity"] == "Medium"
    assert t["reason"] == "Delta ≤ tolerance (2 ≤ 5)."
    s = grade(spark, rows, TolerancePolicy(mode="strict"))["S1"]
    assert s["comparison"] == "Mismatch" and s["reason"] == "Quantities differ (Δ=2)."
    assert len(T.to_display(T.evaluate(spark.createDataFrame(rows, "sku string, ec_qty int, wh_qty int, "
                                                                   "use_low_stock boolean, low_stock_max int"),
                                      TolerancePolicy(), RUN)).columns) == 17


def test_edge_rows(spark):
    rows = [("zero", 0, 0, True, 5), ("out", 0, 7, True, 5), ("low", 3, 40, True, 5), ("neg", -2, 0, False, 0),
            ("half", 50, 50, False, 0), ("  ", 10, 11, False, 9), ("cap", 1000, 900, False, 0)]
    pol = TolerancePolicy(mode="tolerant", base_method="max", rounding="round")
    r = grade(spark, rows, pol)
    assert r["zero"]["comparison"] == "Match" and r["zero"]["availability"] == "Out of Stock everywhere"
    assert r["out"]["applied_severity"] == "Critical" and r["out"]["comparison"] == "Mismatch"
    assert r["out"]["reason"] == "Statuses diverge; tolerance is 0 for this severity."
    assert r["low"]["ecommerce_status"] == "Low Stock" and r["low"]["applied_severity"] == "High"
    assert r["neg"]["ecommerce_status"] == "In Stock" and r["neg"]["applied_severity"] == "Critical"
    assert r["half"]["tolerance_units"] == 2          # 2.5 rounds half-even to 2
    assert "UNKNOWN-SKU" in r and r["UNKNOWN-SKU"]["low_stock_max"] == 0
    capped = TolerancePolicy(mode="tolerant", severity_map=(("Critical", 0.0, 0, 0), ("High", 0.0, 0, 0),
                                                            ("Medium", 0.5, 1, 7), ("Low", 0.1, 1, None),
                                                            ("Very Low", 0.2, 1, None)))
    assert grade(spark, rows, capped)["cap"]["tolerance_units"] == 7


def test_bases_and_rounding(spark):
    rows = [("a", 10, 31, False, 0)]
    for base, rnd, want in [("min", "ceil", 1), ("avg", "floor", 1), ("ecommerce", "round", 1),
                            ("warehouse", "ceil", 2), ("max", "floor", 1)]:
        r = grade(spark, rows, TolerancePolicy(mode="tolerant", base_method=base, rounding=rnd))["a"]
        assert r["tolerance_units"] == want, (base, rnd)
