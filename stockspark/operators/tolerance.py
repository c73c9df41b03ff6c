"""Stock status, severity and tolerance grading over whole tables (CND-1..5, SNK-8 columns).

The severity policy is a handful of rows; it is compiled into CASE
expressions (no join at all), so grading is one narrow projection that
stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark.config import TolerancePolicy

# Status, availability and outcome texts of the checker.
OUT, LOW, IN = "Out of Stock", "Low Stock", "In Stock"
AVAIL_EC_ONLY = "Available in Ecommerce only"
AVAIL_WH_ONLY = "Available in Warehouse only"
AVAIL_BOTH = "Available in both Ecommerce and Warehouse"
AVAIL_NONE = "Out of Stock everywhere"
COMPARISON_KEY = "Stock Qty Comparison"
UNKNOWN_SKU = "UNKNOWN-SKU"

# Output columns, in the checker's order (display names for export, SNK-8).
ALL_COLUMNS = [
    "Timestamp", "SKU", "Ecommerce Qty", "Warehouse Qty", "Use Low Stock Logic",
    "Low Stock Max Qty", "Applied Severity", "Tolerance (%)", "Tolerance Base",
    "Tolerance Rounding", "Tolerance Units", "Delta", "Ecommerce Status",
    "Warehouse Status", "Availability", COMPARISON_KEY, "Reason",
]
DEFAULT_VISIBLE_COLUMNS = [
    "Timestamp", "SKU", "Ecommerce Qty", "Warehouse Qty", "Delta", "Applied Severity", COMPARISON_KEY, "Reason",
]
# snake_case names used inside the engine, same order as ALL_COLUMNS
SNAKE_COLUMNS = [
    "timestamp", "sku", "ecommerce_qty", "warehouse_qty", "use_low_stock", "low_stock_max",
    "applied_severity", "tolerance_pct", "tolerance_base", "tolerance_rounding", "tolerance_units",
    "delta", "ecommerce_status", "warehouse_status", "availability", "comparison", "reason",
]


def stock_status(q: Column, use_low: Column, low_max: Column) -> Column:
    """CND-1: 0 -> Out; low-stock enabled and 1 <= q <= max -> Low; else In (negatives are In)."""
    return (F.when(q == 0, OUT)
            .when(use_low & (q >= 1) & (q <= low_max), LOW)
            .otherwise(IN))


def availability(ec_st: Column, wh_st: Column) -> Column:
    """CND-2."""
    eo, wo = ec_st == OUT, wh_st == OUT
    return (F.when(~eo & wo, AVAIL_EC_ONLY).when(eo & ~wo, AVAIL_WH_ONLY)
            .when(~eo & ~wo, AVAIL_BOTH).otherwise(AVAIL_NONE))


def auto_severity(ec_st: Column, wh_st: Column, equal_status: str) -> Column:
    """CND-3: exactly one side out -> Critical; statuses differ -> High; else configured."""
    return (F.when((ec_st == OUT) != (wh_st == OUT), "Critical")
            .when(ec_st != wh_st, "High").otherwise(F.lit(equal_status)))


def _by_severity(sev: Column, policy: TolerancePolicy, field: str, cast: str) -> Column:
    expr = None
    for name, spec in policy.severities().items():
        v = spec[field]
        lit = F.lit(v).cast(cast) if v is not None else F.lit(None).cast(cast)
        expr = F.when(sev == name, lit) if expr is None else expr.when(sev == name, lit)
    return expr.otherwise(F.lit(None).cast(cast))


def tolerance_units(ec: Column, wh: Column, sev: Column, policy: TolerancePolicy) -> Column:
    """CND-4: base x pct, rounded, then max(min_units, .), then capped by max_units."""
    pct = _by_severity(sev, policy, "pct", "double")
    mn = F.coalesce(_by_severity(sev, policy, "min_units", "bigint"), F.lit(0).cast("bigint"))
    mx = _by_severity(sev, policy, "max_units", "bigint")
    base = {
        "min": F.least(ec, wh).cast("double"),
        "avg": (ec + wh) / F.lit(2.0),
        "ecommerce": ec.cast("double"),
        "warehouse": wh.cast("double"),
    }.get(policy.base_method, F.greatest(ec, wh).cast("double"))
    raw = base * pct
    r = {"ceil": F.ceil(raw), "round": F.bround(raw, 0)}.get(policy.rounding, F.floor(raw))
    units = F.greatest(mn, r.cast("bigint"))
    return F.when(mx.isNotNull(), F.least(units, mx)).otherwise(units)


def evaluate(df: DataFrame, policy: TolerancePolicy, run_ts: str,
             sku: str = "sku", ec: str = "ec_qty", wh: str = "wh_qty",
             use_low: str = "use_low_stock", low_max: str = "low_stock_max") -> DataFrame:
    """CND-5: grade every row; 17 output columns (snake_case, see ALL_COLUMNS).

    ``run_ts`` is the run-level timestamp text (DT-1), fixed per run so the
    output is reproducible.
    """
    e = F.col(ec).cast("bigint")
    w = F.col(wh).cast("bigint")
    ul = F.coalesce(F.col(use_low).cast("boolean"), F.lit(False))
    lm = F.when(ul, F.coalesce(F.col(low_max).cast("bigint"), F.lit(0).cast("bigint"))) \
          .otherwise(F.lit(0).cast("bigint"))
    sku_txt = F.regexp_replace(F.coalesce(F.col(sku).cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")
    d = df.select(
        F.when(sku_txt == "", F.lit(UNKNOWN_SKU)).otherwise(sku_txt).alias("sku"),
        e.alias("ecommerce_qty"), w.alias("warehouse_qty"), ul.alias("use_low_stock"),
        lm.alias("low_stock_max"))
    e, w = F.col("ecommerce_qty"), F.col("warehouse_qty")
    d = d.withColumn("ecommerce_status", stock_status(e, F.col("use_low_stock"), F.col("low_stock_max")))
    d = d.withColumn("warehouse_status", stock_status(w, F.col("use_low_stock"), F.col("low_stock_max")))
    es, ws = F.col("ecommerce_status"), F.col("warehouse_status")
    d = d.withColumn("applied_severity", auto_severity(es, ws, policy.equal_status_severity))
    sev = F.col("applied_severity")
    d = d.withColumn("tolerance_units", tolerance_units(e, w, sev, policy))
    d = d.withColumn("delta", F.abs(e - w))
    tol, delta = F.col("tolerance_units"), F.col("delta")
    if policy.mode == "strict":
        label = F.when(e == w, "Match").otherwise("Mismatch")
        reason = F.when(e == w, F.lit("Quantities are equal.")).otherwise(
            F.format_string("Quantities differ (Δ=%d).", delta))
    else:
        diverge = (es != ws) & (tol == 0)
        label = F.when(diverge, "Mismatch").when(delta <= tol, "Match").otherwise("Mismatch")
        reason = (F.when(diverge, F.lit("Statuses diverge; tolerance is 0 for this severity."))
                  .when(delta <= tol, F.format_string("Delta ≤ tolerance (%d ≤ %d).", delta, tol))
                  .otherwise(F.format_string("Delta exceeds tolerance (%d > %d).", delta, tol)))
    pct = _by_severity(sev, policy, "pct", "double")
    d = d.select(
        F.lit(run_ts).alias("timestamp"), "sku", "ecommerce_qty", "warehouse_qty", "use_low_stock",
        "low_stock_max", "applied_severity", pct.alias("tolerance_pct"),
        F.lit(policy.base_method).alias("tolerance_base"), F.lit(policy.rounding).alias("tolerance_rounding"),
        "tolerance_units", "delta", "ecommerce_status", "warehouse_status",
        availability(es, ws).alias("availability"), label.alias("comparison"), reason.alias("reason"))
    return d


def to_display(df: DataFrame, visible=None) -> DataFrame:
    """SNK-8/PRJ-3: rename to the checker's display names; optional visible preset."""
    out = df.select(*[F.col(s).alias(n) for s, n in zip(SNAKE_COLUMNS, ALL_COLUMNS)])
    if visible is None:
        return out
    keep = [c for c in visible if c in ALL_COLUMNS] or DEFAULT_VISIBLE_COLUMNS
    return out.select(*[F.col(f"`{c}`") for c in keep])
