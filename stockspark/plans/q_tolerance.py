"""Tolerance grading queries: per part, EC = number of odd lines, WH = number of even lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockspark.config import TolerancePolicy
from stockspark.operators import tolerance as T
from stockspark.plans import fixtures as X
from stockspark.plans.catalog import query

RUN_TS = "2026-01-01 00:00:00"   # fixed run timestamp (DT-1) so runs are reproducible


def _input(spark, sf_dir):
    """(sku, ec_qty, wh_qty, use_low_stock, low_stock_max) per part, one aggregate pass."""
    li = X.Tables(spark, sf_dir).lineitem
    g = li.groupBy("l_partkey").agg(F.count_if(F.col("l_linenumber") % 2 == 1).alias("ec_qty"),
                                    F.count_if(F.col("l_linenumber") % 2 == 0).alias("wh_qty"))
    return g.select(F.concat(F.lit(" SKU-"), F.col("l_partkey").cast("string")).alias("sku"), "ec_qty", "wh_qty",
                    (F.col("l_partkey") % 2 == 0).alias("use_low_stock"),
                    (F.col("l_partkey") % 50).alias("low_stock_max"))


def _sql(p: TolerancePolicy) -> str:
    sev = p.severities()
    def by(field):
        parts = []
        for name, spec in sev.items():
            v = spec[field]
            parts.append(f"WHEN '{name}' THEN {('NULL' if v is None else repr(v))}")
        return "CASE applied_severity " + " ".join(parts) + " END"
    base = {"min": "CAST(least(e, w) AS DOUBLE)", "avg": "(e + w) / 2.0", "ecommerce": "CAST(e AS DOUBLE)",
            "warehouse": "CAST(w AS DOUBLE)"}.get(p.base_method, "CAST(greatest(e, w) AS DOUBLE)")
    raw = f"({base} * ({by('pct')}))"
    rnd = {"ceil": f"ceil({raw})", "round": f"round_even({raw}, 0)"}.get(p.rounding, f"floor({raw})")
    units = f"greatest(COALESCE({by('min_units')}, 0), CAST({rnd} AS BIGINT))"
    tol = f"CASE WHEN ({by('max_units')}) IS NOT NULL THEN least({units}, {by('max_units')}) ELSE {units} END"
    if p.mode == "strict":
        label = "CASE WHEN e = w THEN 'Match' ELSE 'Mismatch' END"
        reason = "CASE WHEN e = w THEN 'Quantities are equal.' ELSE printf('Quantities differ (Δ=%d).', delta) END"
    else:
        div = "(es <> ws AND tol = 0)"
        label = f"CASE WHEN {div} THEN 'Mismatch' WHEN delta <= tol THEN 'Match' ELSE 'Mismatch' END"
        reason = (f"CASE WHEN {div} THEN 'Statuses diverge; tolerance is 0 for this severity.' "
                  "WHEN delta <= tol THEN printf('Delta ≤ tolerance (%d ≤ %d).', delta, tol) "
                  "ELSE printf('Delta exceeds tolerance (%d > %d).', delta, tol) END")
    def status(q):
        return f"CASE WHEN {q} = 0 THEN 'Out of Stock' WHEN ul AND {q} >= 1 AND {q} <= lm THEN 'Low Stock' ELSE 'In Stock' END"
    return f"""
WITH g AS (
  SELECT l_partkey,
         count(*) FILTER (WHERE l_linenumber % 2 = 1) AS e,
         count(*) FILTER (WHERE l_linenumber % 2 = 0) AS w
  FROM lineitem GROUP BY l_partkey),
i AS (SELECT trim(' SKU-' || CAST(l_partkey AS VARCHAR)) AS sku, e, w, l_partkey % 2 = 0 AS ul,
             CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey % 50 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS lm
      FROM g),
s AS (SELECT *, {status('e')} AS es, {status('w')} AS ws, abs(e - w) AS delta FROM i),
v AS (SELECT *, CASE WHEN (es = 'Out of Stock') <> (ws = 'Out of Stock') THEN 'Critical'
                     WHEN es <> ws THEN 'High' ELSE '{p.equal_status_severity}' END AS applied_severity FROM s),
t AS (SELECT *, {tol} AS tol FROM v)
SELECT '{RUN_TS}' AS timestamp, sku, e AS ecommerce_qty, w AS warehouse_qty, ul AS use_low_stock,
       lm AS low_stock_max, applied_severity, CAST({by('pct')} AS DOUBLE) AS tolerance_pct,
       '{p.base_method}' AS tolerance_base, '{p.rounding}' AS tolerance_rounding, tol AS tolerance_units,
       delta, es AS ecommerce_status, ws AS warehouse_status,
       CASE WHEN es <> 'Out of Stock' AND ws = 'Out of Stock' THEN 'Available in Ecommerce only'
            WHEN es = 'Out of Stock' AND ws <> 'Out of Stock' THEN 'Available in Warehouse only'
            WHEN es <> 'Out of Stock' AND ws <> 'Out of Stock' THEN 'Available in both Ecommerce and Warehouse'
            ELSE 'Out of Stock everywhere' END AS availability,
       {label} AS comparison, {reason} AS reason
FROM t"""


def _register(name, policy: TolerancePolicy, doc: str):
    @query(name, _sql(policy))
    def _q(spark, sf_dir):
        return T.evaluate(_input(spark, sf_dir), policy, RUN_TS)
    _q.__doc__ = doc
    return _q


_register("tolerance_strict", TolerancePolicy(mode="strict"), "CND-5 strict: equality only.")
_register("tolerance_tolerant_max_floor", TolerancePolicy(mode="tolerant", base_method="max", rounding="floor"),
          "CND-5 tolerant, base max, floor (the checker's defaults).")
_register("tolerance_tolerant_avg_round", TolerancePolicy(mode="tolerant", base_method="avg", rounding="round"),
          "CND-5 tolerant, base avg, round half-even.")
_register("tolerance_tolerant_min_ceil", TolerancePolicy(mode="tolerant", base_method="min", rounding="ceil"),
          "CND-5 tolerant, base min, ceil.")
_register("tolerance_tolerant_ec_custom",
          TolerancePolicy(mode="tolerant", base_method="ecommerce", rounding="round", equal_status_severity="Low",
                          severity_map=(("Critical", 0.0, 0, 0), ("High", 0.02, 1, 3), ("Medium", 0.05, 1, None),
                                        ("Low", 0.15, 2, 6), ("Very Low", 0.2, 1, None))),
          "CND-4/5 with a custom severity map (honoured), base ecommerce, equal-status severity Low.")
