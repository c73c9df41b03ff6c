"""Comparison queries (V1-V5) on lineitem split into two snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockspark.config import Normalization, SideMapping
from stockspark.operators import compare as C
from stockspark.plans import fixtures as X
from stockspark.plans.catalog import query
from stockspark.plans.sqlkit import LI_COLS, LI_ORDER_DESC, coerce, norm, num, pad, strip

# ---------------------------------------------------------------------------------- V1

V1_NORM = Normalization(case="lower", trim=True, collapse_spaces=True, zero_pad=6)
V1_MAP = SideMapping(key_cols=("brand", "type", "supplier"), qty_col="qty", norm=V1_NORM)


def _v1_sides(spark, sf_dir):
    t = X.Tables(spark, sf_dir)
    return X.v1_warehouse(t), X.v1_ecommerce(t)


_V1_CTE = f"""
lp AS (SELECT l.*, p.p_brand, p.p_type FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
wh_raw AS (
  SELECT '  ' || upper(replace(p_brand, '#', ' #')) AS brand, lower(p_type) || chr(9) AS type,
         CAST(l_suppkey AS VARCHAR) AS supplier, CAST(l_quantity AS VARCHAR) AS qty, {LI_COLS}
  FROM lp WHERE l_linestatus = 'O'),
ec_raw AS (
  SELECT replace(p_brand, '#', '  #') AS brand, ' ' || p_type AS type,
         printf('%05d', l_suppkey) AS supplier,
         CASE WHEN l_discount = 0 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS qty, {LI_COLS}
  FROM lp WHERE l_linestatus = 'F'),
wh_n AS (SELECT {norm('brand')} AS k1, {norm('type')} AS k2, {norm('supplier')} AS k3, * FROM wh_raw),
ec_n AS (SELECT {norm('brand')} AS k1, {norm('type')} AS k2, {norm('supplier')} AS k3, * FROM ec_raw),
wh_k AS (SELECT {pad('k1', 6)} || '|' || {pad('k2', 6)} || '|' || {pad('k3', 6)} AS key, * FROM wh_n),
ec_k AS (SELECT {pad('k1', 6)} || '|' || {pad('k2', 6)} || '|' || {pad('k3', 6)} AS key, * FROM ec_n),
w AS (SELECT key, {coerce('qty')} AS qty FROM wh_k WHERE key <> ''
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY {LI_ORDER_DESC}) = 1),
e AS (SELECT key, {coerce('qty')} AS qty FROM ec_k WHERE key <> ''
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY {LI_ORDER_DESC}) = 1),
v1 AS (
  SELECT COALESCE(w.key, e.key) AS key, COALESCE(w.qty, 0.0) AS wh_qty, COALESCE(e.qty, 0.0) AS ec_qty,
         COALESCE(w.qty, 0.0) - COALESCE(e.qty, 0.0) AS diff,
         CASE WHEN e.key IS NULL THEN 'Only in Warehouse' WHEN w.key IS NULL THEN 'Only in Ecommerce'
              ELSE 'Both' END AS presence
  FROM w FULL OUTER JOIN e ON w.key = e.key)
"""


@query("v1_compare", f"WITH {_V1_CTE} SELECT * FROM v1")
def v1_compare(spark, sf_dir):
    """V1: composite normalised key, keep last, full outer, presence + diff."""
    wh, ec = _v1_sides(spark, sf_dir)
    return C.compare_v1(wh, ec, V1_MAP, V1_MAP)


@query("v1_only_warehouse", f"WITH {_V1_CTE} SELECT * FROM v1 WHERE presence = 'Only in Warehouse'")
def v1_only_warehouse(spark, sf_dir):
    """V1 with presence 'Only in Warehouse' planned as an anti join."""
    wh, ec = _v1_sides(spark, sf_dir)
    return C.compare_v1(wh, ec, V1_MAP, V1_MAP, presence=C.ONLY_WH)


@query("v1_only_ecommerce", f"WITH {_V1_CTE} SELECT * FROM v1 WHERE presence = 'Only in Ecommerce'")
def v1_only_ecommerce(spark, sf_dir):
    wh, ec = _v1_sides(spark, sf_dir)
    return C.compare_v1(wh, ec, V1_MAP, V1_MAP, presence=C.ONLY_EC)


@query("v1_both_differences",
       f"WITH {_V1_CTE} SELECT * FROM v1 WHERE presence = 'Both' AND diff <> 0")
def v1_both_differences(spark, sf_dir):
    """V1 inner join + FLT-3 with the tool's default (diff != 0)."""
    wh, ec = _v1_sides(spark, sf_dir)
    return C.filter_result(C.compare_v1(wh, ec, V1_MAP, V1_MAP, presence=C.BOTH), diff_op="!=", threshold=0)


@query("v1_diff_threshold",
       f"WITH {_V1_CTE} SELECT * FROM v1 WHERE abs(diff) <> 0 AND diff >= 10")
def v1_diff_threshold(spark, sf_dir):
    """FLT-3: only differences and diff >= 10 over all presences."""
    wh, ec = _v1_sides(spark, sf_dir)
    return C.filter_result(C.compare_v1(wh, ec, V1_MAP, V1_MAP), only_diff=True, diff_op=">=", threshold=10)


@query("v1_union_form", f"WITH {_V1_CTE} SELECT * FROM v1")
def v1_union_form(spark, sf_dir):
    """SET-1/JN-13: LEFT JOIN UNION ALL right-only anti join; same rows as v1_compare."""
    wh, ec = _v1_sides(spark, sf_dir)
    return C.union_compare_v1(wh, ec, V1_MAP, V1_MAP)


def _v1_keysets(spark, sf_dir):
    wh, ec = _v1_sides(spark, sf_dir)
    w = C.normalized_side(wh, V1_MAP)
    e = C.normalized_side(ec, V1_MAP)
    return C.key_sets(w, e)


@query("keys_union", f"WITH {_V1_CTE} SELECT key FROM w UNION SELECT key FROM e")
def keys_union(spark, sf_dir):
    """SET-2."""
    return _v1_keysets(spark, sf_dir)["union"]


@query("keys_intersect", f"WITH {_V1_CTE} SELECT key FROM w INTERSECT SELECT key FROM e")
def keys_intersect(spark, sf_dir):
    """SET-3."""
    return _v1_keysets(spark, sf_dir)["intersect"]


@query("keys_except", f"WITH {_V1_CTE} SELECT key FROM e EXCEPT SELECT key FROM w")
def keys_except(spark, sf_dir):
    """SET-4: right-only keys."""
    return _v1_keysets(spark, sf_dir)["except"]


# ---------------------------------------------------------------------------------- V2

def _v2_sides(spark, sf_dir):
    t = X.Tables(spark, sf_dir)
    li = t.lineitem
    wh = li.where(F.col("l_linestatus") == "O").select(
        F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(" ")).alias("item_id"),
        F.col("l_quantity").cast("string").alias("on_hand"), X.li_ord())
    ec = li.where(F.col("l_linestatus") == "F").select(
        F.col("l_partkey").cast("string").alias("item_id"),
        F.when(F.col("l_tax") == 0, F.lit("")).otherwise(F.col("l_quantity").cast("string")).alias("qty"),
        X.li_ord())
    return wh, ec


_V2_CTE = f"""
wr AS (SELECT trim(' ' || CAST(l_partkey AS VARCHAR) || ' ') AS key, CAST(l_quantity AS VARCHAR) AS q, {LI_COLS}
       FROM lineitem WHERE l_linestatus = 'O'),
er AS (SELECT CAST(l_partkey AS VARCHAR) AS key,
              CASE WHEN l_tax = 0 THEN '' ELSE CAST(l_quantity AS VARCHAR) END AS q, {LI_COLS}
       FROM lineitem WHERE l_linestatus = 'F'),
w AS (SELECT key, {coerce('q')} AS qty FROM wr
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY {LI_ORDER_DESC}) = 1),
e AS (SELECT key, {coerce('q')} AS qty FROM er
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY {LI_ORDER_DESC}) = 1),
v2 AS (SELECT w.key, w.qty AS wh_qty, e.qty AS ec_qty, w.qty - e.qty AS diff,
              CASE WHEN w.qty - e.qty = 0 THEN 'zero' WHEN w.qty - e.qty > 0 THEN 'pos' ELSE 'neg' END AS sign
       FROM w JOIN e ON w.key = e.key)
"""


@query("v2_compare", f"WITH {_V2_CTE} SELECT * FROM v2")
def v2_compare(spark, sf_dir):
    """V2: stripped single id, keep last, inner join, sign tag."""
    wh, ec = _v2_sides(spark, sf_dir)
    return C.compare_v2(wh, ec, "item_id", "on_hand", "item_id", "qty")


@query("v2_only_diffs", f"WITH {_V2_CTE} SELECT * FROM v2 WHERE diff <> 0")
def v2_only_diffs(spark, sf_dir):
    wh, ec = _v2_sides(spark, sf_dir)
    return C.compare_v2(wh, ec, "item_id", "on_hand", "item_id", "qty", only_diffs=True)


# ---------------------------------------------------------------------------------- V3

def _v3_sides(spark, sf_dir):
    li = X.Tables(spark, sf_dir).lineitem
    a = li.where(F.col("l_returnflag") != "N").select(
        F.col("l_suppkey").cast("string").alias("Vendor"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("Item SKU"),
        F.col("l_quantity").alias("Qty"))
    b = li.where(F.col("l_returnflag") == "N").select(
        F.col("l_suppkey").alias("vendor_no"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("sku"),
        (F.col("l_quantity") + F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("stock"))
    return a, b


_V3_CTE = """
a AS (SELECT CAST(l_suppkey AS BIGINT) AS vendor_id, 'P' || CAST(l_partkey AS VARCHAR) AS sku,
             CAST(trunc(l_quantity) AS BIGINT) AS qty_A FROM lineitem WHERE l_returnflag <> 'N'),
b AS (SELECT CAST(l_suppkey AS BIGINT) AS vendor_id, 'P' || CAST(l_partkey AS VARCHAR) AS sku,
             CAST(trunc(l_quantity + CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS qty_B,
             TRUE AS in_b
      FROM lineitem WHERE l_returnflag = 'N'),
a2 AS (SELECT *, TRUE AS in_a FROM a),
v3 AS (SELECT COALESCE(a2.vendor_id, b.vendor_id) AS vendor_id, COALESCE(a2.sku, b.sku) AS sku,
              COALESCE(qty_A, 0) AS qty_A, COALESCE(qty_B, 0) AS qty_B,
              CASE WHEN in_b IS NULL THEN 'Only in A' WHEN in_a IS NULL THEN 'Only in B'
                   WHEN COALESCE(qty_A, 0) = COALESCE(qty_B, 0) THEN 'Matched' ELSE 'Mismatched' END AS Status
       FROM a2 FULL OUTER JOIN b ON a2.vendor_id = b.vendor_id AND a2.sku = b.sku)
"""


_V3_COLS = (("Vendor", "Item SKU", "Qty"), ("vendor_no", "sku", "stock"))


@query("v3_vendor_compare", f"WITH {_V3_CTE} SELECT * FROM v3")
def v3_vendor_compare(spark, sf_dir):
    """V3: (vendor_id, sku) full outer join without dedupe (m x n), strict ints."""
    a, b = _v3_sides(spark, sf_dir)
    return C.compare_v3(a, b, *_V3_COLS)


@query("v3_status_counts", f"""WITH {_V3_CTE},
labels AS (SELECT * FROM (VALUES (0, 'Matched'), (1, 'Mismatched'), (2, 'Only in A'), (3, 'Only in B'))
           AS t(pos, Status))
SELECT l.pos, l.Status, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
FROM labels l LEFT JOIN (SELECT Status, count(*) AS n FROM v3 GROUP BY Status) c ON l.Status = c.Status""")
def v3_status_counts(spark, sf_dir):
    """AGG-2."""
    a, b = _v3_sides(spark, sf_dir)
    return C.counts_from_totals_v3(C.totals_v3(a, b, *_V3_COLS))


@query("v3_stats", f"""WITH {_V3_CTE}
SELECT (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'N') AS rows_a,
       (SELECT count(*) FROM lineitem WHERE l_returnflag = 'N') AS rows_b,
       (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_returnflag <> 'N') AS unique_skus_a,
       (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_returnflag = 'N') AS unique_skus_b,
       count(*) FILTER (WHERE Status = 'Matched') AS matched,
       count(*) FILTER (WHERE Status = 'Mismatched') AS mismatched,
       count(*) FILTER (WHERE Status = 'Only in A') AS only_a,
       count(*) FILTER (WHERE Status = 'Only in B') AS only_b,
       CAST(COALESCE(sum(qty_B - qty_A) FILTER (WHERE Status = 'Mismatched'), 0) AS BIGINT) AS qty_variance,
       round(CASE WHEN count(*) FILTER (WHERE Status IN ('Matched', 'Mismatched')) > 0
             THEN count(*) FILTER (WHERE Status = 'Matched') * 100.0
                  / count(*) FILTER (WHERE Status IN ('Matched', 'Mismatched'))
             ELSE 0.0 END, 2) AS match_rate
FROM v3""")
def v3_stats(spark, sf_dir):
    """AGG-3 in one pass."""
    a, b = _v3_sides(spark, sf_dir)
    return C.stats_from_totals_v3(C.totals_v3(a, b, *_V3_COLS))


# ---------------------------------------------------------------------------------- V4

def _v4_sides(spark, sf_dir):
    li = X.Tables(spark, sf_dir).lineitem
    a = li.where(F.col("l_returnflag") != "R").select(
        F.col("l_partkey").cast("string").alias("sku"), F.col("l_suppkey").cast("string").alias("acct"),
        F.when(F.col("l_discount") == 0, F.lit("x")).otherwise(F.col("l_quantity").cast("string"))
         .alias("quantity"))
    b = li.where(F.col("l_returnflag") == "R").select(
        F.col("l_partkey").cast("string").alias("item"), F.col("l_suppkey").cast("string").alias("account"),
        F.col("l_quantity").cast("string").alias("free_stock"))
    return a, b


_V4_CTE = f"""
a AS (SELECT CAST(l_partkey AS VARCHAR) AS sku, CAST(l_suppkey AS VARCHAR) AS account_number,
             {num("CASE WHEN l_discount = 0 THEN 'x' ELSE CAST(l_quantity AS VARCHAR) END")} AS quantity_warehouse
      FROM lineitem WHERE l_returnflag <> 'R'),
b AS (SELECT CAST(l_partkey AS VARCHAR) AS sku, CAST(l_suppkey AS VARCHAR) AS account_number,
             {num("CAST(l_quantity AS VARCHAR)")} AS quantity_ecommerce
      FROM lineitem WHERE l_returnflag = 'R'),
v4 AS (SELECT a.sku, a.account_number, quantity_warehouse, quantity_ecommerce,
              quantity_warehouse - quantity_ecommerce AS quantity_difference,
              CASE WHEN quantity_warehouse - quantity_ecommerce = 0 THEN 'Match' ELSE 'Mismatch' END AS status
       FROM (SELECT * FROM a WHERE quantity_warehouse IS NOT NULL) a
       JOIN (SELECT * FROM b WHERE quantity_ecommerce IS NOT NULL) b
         ON a.sku IS NOT DISTINCT FROM b.sku AND a.account_number IS NOT DISTINCT FROM b.account_number)
"""


_V4_COLS = (("sku", "acct", "quantity"), ("item", "account", "free_stock"))


@query("v4_basic_compare", f"WITH {_V4_CTE} SELECT * FROM v4")
def v4_basic_compare(spark, sf_dir):
    """V4: inner m x n join on raw (sku, account), null-safe, bad quantities dropped."""
    a, b = _v4_sides(spark, sf_dir)
    return C.compare_v4(a, b, *_V4_COLS)


@query("v4_kpis", f"""WITH {_V4_CTE}
SELECT count(*) AS total_matched, count(*) FILTER (WHERE status = 'Match') AS match_count,
       count(*) FILTER (WHERE status = 'Mismatch') AS mismatch_count,
       count(*) FILTER (WHERE quantity_warehouse > 0 AND quantity_ecommerce = 0) AS wh_in_ecom_out,
       count(*) FILTER (WHERE quantity_ecommerce > 0 AND quantity_warehouse = 0) AS ecom_in_wh_out,
       count(*) FILTER (WHERE quantity_warehouse > 0 AND quantity_ecommerce > 0) AS in_stock_both,
       COALESCE(sum(quantity_warehouse), 0.0) AS total_qty_a, COALESCE(sum(quantity_ecommerce), 0.0) AS total_qty_b,
       COALESCE(sum(abs(quantity_difference)), 0.0) AS total_discrepancy
FROM v4""")
def v4_kpis(spark, sf_dir):
    """AGG-4."""
    a, b = _v4_sides(spark, sf_dir)
    return C.totals_v4(a, b, *_V4_COLS)


# ---------------------------------------------------------------------------------- V5

def _v5_sides(spark, sf_dir, clamp=False):
    li = X.Tables(spark, sf_dir).lineitem
    a = li.where(F.col("l_linestatus") == "O").select(
        F.concat(F.lit(" p-"), F.col("l_partkey").cast("string")).alias("Product Code"),
        F.col("l_suppkey").cast("string").alias("Account"),
        F.when(F.col("l_tax") == 0, F.lit(None).cast("string"))
         .when(F.col("l_discount") == 0.1, (-F.col("l_quantity")).cast("string"))
         .otherwise(F.col("l_quantity").cast("string")).alias("Qty"),
        X.li_ord())
    b = li.where(F.col("l_linestatus") == "F").select(
        F.concat(F.lit("P-"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("sku"),
        F.concat(F.lit(" "), F.col("l_suppkey").cast("string")).alias("account_number"),
        F.when(F.col("l_tax") == 0.08, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
         .alias("free_stock"),
        X.li_ord())
    na = C.normalize_v5(a, "Product Code", "Account", "Qty", clamp=clamp)
    nb = C.normalize_v5(b, "sku", "account_number", "free_stock", clamp=clamp)
    return na, nb


def _v5_cte(how: str, clamp: bool = False) -> str:
    qa = ("CASE WHEN l_tax = 0 THEN NULL WHEN l_discount = 0.1 THEN CAST(-l_quantity AS VARCHAR) "
          "ELSE CAST(l_quantity AS VARCHAR) END")
    qb = "CASE WHEN l_tax = 0.08 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END"
    def q(x):
        v = num(x)
        return f"CASE WHEN {v} < 0 THEN 0.0 ELSE {v} END" if clamp else v
    agg = {
        "sum": "COALESCE(sum(qty), 0.0)",
        "max": "max(qty)",
        "min": "min(qty)",
        "first": "arg_min(qty, o) FILTER (WHERE qty IS NOT NULL)",
        "last": "arg_max(qty, o) FILTER (WHERE qty IS NOT NULL)",
    }[how]
    return f"""
na AS (SELECT upper({strip("COALESCE(' p-' || CAST(l_partkey AS VARCHAR), 'nan')")}) AS sku_key,
              upper({strip("COALESCE(CAST(l_suppkey AS VARCHAR), 'nan')")}) AS account_key,
              {q(qa)} AS qty, row_number() OVER (ORDER BY {LI_ORDER_DESC.replace(' DESC', '')}) AS o
       FROM lineitem WHERE l_linestatus = 'O'),
nb AS (SELECT upper({strip("COALESCE('P-' || CAST(l_partkey AS VARCHAR) || ' ', 'nan')")}) AS sku_key,
              upper({strip("COALESCE(' ' || CAST(l_suppkey AS VARCHAR), 'nan')")}) AS account_key,
              {q(qb)} AS qty, row_number() OVER (ORDER BY {LI_ORDER_DESC.replace(' DESC', '')}) AS o
       FROM lineitem WHERE l_linestatus = 'F'),
ga AS (SELECT sku_key, account_key, {agg} AS qty_wh FROM na GROUP BY sku_key, account_key),
gb AS (SELECT sku_key, account_key, {agg} AS qty_ecom FROM nb GROUP BY sku_key, account_key),
m AS (SELECT COALESCE(ga.sku_key, gb.sku_key) AS sku_key, COALESCE(ga.account_key, gb.account_key) AS account_key,
             qty_wh AS raw_wh, qty_ecom AS raw_ecom
      FROM ga FULL OUTER JOIN gb ON ga.sku_key = gb.sku_key AND ga.account_key = gb.account_key),
v5 AS (SELECT sku_key, account_key, COALESCE(raw_wh, 0.0) AS qty_wh, COALESCE(raw_ecom, 0.0) AS qty_ecom,
              COALESCE(raw_wh, 0.0) - COALESCE(raw_ecom, 0.0) AS qty_diff,
              CASE WHEN COALESCE(raw_wh, 0.0) - COALESCE(raw_ecom, 0.0) = 0 THEN 'Match' ELSE 'Mismatch' END AS status,
              CASE WHEN raw_wh IS NOT NULL AND raw_ecom IS NOT NULL THEN 'Both'
                   WHEN raw_wh IS NOT NULL THEN 'Warehouse Only'
                   WHEN raw_ecom IS NOT NULL THEN 'E-Commerce Only' ELSE '—' END AS source_status,
              COALESCE(raw_wh, 0.0) > 0 AS in_stock_wh, COALESCE(raw_ecom, 0.0) > 0 AS in_stock_ecom,
              raw_wh IS NOT NULL AS present_wh, raw_ecom IS NOT NULL AS present_ecom
       FROM m)
"""


def _v5(spark, sf_dir, how, clamp=False):
    a, b = _v5_sides(spark, sf_dir, clamp)
    return C.compare_v5(a, b, how)


def _register_v5(how):
    @query(f"v5_compare_{how}", f"WITH {_v5_cte(how)} SELECT * FROM v5")
    def _q(spark, sf_dir):
        return _v5(spark, sf_dir, how)
    _q.__doc__ = f"V5: upper/strip keys, duplicates aggregated by {how}, full outer, 11 columns."
    return _q


for _how in ("sum", "max", "min", "first", "last"):
    _register_v5(_how)


@query("v5_compare_sum_clamped", f"WITH {_v5_cte('sum', clamp=True)} SELECT * FROM v5")
def v5_compare_sum_clamped(spark, sf_dir):
    """V5 with negative quantities clamped to 0 (NUM-6)."""
    return _v5(spark, sf_dir, "sum", clamp=True)


@query("v5_rollup_account", f"""WITH {_v5_cte('sum')}
SELECT account_key, count(DISTINCT sku_key) AS total_items,
       count(*) FILTER (WHERE status = 'Match') AS matched, count(*) FILTER (WHERE status = 'Mismatch') AS mismatched,
       count(*) FILTER (WHERE source_status = 'Warehouse Only') AS wh_only,
       count(*) FILTER (WHERE source_status = 'E-Commerce Only') AS ecom_only,
       sum(qty_wh) AS qty_wh_total, sum(qty_ecom) AS qty_ecom_total, sum(abs(qty_diff)) AS abs_diff_total,
       count(*) FILTER (WHERE in_stock_wh AND NOT in_stock_ecom) AS instock_wh_oos_ecom,
       count(*) FILTER (WHERE in_stock_ecom AND NOT in_stock_wh) AS instock_ecom_oos_wh
FROM v5 GROUP BY account_key""")
def v5_rollup_account(spark, sf_dir):
    """AGG-7."""
    return C.rollup_by_account(_v5(spark, sf_dir, "sum"))


@query("v5_kpis", f"""WITH {_v5_cte('sum')}
SELECT count(*) AS total_records, count(*) FILTER (WHERE status = 'Match') AS match_count,
       count(*) FILTER (WHERE status = 'Mismatch') AS mismatch_count,
       count(*) FILTER (WHERE source_status = 'Warehouse Only') AS wh_only_count,
       count(*) FILTER (WHERE source_status = 'E-Commerce Only') AS ecom_only_count,
       count(*) FILTER (WHERE source_status = 'Both') AS both_sources_count,
       count(*) FILTER (WHERE in_stock_wh AND NOT in_stock_ecom) AS wh_stock_ecom_oos,
       count(*) FILTER (WHERE in_stock_ecom AND NOT in_stock_wh) AS ecom_stock_wh_oos,
       COALESCE(sum(qty_wh), 0.0) AS total_qty_a, COALESCE(sum(qty_ecom), 0.0) AS total_qty_b,
       COALESCE(sum(abs(qty_diff)), 0.0) AS total_abs_diff
FROM v5""")
def v5_kpis(spark, sf_dir):
    """AGG-5."""
    return C.kpis_v5(_v5(spark, sf_dir, "sum"))


@query("v5_status_distribution", f"""WITH {_v5_cte('max')}
SELECT status AS label, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share_pct
FROM v5 GROUP BY status""")
def v5_status_distribution(spark, sf_dir):
    """AGG-6 (status pie data)."""
    return C.distribution(_v5(spark, sf_dir, "max"), "status")


@query("v5_presence_distribution", f"""WITH {_v5_cte('max')}
SELECT source_status AS label, count(*) AS count,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share_pct
FROM v5 GROUP BY source_status""")
def v5_presence_distribution(spark, sf_dir):
    """AGG-6 (presence pie data)."""
    return C.distribution(_v5(spark, sf_dir, "max"), "source_status")


@query("v5_filtered_view", f"""WITH {_v5_cte('last')}
SELECT * FROM v5 WHERE status IN ('Mismatch') AND source_status IN ('Both', 'Warehouse Only')
  AND (qty_wh > 0 OR qty_ecom > 0)""")
def v5_filtered_view(spark, sf_dir):
    """FLT-7: status x presence multi-select with 'any qty > 0'."""
    return C.view_filter_v5(_v5(spark, sf_dir, "last"), ["Mismatch"], ["Both", "Warehouse Only"], True)


@query("v5_subset_wh_instock_ecom_oos", f"""WITH {_v5_cte('sum')}
SELECT * FROM v5 WHERE in_stock_wh AND NOT in_stock_ecom""")
def v5_subset_wh_instock_ecom_oos(spark, sf_dir):
    """SNK-6 subset: in stock in the warehouse, out of stock online."""
    return C.subset(_v5(spark, sf_dir, "sum"), "wh_instock_ecom_oos")
