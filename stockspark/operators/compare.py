"""The six snapshot-comparison variants.

Each variant is one lazy plan: per-side projection + normalisation, a
per-key reduction where the variant dedupes (partial aggregate, so the
shuffle carries one row per key per map task), and one equi-join whose
type is chosen from the requested presence (a filter on a CASE column would
keep a full outer join; choosing the join type lets Catalyst drop it).
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark.config import Normalization, SideMapping
from stockspark.functions.keys import PIPE, VDOTS, strip_ws, upper_strip, with_composite_key
from stockspark.functions.numeric import coerce_numeric, parse_number, sign_class, to_int_safe
from stockspark.operators.ordering import keep_last, row_tasks, spread

# Presence / status labels of the variants.
BOTH, ONLY_WH, ONLY_EC = "Both", "Only in Warehouse", "Only in Ecommerce"
MATCH, MISMATCH = "Match", "Mismatch"
V3_MATCHED, V3_MISMATCHED, V3_ONLY_A, V3_ONLY_B = "Matched", "Mismatched", "Only in A", "Only in B"
COV_BOTH, COV_WH, COV_EC, COV_NONE = "Both", "Warehouse Only", "E-Commerce Only", "—"


# --------------------------------------------------------------------------------------
# V1 composite-key compare (JN-4, FLT-1, WIN-1, NUM-1, CND-6, FLT-3)
# --------------------------------------------------------------------------------------

def normalized_side(df: DataFrame, mapping: SideMapping, order_col: str = "_ord",
                    sep: str = PIPE, drop_blank: bool = True) -> DataFrame:
    """(key, qty) for one side: composite key, blank keys dropped, last row per key kept."""
    d = with_composite_key(df.select(*[c for c in mapping.key_cols if c in df.columns],
                                     F.col(mapping.qty_col).cast("string").alias("_q"), order_col),
                           mapping.key_cols, mapping.norm, sep)
    d = d.select("key", "_q", order_col)
    used = [c for c in mapping.key_cols if c and c in df.columns]
    # FLT-1: with two or more pieces the key always holds a separator, so only a
    # single-column key can be blank (this also keeps Catalyst from re-evaluating
    # the normalisation inside a pushed-down filter).
    if drop_blank and len(used) < 2:
        d = d.where(F.col("key") != "")
    d = keep_last(d, ["key"], order_col)
    return d.select("key", coerce_numeric(F.col("_q")).alias("qty"))


def compare_v1(wh: DataFrame, ec: DataFrame, wh_map: SideMapping, ec_map: SideMapping,
               presence: str = "All", order_col: str = "_ord") -> DataFrame:
    """Full comparison: (key, wh_qty, ec_qty, diff, presence).

    presence "All" -> full outer join, "Both" -> inner, "Only in Warehouse"
    / "Only in Ecommerce" -> anti join from that side.
    """
    w = normalized_side(wh, wh_map, order_col).alias("w")
    e = normalized_side(ec, ec_map, order_col).alias("e")
    zero = F.lit(0.0)
    if presence == BOTH:
        j = w.join(e, F.col("w.key") == F.col("e.key"), "inner")
        out = j.select(F.col("w.key").alias("key"), F.col("w.qty").alias("wh_qty"),
                       F.col("e.qty").alias("ec_qty"), F.lit(BOTH).alias("presence"))
    elif presence == ONLY_WH:
        j = w.join(e, F.col("w.key") == F.col("e.key"), "left_anti")
        out = j.select("key", F.col("qty").alias("wh_qty"), zero.alias("ec_qty"),
                       F.lit(ONLY_WH).alias("presence"))
    elif presence == ONLY_EC:
        j = e.join(w, F.col("e.key") == F.col("w.key"), "left_anti")
        out = j.select("key", zero.alias("wh_qty"), F.col("qty").alias("ec_qty"),
                       F.lit(ONLY_EC).alias("presence"))
    else:
        j = w.join(e, F.col("w.key") == F.col("e.key"), "full")
        out = j.select(
            F.coalesce(F.col("w.key"), F.col("e.key")).alias("key"),
            F.coalesce(F.col("w.qty"), zero).alias("wh_qty"),
            F.coalesce(F.col("e.qty"), zero).alias("ec_qty"),
            F.when(F.col("e.key").isNull(), ONLY_WH).when(F.col("w.key").isNull(), ONLY_EC)
             .otherwise(BOTH).alias("presence"))
    return out.select("key", "wh_qty", "ec_qty", (F.col("wh_qty") - F.col("ec_qty")).alias("diff"),
                      "presence")


_OPS = {
    "!=": lambda d, t: d != t, ">": lambda d, t: d > t, "<": lambda d, t: d < t,
    ">=": lambda d, t: d >= t, "<=": lambda d, t: d <= t, "==": lambda d, t: d == t,
}


def filter_result(df: DataFrame, presence: str = "All", only_diff: bool = False,
                  diff_op: Optional[str] = "!=", threshold: float = 0.0) -> DataFrame:
    """FLT-3 on a V1 result (defaults hide matches, as the tool does)."""
    cond = F.lit(True)
    if presence and presence != "All":
        cond = cond & (F.col("presence") == presence)
    if only_diff:
        cond = cond & (F.abs(F.col("diff")) != 0)
    if diff_op:
        cond = cond & _OPS[diff_op](F.col("diff"), F.lit(float(threshold)))
    return df.where(cond)


def union_compare_v1(wh: DataFrame, ec: DataFrame, wh_map: SideMapping, ec_map: SideMapping,
                     order_col: str = "_ord") -> DataFrame:
    """SET-1 + JN-13: the tool's own formulation, LEFT JOIN UNION ALL right-only anti join.
    Same rows as ``compare_v1``; kept as the explicit set operation."""
    w = normalized_side(wh, wh_map, order_col).alias("w")
    e = normalized_side(ec, ec_map, order_col).alias("e")
    left = w.join(e, F.col("w.key") == F.col("e.key"), "left").select(
        F.col("w.key").alias("key"), F.col("w.qty").alias("wh_qty"),
        F.coalesce(F.col("e.qty"), F.lit(0.0)).alias("ec_qty"),
        F.when(F.col("e.key").isNull(), ONLY_WH).otherwise(BOTH).alias("presence"))
    right_only = e.join(w, F.col("e.key") == F.col("w.key"), "left_anti").select(
        F.col("key"), F.lit(0.0).alias("wh_qty"), F.col("qty").alias("ec_qty"),
        F.lit(ONLY_EC).alias("presence"))
    u = left.unionByName(right_only)
    return u.select("key", "wh_qty", "ec_qty", (F.col("wh_qty") - F.col("ec_qty")).alias("diff"),
                    "presence")


# --------------------------------------------------------------------------------------
# V2 simple compare (JN-1, FLT-2, FLT-4, NUM-8)
# --------------------------------------------------------------------------------------

def compare_v2(wh: DataFrame, ec: DataFrame, wh_id: str, wh_qty: str, ec_id: str, ec_qty: str,
               only_diffs: bool = False, order_col: str = "_ord") -> DataFrame:
    """Inner join on a stripped single id; null ids dropped; last row per id."""
    def side(df, idc, qc):
        d = df.where(F.col(idc).isNotNull()).select(
            strip_ws(F.col(idc).cast("string")).alias("key"), F.col(qc).cast("string").alias("_q"),
            F.col(order_col))
        d = keep_last(d, ["key"], order_col)
        return d.select("key", coerce_numeric("_q").alias("qty"))
    w = side(wh, wh_id, wh_qty).alias("w")
    e = side(ec, ec_id, ec_qty).alias("e")
    j = w.join(e, "key", "inner").select(
        "key", F.col("w.qty").alias("wh_qty"), F.col("e.qty").alias("ec_qty"))
    j = j.withColumn("diff", F.col("wh_qty") - F.col("ec_qty"))
    if only_diffs:
        j = j.where(F.col("diff") != 0)
    return j.withColumn("sign", sign_class("diff"))


def key_sets(wh: DataFrame, ec: DataFrame, key: str = "key") -> dict:
    """SET-2/3/4: union, intersection and right-only difference of two key sets."""
    a = wh.select(F.col(key).alias("key"))
    b = ec.select(F.col(key).alias("key"))
    return {
        "union": a.union(b).distinct(),
        "intersect": a.intersect(b),
        "except": b.subtract(a),          # EXCEPT DISTINCT: planned as left anti join + distinct
    }


# --------------------------------------------------------------------------------------
# V3 vendor compare (JN-3, NUM-4, AGG-2, AGG-3, FLT-5)
# --------------------------------------------------------------------------------------

def _strict_int(c: str, side: str) -> Column:
    """Non-numeric text fails the job (lazily, from the executor that meets it);
    null -> 0; fractions truncate."""
    raw = F.col(c)
    v = parse_number(raw)
    bad = raw.isNotNull() & v.isNull()
    msg = F.lit(f"Column '{c}' in Dataset {side} contains non-integer values.")
    return F.when(bad, F.raise_error(msg)).otherwise(
        F.coalesce(v, F.lit(0.0)).try_cast("bigint"))


def _v3_side(df: DataFrame, cols: tuple, side: str, qname: str) -> DataFrame:
    vc, sc, qc = cols
    return df.select(_strict_int(vc, side).alias("vendor_id"),
                     F.coalesce(F.col(sc).cast("string"), F.lit("nan")).alias("sku"),
                     _strict_int(qc, side).alias(qname))


def compare_v3(a: DataFrame, b: DataFrame, a_cols: tuple, b_cols: tuple) -> DataFrame:
    """(vendor_id, sku, qty_A, qty_B, Status); duplicates are not removed (m x n).

    The full outer join is planned as inner join UNION ALL both anti joins:
    the same rows, but each part is a join type AQE can split when one key is
    hot (Spark does not split skewed full outer joins), and the three joins
    reuse the same key exchanges.
    """
    x = _v3_side(a, a_cols, "A", "qty_A")
    y = _v3_side(b, b_cols, "B", "qty_B")
    keys = ["vendor_id", "sku"]
    zero = F.lit(0).cast("bigint")
    both = x.join(y, keys, "inner").select(
        *keys, "qty_A", "qty_B",
        F.when(F.col("qty_A") == F.col("qty_B"), V3_MATCHED).otherwise(V3_MISMATCHED).alias("Status"))
    only_a = x.join(y, keys, "left_anti").select(*keys, "qty_A", zero.alias("qty_B"), F.lit(V3_ONLY_A).alias("Status"))
    only_b = y.join(x, keys, "left_anti").select(*keys, zero.alias("qty_A"), "qty_B", F.lit(V3_ONLY_B).alias("Status"))
    return both.unionByName(only_a).unionByName(only_b)


def view_filter_v3(df: DataFrame, status: str = "All Results", vendor: str = "", sku: str = "",
                   regex: bool = True) -> DataFrame:
    """FLT-5: status equality + case-insensitive substring on vendor and sku."""
    d = df if status in (None, "", "All Results") else df.where(F.col("Status") == status)
    for col, term in (("vendor_id", vendor), ("sku", sku)):
        t = (term or "").strip().lower()
        if t:
            c = F.lower(F.col(col).cast("string"))
            d = d.where(c.rlike(t) if regex else c.contains(t))
    return d


def status_counts_v3(result: DataFrame) -> DataFrame:
    """AGG-2: counts in the fixed label order, zero-filled (4-row label frame)."""
    spark = result.sparkSession
    labels = spark.createDataFrame(
        [(i, s) for i, s in enumerate([V3_MATCHED, V3_MISMATCHED, V3_ONLY_A, V3_ONLY_B])],
        "pos int, Status string")
    counts = result.groupBy("Status").agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(labels).join(counts, "Status", "left")
            .select("pos", "Status", F.coalesce("n", F.lit(0)).cast("bigint").alias("count")))


def totals_v3(a: DataFrame, b: DataFrame, a_cols: tuple, b_cols: tuple) -> DataFrame:
    """AGG-2/AGG-3 without building the m x n pairs: one row.

    Per (key, quantity) the rows of both sides are counted; a key with nA and nB
    rows has nA * nB pairs, of which those with equal quantities match, and its
    pairs' quantity differences sum to nA * sum(B) - nB * sum(A). Most (key, quantity) occur
    once, so the rows are dealt to as many tasks as their number asks for; what a task holds is bounded.
    """
    keys = ["vendor_id", "sku"]
    rows = (_v3_side(a, a_cols, "A", "q").withColumn("_a", F.lit(1).cast("bigint")).withColumn("_b", F.lit(0).cast("bigint"))
            .unionByName(_v3_side(b, b_cols, "B", "q").withColumn("_a", F.lit(0).cast("bigint"))
                         .withColumn("_b", F.lit(1).cast("bigint"))))
    tasks = row_tasks(rows)
    each = spread(rows, tasks, *keys, "q").groupBy(*keys, "q").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    big = "decimal(38,0)"
    per = spread(each, tasks, *keys).groupBy(*keys).agg(
        F.sum("_a").alias("na"), F.sum("_b").alias("nb"), F.sum(F.col("_a") * F.col("_b")).alias("same"),
        F.sum(F.col("_a").cast(big) * F.col("q")).alias("qa"), F.sum(F.col("_b").cast(big) * F.col("q")).alias("qb"))
    both = F.col("na") * F.col("nb")
    per = per.select("sku", "na", "nb", "same", (both - F.col("same")).alias("other"),
                     F.when(both > 0, F.col("qb") * F.col("na") - F.col("qa") * F.col("nb")).alias("variance"))
    # skus are counted once per vendor above, so their distinct count needs one more reduction
    skus = per.groupBy("sku").agg(
        F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("same").alias("same"), F.sum("other").alias("other"),
        F.sum("variance").alias("variance"),
        F.sum(F.when(F.col("nb") == 0, F.col("na")).otherwise(0)).alias("only_a"),
        F.sum(F.when(F.col("na") == 0, F.col("nb")).otherwise(0)).alias("only_b"))
    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    known = F.col("sku") != "nan"  # a null sku is no sku
    return skus.agg(
        total("na").alias("rows_a"), total("nb").alias("rows_b"),
        F.count_if(known & (F.col("na") > 0)).alias("unique_skus_a"),
        F.count_if(known & (F.col("nb") > 0)).alias("unique_skus_b"),
        total("same").alias("matched"), total("other").alias("mismatched"),
        total("only_a").alias("only_a"), total("only_b").alias("only_b"), total("variance").alias("qty_variance"))


def stats_from_totals_v3(totals: DataFrame) -> DataFrame:
    """AGG-3 figures of ``totals_v3``."""
    common = F.col("matched") + F.col("mismatched")
    rate = F.when(common > 0, F.col("matched") * 100.0 / common).otherwise(F.lit(0.0))
    return totals.withColumn("match_rate", F.round(rate, 2))


def counts_from_totals_v3(totals: DataFrame) -> DataFrame:
    """AGG-2 rows of ``totals_v3`` in the fixed label order."""
    parts = [(V3_MATCHED, "matched"), (V3_MISMATCHED, "mismatched"), (V3_ONLY_A, "only_a"), (V3_ONLY_B, "only_b")]
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(label).alias("Status"), F.col(c).alias("count"))
                     for i, (label, c) in enumerate(parts)])
    return totals.select(F.explode(rows).alias("r")).select("r.*")


def stats_v3(a: DataFrame, b: DataFrame, a_sku: str, b_sku: str, result: DataFrame) -> DataFrame:
    """AGG-3 in one pass over the union of both inputs and the result."""
    s = F.lit(None).cast("string")
    u = (a.select(F.lit("A").alias("_src"), F.col(a_sku).cast("string").alias("_sku"),
                  s.alias("_st"), F.lit(None).cast("bigint").alias("_var"))
         .unionByName(b.select(F.lit("B").alias("_src"), F.col(b_sku).cast("string").alias("_sku"),
                               s.alias("_st"), F.lit(None).cast("bigint").alias("_var")))
         .unionByName(result.select(F.lit("R").alias("_src"), s.alias("_sku"), F.col("Status").alias("_st"),
                                    (F.col("qty_B") - F.col("qty_A")).alias("_var"))))
    src, st = F.col("_src"), F.col("_st")
    agg = u.agg(
        F.count_if(src == "A").alias("rows_a"),
        F.count_if(src == "B").alias("rows_b"),
        F.count_distinct(F.when(src == "A", F.col("_sku"))).alias("unique_skus_a"),
        F.count_distinct(F.when(src == "B", F.col("_sku"))).alias("unique_skus_b"),
        F.count_if(st == V3_MATCHED).alias("matched"),
        F.count_if(st == V3_MISMATCHED).alias("mismatched"),
        F.count_if(st == V3_ONLY_A).alias("only_a"),
        F.count_if(st == V3_ONLY_B).alias("only_b"),
        F.coalesce(F.sum(F.when(st == V3_MISMATCHED, F.col("_var"))), F.lit(0)).cast("bigint")
         .alias("qty_variance"),
    )
    common = F.col("matched") + F.col("mismatched")
    rate = F.when(common > 0, F.col("matched") * 100.0 / common).otherwise(F.lit(0.0))
    return agg.withColumn("match_rate", F.round(rate, 2))


# --------------------------------------------------------------------------------------
# V4 basic compare (JN-2, FLT-2, AGG-4)
# --------------------------------------------------------------------------------------

def compare_v4(a: DataFrame, b: DataFrame, a_cols: tuple, b_cols: tuple) -> DataFrame:
    """Inner join on raw (sku, account_number), null matches null, m x n; rows
    with non-numeric quantity dropped first."""
    def prep(df, cols, qname):
        sc, ac, qc = cols
        return (df.select(F.col(sc).cast("string").alias("sku"),
                          F.col(ac).cast("string").alias("account_number"),
                          parse_number(F.col(qc)).alias(qname))
                .where(F.col(qname).isNotNull() & ~F.isnan(qname)))
    x = prep(a, a_cols, "quantity_warehouse").alias("x")
    y = prep(b, b_cols, "quantity_ecommerce").alias("y")
    cond = (F.col("x.sku").eqNullSafe(F.col("y.sku"))
            & F.col("x.account_number").eqNullSafe(F.col("y.account_number")))
    j = x.join(y, cond, "inner").select(
        F.col("x.sku").alias("sku"), F.col("x.account_number").alias("account_number"),
        "quantity_warehouse", "quantity_ecommerce")
    d = F.col("quantity_warehouse") - F.col("quantity_ecommerce")
    return j.withColumn("quantity_difference", d).withColumn(
        "status", F.when(d == 0, MATCH).otherwise(MISMATCH))


def totals_v4(a: DataFrame, b: DataFrame, a_cols: tuple, b_cols: tuple) -> DataFrame:
    """AGG-4 from rows grouped by (sku, account, quantity): only different quantities of
    a key meet, each pair weighted by how often it occurs."""
    def prep(df, cols, qname, n):
        sc, ac, qc = cols
        return (df.select(F.col(sc).cast("string").alias("sku"), F.col(ac).cast("string").alias("acct"),
                          parse_number(F.col(qc)).alias(qname))
                .where(F.col(qname).isNotNull() & ~F.isnan(qname))
                .groupBy("sku", "acct", qname).agg(F.count(F.lit(1)).alias(n)))
    x, y = prep(a, a_cols, "qw", "nw").alias("x"), prep(b, b_cols, "qe", "ne").alias("y")
    j = x.join(y, F.col("x.sku").eqNullSafe(F.col("y.sku")) & F.col("x.acct").eqNullSafe(F.col("y.acct")))
    qw, qe, n = F.col("qw"), F.col("qe"), F.col("nw") * F.col("ne")

    def pairs(cond):
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint")

    def weighted(v):
        return F.coalesce(F.sum(v * n), F.lit(0.0))
    return j.agg(
        pairs(F.lit(True)).alias("total_matched"), pairs(qw == qe).alias("match_count"), pairs(qw != qe).alias("mismatch_count"),
        pairs((qw > 0) & (qe == 0)).alias("wh_in_ecom_out"), pairs((qe > 0) & (qw == 0)).alias("ecom_in_wh_out"),
        pairs((qw > 0) & (qe > 0)).alias("in_stock_both"), weighted(qw).alias("total_qty_a"), weighted(qe).alias("total_qty_b"),
        weighted(F.abs(qw - qe)).alias("total_discrepancy"))


def kpis_v4(result: DataFrame) -> DataFrame:
    """AGG-4: one aggregate pass."""
    qw, qe = F.col("quantity_warehouse"), F.col("quantity_ecommerce")
    return result.agg(
        F.count(F.lit(1)).alias("total_matched"),
        F.count_if(F.col("status") == MATCH).alias("match_count"),
        F.count_if(F.col("status") == MISMATCH).alias("mismatch_count"),
        F.count_if((qw > 0) & (qe == 0)).alias("wh_in_ecom_out"),
        F.count_if((qe > 0) & (qw == 0)).alias("ecom_in_wh_out"),
        F.count_if((qw > 0) & (qe > 0)).alias("in_stock_both"),
        F.coalesce(F.sum(qw), F.lit(0.0)).alias("total_qty_a"),
        F.coalesce(F.sum(qe), F.lit(0.0)).alias("total_qty_b"),
        F.coalesce(F.sum(F.abs(F.col("quantity_difference"))), F.lit(0.0)).alias("total_discrepancy"),
    )


# --------------------------------------------------------------------------------------
# V5 dashboard compare (STR-9, NUM-2, NUM-6, AGG-1, JN-5, CND-7, AGG-5..7, FLT-7)
# --------------------------------------------------------------------------------------

def normalize_v5(df: DataFrame, sku: str, account: str, qty: str, upper_keys: bool = True,
                 strip_keys: bool = True, clamp: bool = False, order_col: str = "_ord") -> DataFrame:
    """(sku_raw, account_raw, qty, sku_key, account_key, _ord); null keys become "nan"."""
    q = parse_number(F.col(qty))
    if clamp:
        q = F.when(q < 0, F.lit(0.0)).otherwise(q)
    return df.select(
        F.col(sku).cast("string").alias("sku_raw"), F.col(account).cast("string").alias("account_raw"),
        q.alias("qty"),
        upper_strip(F.col(sku), upper_keys, strip_keys).alias("sku_key"),
        upper_strip(F.col(account), upper_keys, strip_keys).alias("account_key"),
        F.col(order_col).alias("_ord"))


def _dupes_agg(how: str, q: Column, o: Column, rows: Column) -> Column:
    """AGG-1's quantity of a key's ``rows``: the aggregate ``how`` of ``q`` in the order ``o``; no rows, no quantity."""
    how = how if how in ("sum", "max", "min", "first", "last") else "sum"
    q = F.when(rows, q)
    nn = F.when(q.isNotNull(), o)
    return {
        "sum": F.coalesce(F.sum(q), F.max(F.when(rows, F.lit(0.0)))),
        "max": F.max(q),
        "min": F.min(q),
        "first": F.min_by(q, nn),
        "last": F.max_by(q, nn),
    }[how]


def aggregate_dupes(df: DataFrame, how: str = "sum", keys: Sequence[str] = ("sku_key", "account_key"),
                    qty: str = "qty", order_col: str = "_ord") -> DataFrame:
    """AGG-1: one row per key. sum of all-null = 0; max/min null; first/last skip
    nulls (by file order); raw sku/account = first non-null. Partial aggregates only."""
    o = F.col(order_col)
    return df.groupBy(*keys).agg(
        _dupes_agg(how, F.col(qty), o, F.lit(True)).alias(qty),
        F.min_by(F.col("sku_raw"), F.when(F.col("sku_raw").isNotNull(), o)).alias("sku_raw"),
        F.min_by(F.col("account_raw"), F.when(F.col("account_raw").isNotNull(), o)).alias("account_raw"))


def compare_v5(a: DataFrame, b: DataFrame, how: str = "sum") -> DataFrame:
    """The dashboard's 11 result columns, in display order, one row per key. Presence = quantity not null.

    Keys are never null, so the full outer join of the two sides' ``aggregate_dupes`` is one aggregate
    of both sides' rows: a task holds a key once, where the join sorted both aggregated sides.
    """
    rows = a.select("sku_key", "account_key", "qty", "_ord", F.lit(True).alias("_wh")).unionByName(
        b.select("sku_key", "account_key", "qty", "_ord", F.lit(False).alias("_wh")))
    j = rows.groupBy("sku_key", "account_key").agg(
        _dupes_agg(how, F.col("qty"), F.col("_ord"), F.col("_wh")).alias("qty_wh"),
        _dupes_agg(how, F.col("qty"), F.col("_ord"), ~F.col("_wh")).alias("qty_ecom"))
    pw, pe = F.col("qty_wh").isNotNull(), F.col("qty_ecom").isNotNull()
    qw = F.coalesce(F.col("qty_wh"), F.lit(0.0))
    qe = F.coalesce(F.col("qty_ecom"), F.lit(0.0))
    d = qw - qe
    cov = (F.when(pw & pe, COV_BOTH).when(pw & ~pe, COV_WH).when(~pw & pe, COV_EC).otherwise(COV_NONE))
    return j.select("sku_key", "account_key", qw.alias("qty_wh"), qe.alias("qty_ecom"),
                    d.alias("qty_diff"), F.when(d == 0, MATCH).otherwise(MISMATCH).alias("status"),
                    cov.alias("source_status"), (qw > 0).alias("in_stock_wh"), (qe > 0).alias("in_stock_ecom"),
                    pw.alias("present_wh"), pe.alias("present_ecom"))


def rollup_by_account(merged: DataFrame) -> DataFrame:
    """AGG-7 (JN-12's self-merge folded into the same aggregate). ``merged`` holds a (sku, account) once,
    as ``compare_v5`` makes it, so an account's skus are counted without a distinct."""
    st, ss = F.col("status"), F.col("source_status")
    iw, ie = F.col("in_stock_wh"), F.col("in_stock_ecom")
    return merged.groupBy("account_key").agg(
        F.count("sku_key").alias("total_items"),
        F.count_if(st == MATCH).alias("matched"),
        F.count_if(st == MISMATCH).alias("mismatched"),
        F.count_if(ss == COV_WH).alias("wh_only"),
        F.count_if(ss == COV_EC).alias("ecom_only"),
        F.sum("qty_wh").alias("qty_wh_total"),
        F.sum("qty_ecom").alias("qty_ecom_total"),
        F.sum(F.abs(F.col("qty_diff"))).alias("abs_diff_total"),
        F.count_if(iw & ~ie).alias("instock_wh_oos_ecom"),
        F.count_if(ie & ~iw).alias("instock_ecom_oos_wh"),
    )


def kpis_v5(merged: DataFrame) -> DataFrame:
    """AGG-5: the 11 dashboard scalars in one pass."""
    st, ss = F.col("status"), F.col("source_status")
    iw, ie = F.col("in_stock_wh"), F.col("in_stock_ecom")
    return merged.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(st == MATCH).alias("match_count"),
        F.count_if(st == MISMATCH).alias("mismatch_count"),
        F.count_if(ss == COV_WH).alias("wh_only_count"),
        F.count_if(ss == COV_EC).alias("ecom_only_count"),
        F.count_if(ss == COV_BOTH).alias("both_sources_count"),
        F.count_if(iw & ~ie).alias("wh_stock_ecom_oos"),
        F.count_if(ie & ~iw).alias("ecom_stock_wh_oos"),
        F.coalesce(F.sum("qty_wh"), F.lit(0.0)).alias("total_qty_a"),
        F.coalesce(F.sum("qty_ecom"), F.lit(0.0)).alias("total_qty_b"),
        F.coalesce(F.sum(F.abs(F.col("qty_diff"))), F.lit(0.0)).alias("total_abs_diff"),
    )


def distribution(merged: DataFrame, col: str) -> DataFrame:
    """AGG-6: counts per label and their share of the total (pie data).
    The share window runs over the aggregated labels only."""
    from pyspark.sql import Window
    g = merged.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    tot = F.sum("count").over(Window.partitionBy())
    return g.select("label", "count", F.round(F.col("count") * 100.0 / tot, 4).alias("share_pct"))


def view_filter_v5(merged: DataFrame, statuses: Optional[Sequence[str]] = None,
                   presences: Optional[Sequence[str]] = None, only_nonzero: bool = False) -> DataFrame:
    """FLT-7: multi-select status x presence, optional 'any qty > 0'."""
    d = merged
    if statuses is not None:
        d = d.where(F.col("status").isin(list(statuses)))
    if presences is not None:
        d = d.where(F.col("source_status").isin(list(presences)))
    if only_nonzero:
        d = d.where((F.col("qty_wh") > 0) | (F.col("qty_ecom") > 0))
    return d


def subset(merged: DataFrame, name: str) -> DataFrame:
    """FLT-7 stock-asymmetry subsets used by the named exports."""
    preds = {
        "full": None,
        "mismatches": F.col("status") == MISMATCH,
        "wh_instock_ecom_oos": F.col("in_stock_wh") & ~F.col("in_stock_ecom"),
        "ecom_instock_wh_oos": F.col("in_stock_ecom") & ~F.col("in_stock_wh"),
    }
    p = preds[name]
    return merged if p is None else merged.where(p)


# --------------------------------------------------------------------------------------
# V6 change feed (STR-3, NUM-3, WIN-1, SET-2, JN-6, FLT-12)
# --------------------------------------------------------------------------------------

def change_side(df: DataFrame, key_cols: Sequence[str], qty_col: str, norm: Normalization,
                sku_col: Optional[str] = None, order_col: str = "_ord") -> DataFrame:
    """(key, qty[, sku]) - blank cells are "", blank keys kept, last row wins."""
    keyed = with_composite_key(df, key_cols, norm, VDOTS, ignore_missing=False)
    cols = [F.col("key"), F.coalesce(F.col(qty_col).cast("string"), F.lit("")).alias("_q")]
    if sku_col:
        cols.append(strip_ws(F.coalesce(F.col(sku_col).cast("string"), F.lit(""))).alias("sku"))
    cols.append(F.col(order_col))
    d = keep_last(keyed.select(*cols), ["key"], order_col)
    out = [F.col("key"), to_int_safe(F.col("_q")).alias("qty")]
    if sku_col:
        out.append(F.col("sku"))
    return d.select(*out)


def change_feed(ec: DataFrame, wh: DataFrame, ec_keys: Sequence[str], ec_qty: str, ec_sku: str,
                wh_keys: Sequence[str], wh_qty: str, ec_norm: Normalization = Normalization(),
                wh_norm: Normalization = Normalization(), order_col: str = "_ord") -> DataFrame:
    """(sku, ec_qty, wh_qty, key) for keys whose quantities differ; missing side = 0;
    blank EC sku falls back to the key. The new quantity is the EC one."""
    return compare_sides(change_side(ec, ec_keys, ec_qty, ec_norm, ec_sku, order_col),
                         change_side(wh, wh_keys, wh_qty, wh_norm, None, order_col))


def compare_sides(ec: DataFrame, wh: DataFrame) -> DataFrame:
    """``change_feed`` of sides that ``change_side`` made: (key, qty, sku) and (key, qty)."""
    e, w = ec.alias("e"), wh.alias("w")
    j = e.join(w, F.col("e.key") == F.col("w.key"), "full")
    key = F.coalesce(F.col("e.key"), F.col("w.key"))
    eq = F.coalesce(F.col("e.qty"), F.lit(0).cast("bigint"))
    wq = F.coalesce(F.col("w.qty"), F.lit(0).cast("bigint"))
    sku = F.coalesce(F.nullif(F.col("e.sku"), F.lit("")), key)
    return j.where(eq != wq).select(sku.alias("sku"), eq.alias("ec_qty"), wq.alias("wh_qty"), key.alias("key"))
