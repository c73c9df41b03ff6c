"""Order-book reads (JN-7..11, JN-17, AGG-9..12, CND-8, FLT-8..11, PRJ-6/7, SRT-4/5).

Money is summed as decimal(18,2)/(18,4) so totals do not depend on the
order in which partial sums meet, then returned as double.
Joins carry no broadcast hints: dimensions here grow with the data, so
Spark/AQE broadcasts only what it measures below the threshold.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark.config import PACK_SIZES, FreightPolicy

MONEY = "decimal(18,2)"
RATE = "decimal(18,4)"


def money(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def products_view(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """JN-7: products LEFT JOIN suppliers, supplier name '' when missing."""
    p = products.alias("p")
    s = suppliers.select(F.col("id").alias("_sid"), F.col("name").alias("_sname"))
    j = p.join(s, F.col("p.supplier_id") == F.col("_sid"), "left")
    return j.select("p.id", "p.sku", "p.name", "p.quantity", "p.price",
                    F.coalesce(F.col("_sname"), F.lit("")).alias("supplier_name"), "p.pack_size",
                    F.col("_sname").alias("_supplier_raw"))


def search_products(view: DataFrame, term: Optional[str]) -> DataFrame:
    """FLT-8: LIKE %term% on sku, name or supplier name, case-insensitive;
    '%'/'_' inside the term stay wildcards, as in the SQL tool."""
    d = view
    if term:
        pat = f"%{term}%"
        d = d.where(F.col("sku").ilike(pat) | F.col("name").ilike(pat) | F.col("_supplier_raw").ilike(pat))
    return d.drop("_supplier_raw")


def book_kpis(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """AGG-11: products, low stock (1..3), out of stock, suppliers - one pass over a union."""
    u = (products.select(F.lit(0).alias("_t"), F.col("quantity").cast("bigint").alias("_q"))
         .unionByName(suppliers.select(F.lit(1).alias("_t"), F.lit(None).cast("bigint").alias("_q"))))
    t, q = F.col("_t"), F.col("_q")
    return u.agg(F.count_if(t == 0).alias("products"),
                 F.count_if((t == 0) & (q > 0) & (q <= 3)).alias("low_stock"),
                 F.count_if((t == 0) & (q == 0)).alias("out_of_stock"),
                 F.count_if(t == 1).alias("suppliers"))


def _item_sums(items: DataFrame, keys) -> DataFrame:
    line = F.col("quantity").cast("decimal(18,0)") * money("price_at_order")
    return items.groupBy(*keys).agg(F.sum(line).alias("_total"), F.count(F.lit(1)).alias("_lines"))


def order_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """JN-8 + AGG-9: every order with its total (0 when it has no items).
    Items are reduced per order before the join (partial aggregate)."""
    s = _item_sums(items, ["order_id"])
    j = orders.join(s, orders["id"] == s["order_id"], "left")
    return j.select(orders["id"], "customer_name", "order_date", "status",
                    F.coalesce(F.col("_total"), F.lit(0).cast(MONEY)).cast("double").alias("total"))


def supplier_order_totals(orders: DataFrame, items: DataFrame, products: DataFrame,
                          supplier_id: Optional[int] = None) -> DataFrame:
    """JN-9 + AGG-10: per (supplier, order), totals over that supplier's lines only.
    ``supplier_id`` narrows to one supplier (pushed below the joins)."""
    p = products.select(F.col("id").alias("_pid"), "supplier_id")
    if supplier_id is not None:
        p = p.where(F.col("supplier_id") == supplier_id)
    li = items.join(p, items["product_id"] == F.col("_pid"))
    s = _item_sums(li, ["supplier_id", "order_id"])
    j = s.join(orders, s["order_id"] == orders["id"])
    return j.select("supplier_id", orders["id"], "customer_name", "order_date", "status",
                    F.col("_total").cast("double").alias("total"))


def order_items_detail(items: DataFrame, products: DataFrame) -> DataFrame:
    """JN-10: items with product sku, name and pack size."""
    p = products.select(F.col("id").alias("p_id"), "sku", "name", "pack_size")
    j = items.join(p, items["product_id"] == F.col("p_id"))
    return j.select("order_id", "sku", "name", "quantity", "price_at_order", "p_id", "product_id", "pack_size")


def unit_freight(price: Column, pack: Column, policy: FreightPolicy = FreightPolicy()) -> Column:
    """CND-8: positive rate of the pack size, else max(0, price x pct / 100).
    The rate table is a literal CASE (no join)."""
    rate = None
    for name, r in policy.rates:
        if name not in PACK_SIZES:
            continue
        lit = F.lit(r).cast(RATE)
        rate = F.when(pack == name, lit) if rate is None else rate.when(pack == name, lit)
    rate = rate.otherwise(F.lit(None).cast(RATE)) if rate is not None else F.lit(None).cast(RATE)
    pct = F.lit(policy.default_percent_of_price / 100.0).cast(RATE)
    by_price = F.greatest(F.lit(0).cast(RATE), (price.cast(MONEY) * pct))
    return F.when(rate > 0, rate).otherwise(by_price)


def invoice_lines(items: DataFrame, products: DataFrame, policy: FreightPolicy = FreightPolicy()) -> DataFrame:
    """AGG-12 lines: goods and shipping per line."""
    d = order_items_detail(items, products)
    unit_ship = unit_freight(F.col("price_at_order"), F.col("pack_size"), policy)
    qty = F.col("quantity").cast("decimal(18,0)")
    return d.select("order_id", "sku", "name", F.coalesce("pack_size", F.lit("")).alias("pack_size"),
                    F.col("quantity").alias("qty"), money("price_at_order").cast("double").alias("unit_price"),
                    unit_ship.cast("double").alias("unit_shipping"),
                    (qty * money("price_at_order")).cast("double").alias("line_total"),
                    (qty * unit_ship).cast("double").alias("shipping_line_total"),
                    (qty * money("price_at_order")).alias("_line_dec"), (qty * unit_ship).alias("_ship_dec"))


def invoice_summary(orders: DataFrame, items: DataFrame, products: DataFrame,
                    policy: FreightPolicy = FreightPolicy()) -> DataFrame:
    """AGG-12: per order goods subtotal, shipping subtotal and grand total."""
    lines = invoice_lines(items, products, policy)
    s = lines.groupBy("order_id").agg(F.sum("_line_dec").alias("_g"), F.sum("_ship_dec").alias("_s"),
                                      F.count(F.lit(1)).alias("n_lines"))
    j = orders.join(s, orders["id"] == s["order_id"], "left")
    g = F.coalesce(F.col("_g"), F.lit(0).cast(MONEY))
    sh = F.coalesce(F.col("_s"), F.lit(0).cast(RATE))
    return j.select(orders["id"].alias("order_id"), "customer_name", "order_date", "status",
                    F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
                    g.cast("double").alias("subtotal_goods"), sh.cast("double").alias("subtotal_shipping"),
                    (g + sh).cast("double").alias("grand_total"))


def nest_orders(orders: DataFrame, items: DataFrame, item_cols, address_cols=None,
                order_key: str = "id") -> DataFrame:
    """PRJ-7/JN-11: one document per order: order fields, optional address struct
    (null when all its fields are blank) and a sorted items array. Items are
    grouped per order once (no per-order lookups); orders without items get []."""
    it = items.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in item_cols]))).alias("items"))
    cols = [F.col(c) for c in orders.columns]
    if address_cols:
        blank = F.lit(True)
        for c in address_cols:
            blank = blank & (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "")
        addr = F.when(blank, F.lit(None)).otherwise(F.struct(*[F.col(c) for c in address_cols]))
        cols = [F.col(c) for c in orders.columns if c not in address_cols] + [addr.alias("shipping_address")]
    j = orders.join(it, orders[order_key] == it["order_id"], "left")
    return j.select(*cols, F.coalesce(F.col("items"), F.array().cast(it.schema["items"].dataType)).alias("items"))


def flatten_orders(nested: DataFrame, order_key: str = "id") -> DataFrame:
    """PRJ-6: nested documents back to one row per item with its 1-based position."""
    x = nested.select(F.col(order_key).alias("order_id"), F.posexplode("items").alias("_pos", "_it"))
    return x.select("order_id", (F.col("_pos") + 1).cast("int").alias("item_pos"), "_it.*")
