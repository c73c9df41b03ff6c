"""Order-book read queries over products/suppliers/orders/items built from part, supplier, orders, lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockspark.operators import book as B
from stockspark.operators.ordering import page
from stockspark.plans import fixtures as X
from stockspark.plans.catalog import query

P_SQL = """products AS (
  SELECT p_partkey AS id, 'SKU-' || CAST(p_partkey AS VARCHAR) AS sku, p_name AS name,
         CAST(p_size % 12 AS BIGINT) AS quantity, p_retailprice AS price, p_partkey % 100 AS supplier_id,
         CASE p_type WHEN 'SMALL' THEN 'small' WHEN 'MEDIUM' THEN 'medium' WHEN 'LARGE' THEN 'large'
                     WHEN 'PROMO' THEN 'bulky' WHEN 'STANDARD' THEN 'extra_bulky' END AS pack_size
  FROM part),
suppliers AS (SELECT s_suppkey AS id, s_name AS name FROM supplier),
orders_b AS (
  SELECT o_orderkey AS id, 'Customer ' || CAST(o_custkey AS VARCHAR) AS customer_name, o_orderdate AS order_date,
         CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'P' THEN 'Cancelled' ELSE 'Pending' END AS status
  FROM orders),
items AS (SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id,
                 CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice AS price_at_order FROM lineitem)"""

LINE = "CAST(i.quantity AS DECIMAL(18,0)) * CAST(i.price_at_order AS DECIMAL(18,2))"
SHIP = ("CASE WHEN p.pack_size = 'small' THEN CAST(5.0 AS DECIMAL(18,4)) "
        "WHEN p.pack_size = 'medium' THEN CAST(10.0 AS DECIMAL(18,4)) "
        "WHEN p.pack_size = 'large' THEN CAST(20.0 AS DECIMAL(18,4)) "
        "WHEN p.pack_size = 'bulky' THEN CAST(35.0 AS DECIMAL(18,4)) "
        "WHEN p.pack_size = 'extra_bulky' THEN CAST(60.0 AS DECIMAL(18,4)) "
        "ELSE greatest(CAST(0 AS DECIMAL(18,4)), CAST(i.price_at_order AS DECIMAL(18,2)) * CAST(0.1 AS DECIMAL(18,4))) END")


def _t(spark, sf_dir):
    t = X.Tables(spark, sf_dir)
    return X.book_products(t), X.book_suppliers(t), X.book_orders(t), X.book_items(t)


@query("book_kpis", f"""WITH {P_SQL}
SELECT (SELECT count(*) FROM products) AS products,
       (SELECT count(*) FROM products WHERE quantity > 0 AND quantity <= 3) AS low_stock,
       (SELECT count(*) FROM products WHERE quantity = 0) AS out_of_stock,
       (SELECT count(*) FROM suppliers) AS suppliers""")
def book_kpis(spark, sf_dir):
    """AGG-11."""
    p, s, _, _ = _t(spark, sf_dir)
    return B.book_kpis(p, s)


@query("products_list", f"""WITH {P_SQL}
SELECT p.id, p.sku, p.name, p.quantity, p.price, COALESCE(s.name, '') AS supplier_name, p.pack_size
FROM products p LEFT JOIN suppliers s ON s.id = p.supplier_id""")
def products_list(spark, sf_dir):
    """JN-7: products with supplier name ('' when the supplier is missing)."""
    p, s, _, _ = _t(spark, sf_dir)
    return B.search_products(B.products_view(p, s), None)


@query("products_search", f"""WITH {P_SQL}
SELECT p.id, p.sku, p.name, p.quantity, p.price, COALESCE(s.name, '') AS supplier_name, p.pack_size
FROM products p LEFT JOIN suppliers s ON s.id = p.supplier_id
WHERE p.sku ILIKE '%2_1%' OR p.name ILIKE '%2_1%' OR s.name ILIKE '%2_1%'
   OR p.sku ILIKE '%RING%' OR p.name ILIKE '%RING%' OR s.name ILIKE '%RING%'""")
def products_search(spark, sf_dir):
    """FLT-8: LIKE search ('_' is a wildcard) on sku, name and supplier name, case-insensitive."""
    p, s, _, _ = _t(spark, sf_dir)
    v = B.products_view(p, s)
    return B.search_products(v, "2_1").unionByName(B.search_products(v, "RING")).distinct()


@query("order_totals", f"""WITH {P_SQL}
SELECT o.id, o.customer_name, o.order_date, o.status,
       CAST(COALESCE(sum({LINE}), 0) AS DOUBLE) AS total
FROM orders_b o LEFT JOIN items i ON i.order_id = o.id
GROUP BY o.id, o.customer_name, o.order_date, o.status""")
def order_totals(spark, sf_dir):
    """JN-8 + AGG-9: order totals, 0 for orders without items."""
    _, _, o, i = _t(spark, sf_dir)
    return B.order_totals(o, i)


@query("orders_page", f"""WITH {P_SQL},
t AS (SELECT o.id, o.customer_name, o.order_date, o.status,
             CAST(COALESCE(sum({LINE}), 0) AS DOUBLE) AS total
      FROM orders_b o LEFT JOIN items i ON i.order_id = o.id
      GROUP BY o.id, o.customer_name, o.order_date, o.status)
SELECT * FROM t ORDER BY order_date DESC, id DESC LIMIT 200 OFFSET 400""")
def orders_page(spark, sf_dir):
    """SRT-4/SRT-5: newest first with id tie-break, page 3 of 200 (limit is the feature)."""
    _, _, o, i = _t(spark, sf_dir)
    return page(B.order_totals(o, i), [F.col("order_date").desc(), F.col("id").desc()], offset=400, limit=200)


@query("supplier_order_totals", f"""WITH {P_SQL}
SELECT p.supplier_id, o.id, o.customer_name, o.order_date, o.status, CAST(sum({LINE}) AS DOUBLE) AS total
FROM orders_b o JOIN items i ON i.order_id = o.id JOIN products p ON p.id = i.product_id
GROUP BY p.supplier_id, o.id, o.customer_name, o.order_date, o.status""")
def supplier_order_totals(spark, sf_dir):
    """JN-9 + AGG-10 for every supplier at once: totals over that supplier's lines only."""
    p, _, o, i = _t(spark, sf_dir)
    return B.supplier_order_totals(o, i, p)


@query("order_items_detail", f"""WITH {P_SQL}
SELECT i.order_id, p.sku, p.name, i.quantity, i.price_at_order, p.id AS p_id, i.product_id, p.pack_size
FROM items i JOIN products p ON p.id = i.product_id""")
def order_items_detail(spark, sf_dir):
    """JN-10: item lines with product details."""
    p, _, _, i = _t(spark, sf_dir)
    return B.order_items_detail(i, p)


@query("invoice_lines", f"""WITH {P_SQL}
SELECT i.order_id, p.sku, p.name, COALESCE(p.pack_size, '') AS pack_size, i.quantity AS qty,
       CAST(CAST(i.price_at_order AS DECIMAL(18,2)) AS DOUBLE) AS unit_price,
       CAST({SHIP} AS DOUBLE) AS unit_shipping, CAST({LINE} AS DOUBLE) AS line_total,
       CAST(CAST(i.quantity AS DECIMAL(18,0)) * ({SHIP}) AS DOUBLE) AS shipping_line_total
FROM items i JOIN products p ON p.id = i.product_id""")
def invoice_lines(spark, sf_dir):
    """AGG-12/CND-8 lines: unit freight by pack size or 10 % of price."""
    p, _, _, i = _t(spark, sf_dir)
    return B.invoice_lines(i, p).drop("_line_dec", "_ship_dec")


@query("invoice_summary", f"""WITH {P_SQL},
l AS (SELECT i.order_id, {LINE} AS g, CAST(i.quantity AS DECIMAL(18,0)) * ({SHIP}) AS s
      FROM items i JOIN products p ON p.id = i.product_id),
a AS (SELECT order_id, sum(g) AS g, sum(s) AS s, count(*) AS n FROM l GROUP BY order_id)
SELECT o.id AS order_id, o.customer_name, o.order_date, o.status, CAST(COALESCE(a.n, 0) AS BIGINT) AS n_lines,
       CAST(COALESCE(a.g, 0) AS DOUBLE) AS subtotal_goods, CAST(COALESCE(a.s, 0) AS DOUBLE) AS subtotal_shipping,
       CAST(COALESCE(a.g, 0) + COALESCE(a.s, 0) AS DOUBLE) AS grand_total
FROM orders_b o LEFT JOIN a ON a.order_id = o.id""")
def invoice_summary(spark, sf_dir):
    """AGG-12: goods, shipping and grand totals for every order."""
    p, _, o, i = _t(spark, sf_dir)
    return B.invoice_summary(o, i, p)


@query("nested_orders", f"""WITH {P_SQL}
SELECT o.id, o.customer_name, o.order_date, o.status, CAST(count(i.order_id) AS INTEGER) AS n_items,
       CAST(COALESCE(sum(i.quantity), 0) AS BIGINT) AS total_qty, min(i.product_id) AS first_product
FROM orders_b o LEFT JOIN items i ON i.order_id = o.id
GROUP BY o.id, o.customer_name, o.order_date, o.status""")
def nested_orders(spark, sf_dir):
    """PRJ-7/JN-11: one document per order with a sorted items array; reported as
    item count, quantity total and first product read back from the array."""
    _, _, o, i = _t(spark, sf_dir)
    n = B.nest_orders(o, i, ["product_id", "line_no", "quantity", "price_at_order"])
    return n.select("id", "customer_name", "order_date", "status", F.size("items").alias("n_items"),
                    F.aggregate("items", F.lit(0).cast("bigint"),
                                lambda acc, x: acc + x["quantity"].cast("bigint")).alias("total_qty"),
                    F.try_element_at("items", F.lit(1))["product_id"].alias("first_product"))


@query("flattened_order_items", """
SELECT l_orderkey AS order_id, CAST(row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_partkey, l_linenumber, CAST(l_quantity AS INTEGER), l_extendedprice) AS INTEGER) AS item_pos,
       l_partkey AS product_id, l_linenumber AS line_no, CAST(l_quantity AS INTEGER) AS quantity
FROM lineitem""")
def flattened_order_items(spark, sf_dir):
    """PRJ-6: nested documents flattened back to one row per item with its position."""
    _, _, o, i = _t(spark, sf_dir)
    n = B.nest_orders(o, i, ["product_id", "line_no", "quantity", "price_at_order"])
    return B.flatten_orders(n).select("order_id", "item_pos", "product_id", "line_no", "quantity")


# ------------------------------------------------------------------ documents, filters, top-k

RUN_TS = "2026-01-01 00:00:00"


def _documents(spark, sf_dir):
    """Order documents from orders x customer x lineitem: reference PO-<orderkey div 2>
    (pairs repeat inside the batch); finished orders are already in the table."""
    from stockspark.operators import documents as D
    t = X.Tables(spark, sf_dir)
    o, c, li = t.orders, t.customer, t.lineitem
    items = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("l_linenumber").alias("line_reference"), F.col("l_partkey").cast("string").alias("part_number"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.format_string("%.2f", F.col("l_extendedprice")).alias("total")))).alias("items"))
    ref = F.concat(F.lit("PO-"), F.floor(F.col("o_orderkey") / 2).cast("string"))
    addr = F.struct(F.col("c_nationkey").cast("string").alias("country"),
                    F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.lit("1 Main St")).alias("line_1"),
                    *[F.lit(None).cast("string").alias(f) for f in ("line_2", "city", "postal_code", "state", "phone")],
                    F.col("c_name").alias("full_name"), F.lit(None).cast("string").alias("email"))
    docs = (o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(items, o["o_orderkey"] == items["l_orderkey"], "left")
            .select(ref.alias("order_reference"),
                    F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.col("o_orderdate"))
                     .cast("timestamp").alias("order_date"),
                    F.lit(None).cast("string").alias("status"),
                    F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("rush")).alias("comment"),
                    F.lit(None).cast("string").alias("currency_code"), (F.col("o_orderpriority") == "2-HIGH").alias("test_flag"),
                    *[F.format_string("%.2f", F.col("o_totalprice") * k).alias(c)
                      for c, k in (("subtotal", 2.0), ("tax", 4.0), ("total", 1.0))],
                    F.lit(None).cast("string").alias("supplier"), F.col("c_mktsegment").alias("retailer"), addr.alias("shipping_address"),
                    F.struct(F.col("c_mktsegment").alias("name")).alias("retailer_data"),
                    F.coalesce(F.col("items"), F.array().cast(items.schema["items"].dataType)).alias("items"),
                    F.col("o_orderkey").alias("_ord")))
    existing = o.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("id"),
                                                             ref.alias("order_reference"))
    return D.ingest_order_documents(existing, docs, RUN_TS)


_DOC_CTE = """
ex AS (SELECT o_orderkey AS id, 'PO-' || CAST(floor(o_orderkey / 2) AS BIGINT) AS order_reference
       FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT o.*, c.*, 'PO-' || CAST(floor(o_orderkey / 2) AS BIGINT) AS order_reference,
             row_number() OVER (PARTITION BY floor(o_orderkey / 2) ORDER BY o_orderkey) AS k
      FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
acc AS (SELECT * FROM b WHERE k = 1 AND order_reference NOT IN (SELECT order_reference FROM ex)),
num AS (SELECT *, (SELECT max(id) FROM ex) + row_number() OVER (ORDER BY o_orderkey) AS id FROM acc)
"""


@query("ingest_order_documents", f"""WITH {_DOC_CTE}
SELECT id, order_reference,
       CASE WHEN o_orderpriority = '5-LOW' THEN TIMESTAMP '{RUN_TS}' ELSE CAST(o_orderdate AS TIMESTAMP) END AS order_date,
       'ORDER' AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN 'rush' ELSE '' END AS comment,
       'AUD' AS currency_code, o_orderpriority = '2-HIGH' AS test_flag, printf('%.2f', o_totalprice * 2.0) AS subtotal,
       printf('%.2f', o_totalprice * 4.0) AS tax, printf('%.2f', o_totalprice) AS total,
       CAST(NULL AS VARCHAR) AS supplier, c_mktsegment AS retailer, CAST(c_nationkey AS VARCHAR) AS ship_country,
       CASE WHEN c_acctbal < 0 THEN '' ELSE '1 Main St' END AS ship_line_1,
       CAST(NULL AS VARCHAR) AS ship_line_2, CAST(NULL AS VARCHAR) AS ship_city,
       CAST(NULL AS VARCHAR) AS ship_postal_code, CAST(NULL AS VARCHAR) AS ship_state,
       CAST(NULL AS VARCHAR) AS ship_phone, c_name AS ship_full_name, CAST(NULL AS VARCHAR) AS ship_email,
       c_mktsegment AS retailer_name
FROM num""")
def ingest_order_documents(spark, sf_dir):
    """DML-11: reject known/repeated references, fill defaults, flatten, new ids after max(id)."""
    return _documents(spark, sf_dir)[0]


@query("ingest_document_items", f"""WITH {_DOC_CTE}
SELECT num.id AS order_id,
       CAST(row_number() OVER (PARTITION BY num.id ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(l_quantity AS INTEGER),
            printf('%.2f', l_extendedprice)) AS INTEGER) AS line_no,
       l_linenumber AS line_reference, CAST(l_partkey AS VARCHAR) AS part_number,
       CAST(l_quantity AS INTEGER) AS quantity, printf('%.2f', l_extendedprice) AS total
FROM num JOIN lineitem ON l_orderkey = num.o_orderkey""")
def ingest_document_items(spark, sf_dir):
    """DML-11/PRJ-6: item rows of the ingested documents with their line numbers."""
    return _documents(spark, sf_dir)[1]


@query("ingest_document_rejects", f"""WITH {_DOC_CTE}
SELECT order_reference, CASE WHEN order_reference IN (SELECT order_reference FROM ex) THEN 'exists'
                             ELSE 'duplicate in batch' END AS reason, o_orderkey AS _ord
FROM b WHERE NOT (k = 1 AND order_reference NOT IN (SELECT order_reference FROM ex))""")
def ingest_document_rejects(spark, sf_dir):
    """JN-15: documents rejected because the reference exists or repeats in the batch."""
    return _documents(spark, sf_dir)[2].select("order_reference", "reason", "_ord")


@query("orders_pending", f"""WITH {P_SQL}
SELECT * FROM orders_b WHERE status = 'Pending'""")
def orders_pending(spark, sf_dir):
    """FLT-9: order status filter (pushed to the scan as o_orderstatus predicates)."""
    _, _, o, _ = _t(spark, sf_dir)
    return o.where(F.col("status") == "Pending")


@query("orders_page_count", f"""WITH {P_SQL}
SELECT count(*) FILTER (WHERE status = 'Cancelled') AS filtered_count, count(*) AS unfiltered_count FROM orders_b""")
def orders_page_count(spark, sf_dir):
    """AGG-13: count of the filtered set for paging, plus the unfiltered count."""
    _, _, o, _ = _t(spark, sf_dir)
    return o.agg(F.count_if(F.col("status") == "Cancelled").alias("filtered_count"),
                 F.count(F.lit(1)).alias("unfiltered_count"))


@query("top_order_totals", f"""WITH {P_SQL},
t AS (SELECT o.id, o.customer_name, o.order_date, o.status,
             CAST(COALESCE(sum({LINE}), 0) AS DOUBLE) AS total
      FROM orders_b o LEFT JOIN items i ON i.order_id = o.id
      GROUP BY o.id, o.customer_name, o.order_date, o.status)
SELECT * FROM t ORDER BY total DESC, id ASC LIMIT 100""")
def top_order_totals(spark, sf_dir):
    """SRT-6: top-100 orders by total (limit is the feature; unique tie-break on id)."""
    _, _, o, i = _t(spark, sf_dir)
    return B.order_totals(o, i).orderBy(F.col("total").desc(), F.col("id").asc()).limit(100)


@query("orders_lookup_returned", f"""WITH {P_SQL}
SELECT * FROM orders_b WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def orders_lookup_returned(spark, sf_dir):
    """FLT-10: key lookup as a semi join against a key list (orders with returned lines)."""
    t = X.Tables(spark, sf_dir)
    keys = t.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("_k"))
    o = X.book_orders(t)
    return o.join(keys, o["id"] == F.col("_k"), "left_semi")


@query("orders_money_rank", f"""WITH {P_SQL},
t AS (SELECT o.id, CAST(COALESCE(sum({LINE}), 0) AS DOUBLE) AS total
      FROM orders_b o LEFT JOIN items i ON i.order_id = o.id GROUP BY o.id)
SELECT id, printf('$%,.2f', total) AS total_text,
       row_number() OVER (ORDER BY total, id) AS money_rank FROM t""")
def orders_money_rank(spark, sf_dir):
    """SRT-3 + WIN-3: totals shown as money text ('$1,234.50'), ordered by their
    money value (not the text) and numbered globally."""
    from stockspark.functions.numeric import money
    from stockspark.operators.ordering import global_row_number
    _, _, o, i = _t(spark, sf_dir)
    t = B.order_totals(o, i).select("id", F.format_string("$%,.2f", F.col("total")).alias("total_text"))
    ranked = global_row_number(t.withColumn("_m", money("total_text")), ["_m", "id"], "money_rank")
    return ranked.drop("_m")


@query("parts_typed_sort_rank", """
SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text,
       row_number() OVER (ORDER BY p_size, p_partkey) AS size_rank FROM part""")
def parts_typed_sort_rank(spark, sf_dir):
    """SRT-1 + WIN-3: a text column whose values all parse as numbers sorts numerically
    ('9' before '10'); the sort is numbered globally."""
    from stockspark.operators.ordering import global_row_number, typed_sort_key
    p = X.Tables(spark, sf_dir).part.select("p_partkey", F.col("p_size").cast("string").alias("size_text"))
    key = typed_sort_key(p, "size_text")
    ranked = global_row_number(p.select("*", *[k.alias(f"_k{j}") for j, k in enumerate(key)]),
                               [f"_k{j}" for j in range(len(key))] + ["p_partkey"], "size_rank")
    return ranked.drop(*[f"_k{j}" for j in range(len(key))])
