"""File sources, sinks, projections and patches over the given tables.

Tables are staged as files below the checkpoint folder by the library's own
sinks and read back by its sources, so every row passes through both.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockspark.config import CARRIERS
from stockspark.functions.keys import template_key
from stockspark.functions.text import clean_frame, guess_column, snake_case_col, snake_headers
from stockspark.operators import admission as A
from stockspark.operators import compare as C
from stockspark.operators import documents as D
from stockspark.operators import quality as Q
from stockspark.operators import upsert as U
from stockspark.operators.ordering import global_row_number, numeric_first_sort_key
from stockspark.plans import fixtures as X
from stockspark.plans.catalog import query
from stockspark.plans.q_book import _documents
from stockspark.plans.q_compare import _V3_COLS, _V3_CTE, _v3_sides
from stockspark.plans.sqlkit import LI_ORDER_ASC
from stockspark.session import checkpoint_dir
from stockspark.sinks.writers import clean_export, write_csv, write_parquet
from stockspark.sources import columns_and_count, preview, read_snapshot, read_table, read_typed
from stockspark.sources.tables import PRODUCTS, carriers, parse_json_list


def _folder(spark, what: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/staged/{what}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------------------------- files

@query("csv_round_trip", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5, lang, source FROM documents""")
def csv_round_trip(spark, sf_dir):
    """SRC-1/3/5, SNK-1: documents (quotes and line ends in cells) written as CSV and read as a snapshot."""
    path = _folder(spark, "documents")
    write_csv(X.Tables(spark, sf_dir).documents.select("doc_id", "text", "lang", "source"), path)
    back = read_snapshot(spark, path, sep=",", multi_line=True)
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source")


@query("csv_long_lines", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part WHERE p_partkey % 3 <> 0""")
def csv_long_lines(spark, sf_dir):
    """SRC-4: lines of part files with an extra blank field are dropped."""
    path = _folder(spark, "long")
    p = X.Tables(spark, sf_dir).part
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name")
    extra = F.when(F.col("p_partkey") % 3 == 0, F.lit(",")).otherwise(F.lit(""))
    lines = p.select(F.concat(line, extra).alias("value"), (F.col("p_partkey") % 4).alias("k"))
    # every file of the folder starts with the header
    head = spark.range(4).select(F.lit("p_partkey,p_name").alias("value"), (F.col("id")).alias("k"), F.lit(0).alias("o"))
    (head.unionByName(lines.withColumn("o", F.lit(1))).repartition(4, "k").sortWithinPartitions("k", "o")
     .select("value", "k").write.partitionBy("k").text(path))
    out = None
    for k in range(4):
        part = read_snapshot(spark, f"{path}/k={k}", sep=",").select("p_partkey", "p_name")
        out = part if out is None else out.unionByName(part)
    return out


@query("csv_typed_read", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_typed_read(spark, sf_dir):
    """SRC-2: part written as CSV and read with its types."""
    path = _folder(spark, "part")
    p = X.Tables(spark, sf_dir).part.select("p_partkey", "p_name", "p_size", "p_retailprice")
    write_csv(p, path)
    return read_typed(spark, path, p.schema).drop("_ord")


@query("csv_columns_and_count", """
SELECT 'o_orderkey,o_custkey,o_totalprice' AS columns, count(*) AS n FROM orders""")
def csv_columns_and_count(spark, sf_dir):
    """SRC-6: header fields and number of records of the orders file."""
    path = _folder(spark, "orders")
    write_csv(X.Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_totalprice"), path)
    names, n = columns_and_count(spark, path)
    return spark.createDataFrame([(",".join(names), n)], "columns string, n long")


@query("cleaned_frame", """
SELECT c_custkey AS customer_key, trim(c_name) || ' ''x'' - "y"' AS customer_name, c_nationkey AS nation_key FROM customer""")
def cleaned_frame(spark, sf_dir):
    """SRC-7, STR-7/8: typographic headers and values of customer rows cleaned."""
    c = X.Tables(spark, sf_dir).customer
    raw = c.select(F.col("c_custkey").alias("﻿ Customer Key"),
                   F.concat(F.lit(" ﻿"), F.col("c_name"), F.lit(" ‘x’ – “y”  ")).alias("Customer Name "),
                   F.col("c_nationkey").alias("Nation Key"))
    return clean_frame(raw)


@query("snake_columns", """
SELECT p_partkey AS part_key, lower(trim(regexp_replace(p_type || ' / ' || p_brand, '[^0-9a-zA-Z]+', '_', 'g'), '_')) AS kind_of_part
FROM part""")
def snake_columns(spark, sf_dir):
    """PRJ-4, STR-6: headers and a text column of part in snake case."""
    p = X.Tables(spark, sf_dir).part
    raw = p.select(F.col("p_partkey").alias(" Part-Key"), snake_case_col(F.concat_ws(" / ", "p_type", "p_brand")).alias("Kind (of) part!"))
    return snake_headers(raw)


@query("json_lists", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 2 END AS n, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS second
FROM orders""")
def json_lists(spark, sf_dir):
    """SRC-9, JSN-1: JSON lists held in text; other JSON gives null."""
    o = X.Tables(spark, sf_dir).orders
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit('{"a": 1}')).otherwise(
        F.concat(F.lit(" "), F.to_json(F.array("o_orderpriority", "o_orderstatus"))))
    items = parse_json_list(text)
    return o.select("o_orderkey", F.when(items.isNotNull(), F.size(items)).alias("n"), items[1].alias("second"))


@query("widened_table", """
SELECT p_partkey AS id, 'SKU-' || CAST(p_partkey AS VARCHAR) AS sku, p_name AS name, p_size % 12 AS quantity,
       p_retailprice AS price, p_partkey % 100 AS supplier_id, CAST(NULL AS VARCHAR) AS pack_size FROM part""")
def widened_table(spark, sf_dir):
    """SRC-10, DML-13, SNK-5: an old products table without pack_size read with today's schema."""
    path = _folder(spark, "products")
    write_parquet(X.book_products(X.Tables(spark, sf_dir)).drop("pack_size"), path)
    return read_table(spark, path, PRODUCTS).select("id", "sku", "name", F.col("quantity").cast("bigint").alias("quantity"), "price",
                                                    "supplier_id", "pack_size")


_CARRIER_ROWS = ", ".join(f"({i}, '{c}', '{n}', {len(s)})" for i, (c, n, s) in enumerate(CARRIERS))


@query("order_carriers", f"""
SELECT o_orderkey, code, name, CAST(n AS INTEGER) AS n_services
FROM orders JOIN (VALUES {_CARRIER_ROWS}) AS t(k, code, name, n) ON o_orderkey % {len(CARRIERS)} = k""")
def order_carriers(spark, sf_dir):
    """SRC-11: every order with its carrier of the carrier dimension."""
    o = X.Tables(spark, sf_dir).orders
    codes = F.array(*[F.lit(c) for c, _, _ in CARRIERS])
    wanted = o.select("o_orderkey", F.get(codes, (F.col("o_orderkey") % len(CARRIERS)).cast("int")).alias("code"))
    return wanted.join(carriers(spark), "code").select("o_orderkey", "code", "name", F.size("services").alias("n_services"))


@query("file_preview", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem ORDER BY {LI_ORDER_ASC} LIMIT 100""")
def file_preview(spark, sf_dir):
    """SRC-14: the first 100 rows in file order."""
    li = X.Tables(spark, sf_dir).lineitem
    return preview(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", X.li_ord()), 100).drop("_ord")


@query("clean_export_customers", """
SELECT c_name AS name, c_mktsegment AS segment, '' AS email FROM customer""")
def clean_export_customers(spark, sf_dir):
    """SNK-2/7: customer export, wanted columns in order, missing ones blank."""
    c = X.Tables(spark, sf_dir).customer
    raw = c.select(F.col("c_mktsegment").alias("Segment"), F.concat(F.lit(" "), "c_name").alias(" Name"), "c_acctbal")
    return clean_export(raw, ["Name", "Segment", "Email"])


# ---------------------------------------------------------------------------------- keys, roles, filters

@query("template_keys", """
SELECT CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR) || '|' || l_returnflag AS key, count(*) AS n
FROM lineitem GROUP BY 1""")
def template_keys(spark, sf_dir):
    """STR-4: rows per three-part template key."""
    li = X.Tables(spark, sf_dir).lineitem
    key = template_key(F.concat(F.lit(" "), F.col("l_partkey").cast("string")), F.col("l_suppkey"), F.col("l_returnflag"))
    return li.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("guessed_roles", """
SELECT CAST(l_partkey AS VARCHAR) AS sku, CAST(l_suppkey AS VARCHAR) AS account, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL""")
def guessed_roles(spark, sf_dir):
    """PRJ-2: quantities by the columns guessed for sku and account."""
    li = X.Tables(spark, sf_dir).lineitem.select(
        "l_orderkey", F.col("l_quantity").alias("On-Hand"), F.col("l_suppkey").cast("string").alias("Vendor Name"),
        F.col("l_partkey").cast("string").alias("Item Code"))
    sku, account, qty = (guess_column(li.columns, role) for role in ("sku", "account", "qty"))
    return li.groupBy(F.col(f"`{sku}`").alias("sku"), F.col(f"`{account}`").alias("account")).agg(F.sum(f"`{qty}`").alias("qty"))


@query("v3_view_filter", f"WITH {_V3_CTE} SELECT * FROM v3 WHERE Status = 'Mismatched' AND CAST(vendor_id AS VARCHAR) LIKE '%1%' "
       "AND regexp_matches(lower(sku), 'p1.*[05]$')")
def v3_view_filter(spark, sf_dir):
    """FLT-5: status, vendor and sku terms over the vendor compare."""
    a, b = _v3_sides(spark, sf_dir)
    return C.view_filter_v3(C.compare_v3(a, b, *_V3_COLS), "Mismatched", "1", "P1.*[05]$")


@query("side_row_counts", """
SELECT 'orders' AS side, count(*) AS rows FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem""")
def side_row_counts(spark, sf_dir):
    """AGG-17: rows per side."""
    t = X.Tables(spark, sf_dir)
    return Q.side_counts(orders=t.orders, lines=t.lineitem)


@query("merged_order_lines", """
SELECT l_orderkey AS order_id, l_partkey AS product_id, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM lineitem GROUP BY ALL""")
def merged_order_lines(spark, sf_dir):
    """AGG-16: repeated lines of one product in an order become one."""
    return A.merge_lines(X.book_items(X.Tables(spark, sf_dir)))


@query("numeric_first_rank", """
WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a ' || CAST(o_custkey AS VARCHAR)
                                   WHEN o_orderkey % 11 = 0 THEN '1,' || CAST(100 + o_custkey % 900 AS VARCHAR)
                                   ELSE CAST(o_custkey AS VARCHAR) END AS t FROM orders)
SELECT o_orderkey, t, row_number() OVER (ORDER BY coalesce(TRY_CAST(replace(t, ',', '') AS DOUBLE), 'inf'::DOUBLE), t, o_orderkey) AS rank
FROM v""")
def numeric_first_rank(spark, sf_dir):
    """SRT-2: rank by numeric value, text after all numbers."""
    o = X.Tables(spark, sf_dir).orders
    cust = F.col("o_custkey").cast("string")
    t = (F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("n/a "), cust))
         .when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("1,"), (100 + F.col("o_custkey") % 900).cast("string"))).otherwise(cust))
    d = o.select("o_orderkey", t.alias("t"))
    return global_row_number(d, [*numeric_first_sort_key("t"), "o_orderkey"], "rank")


# ---------------------------------------------------------------------------------- patches, deletes, document view

_PATCH_SQL = """
pat AS (SELECT 'SKU-' || CAST(l_partkey + CASE WHEN l_tax = 0 THEN 10000000 ELSE 0 END AS VARCHAR) AS sku,
               CASE WHEN l_discount = 0 THEN -1 ELSE CAST(l_quantity AS BIGINT) END AS stock,
               l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS _ord FROM lineitem)"""


def _patches(spark, sf_dir):
    li = X.Tables(spark, sf_dir).lineitem
    key = F.col("l_partkey") + F.when(F.col("l_tax") == 0, 10000000).otherwise(0)
    order = F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")
    return li.select(F.concat(F.lit("SKU-"), key.cast("string")).alias("sku"),
                     F.when(F.col("l_discount") == 0, -1).otherwise(F.col("l_quantity")).cast("bigint").alias("stock"),
                     order.alias("_ord"))


@query("stock_patches", f"""WITH {_PATCH_SQL}
SELECT p_partkey AS id, coalesce(last, p_size % 12) AS quantity
FROM part LEFT JOIN (SELECT sku, arg_max(stock, (_ord, stock)) AS last FROM pat WHERE stock >= 0 GROUP BY sku)
     ON sku = 'SKU-' || CAST(p_partkey AS VARCHAR)""")
def stock_patches(spark, sf_dir):
    """DML-12: one stock patch per line; each is judged alone, the last valid one of a sku counts."""
    patches = _patches(spark, sf_dir).withColumn("_ord", F.struct("_ord", "stock"))
    return U.patch_stock(X.book_products(X.Tables(spark, sf_dir)), patches)[0].select("id", "quantity")


@query("stock_patch_rejects", f"""WITH {_PATCH_SQL}
SELECT _ord, sku, CASE WHEN p_partkey IS NULL THEN 'Product not found' ELSE 'Stock must be >= 0' END AS reason
FROM pat LEFT JOIN part ON sku = 'SKU-' || CAST(p_partkey AS VARCHAR) WHERE p_partkey IS NULL OR stock < 0""")
def stock_patch_rejects(spark, sf_dir):
    """DML-12: every refused stock patch with its reason."""
    return U.patch_stock(X.book_products(X.Tables(spark, sf_dir)), _patches(spark, sf_dir))[1]


@query("article_id_patches", """
WITH pat AS (SELECT l_partkey, CASE WHEN l_tax = 0.01 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS v,
                    l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS o FROM lineitem)
SELECT p_partkey AS id, coalesce(last, 'old') AS sap_article_id
FROM part LEFT JOIN (SELECT l_partkey, arg_max(v, (o, v)) AS last FROM pat WHERE v <> '' GROUP BY 1) ON l_partkey = p_partkey""")
def article_id_patches(spark, sf_dir):
    """DML-12: article ids patched by line; blank ones are refused and change nothing."""
    t = X.Tables(spark, sf_dir)
    li = t.lineitem
    order = F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")
    text = F.when(F.col("l_tax") == 0.01, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("l_suppkey").cast("string")))
    patches = li.select(F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku"), text.alias("sap_article_id"),
                        F.struct(order, F.trim(text)).alias("_ord"))
    products = X.book_products(t).select("id", "sku", F.lit("old").alias("sap_article_id"))
    return D.patch_article_ids(products, patches)[0].select("id", "sap_article_id")


@query("products_without_supplier", """
SELECT p_partkey AS id, CASE WHEN s_suppkey IS NULL THEN p_partkey % 100 END AS supplier_id
FROM part LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) ON p_partkey % 100 = s_suppkey""")
def products_without_supplier(spark, sf_dir):
    """DML-10: products after the deletion of suppliers in debt (their reference becomes null)."""
    t = X.Tables(spark, sf_dir)
    gone = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("id"))
    return U.delete_suppliers(X.book_suppliers(t), X.book_products(t), gone)[1].select("id", "supplier_id")


@query("order_document_view", """
WITH x AS (SELECT o_orderkey AS k, 'PO-' || CAST(floor(o_orderkey / 2) AS BIGINT) AS r, o_orderstatus AS s, o_custkey FROM orders),
acc AS (SELECT * FROM x WHERE r NOT IN (SELECT r FROM x WHERE s = 'F')
        QUALIFY row_number() OVER (PARTITION BY r ORDER BY k) = 1),
n AS (SELECT l_orderkey, count(*) AS c, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1)
SELECT r AS order_reference, c_name AS full_name, c_mktsegment AS retailer, CAST(coalesce(c, 0) AS INTEGER) AS n_items,
       coalesce(q, 0) AS items_quantity
FROM acc LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN n ON l_orderkey = k""")
def order_document_view(spark, sf_dir):
    """PRJ-7: ingested order documents nested again: address, retailer, items."""
    orders, items, _ = _documents(spark, sf_dir)
    v = D.order_document_view(orders, items, ["line_no", "part_number", "quantity"])
    total = F.aggregate("items", F.lit(0).cast("bigint"), lambda a, i: a + i["quantity"])
    return v.select("order_reference", F.col("shipping_address.full_name").alias("full_name"),
                    F.col("retailer_data.name").alias("retailer"), F.size("items").alias("n_items"), total.alias("items_quantity"))
