"""Declared constraints (SRC-10, JN-14), unlike files (SRC-3, SRC-8), named files (SNK-3/4), exports (SNK-7),
supplier-scoped import (DML-4), table generations (DML-13), seeding (SRC-13), column presets (PRJ-3), keyset pages (SRT-5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockspark.config import ImportPolicy
from stockspark.operators import constraints as R
from stockspark.operators import upsert as U
from stockspark.operators.book import products_view
from stockspark.operators.ordering import global_row_number, keyset_page
from stockspark.functions.text import visible_columns
from stockspark.plans import fixtures as X
from stockspark.plans.catalog import query
from stockspark.plans.q_book import P_SQL
from stockspark.plans.q_mutations import _import_sql, _products_suppliers, product_batch
from stockspark.session import checkpoint_dir
from stockspark.sinks.writers import clean_export, write_named_chunks, write_single_file
from stockspark.sources.files import read_mixed_folder, read_with_header_row
from stockspark.sources.tables import PRODUCTS, read_generations


def _folder(spark, what):
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------------- constraints


def _book(t):
    """The book's tables with some breaches: names that repeat, negative stock, odd statuses, lost references."""
    products = X.book_products(t).select(
        "id", F.concat(F.lit("SKU-"), F.when(F.col("id") % 50 == 0, F.col("id") + 1).otherwise(F.col("id")).cast("string")).alias("sku"),
        F.when(F.col("id") % 77 != 0, F.col("name")).alias("name"), (F.col("quantity") - F.when(F.col("id") % 10 == 0, 1).otherwise(0)).alias("quantity"),
        "price", F.when(F.col("id") % 13 == 0, F.col("id") + 1000000).otherwise(F.col("supplier_id")).alias("supplier_id"), "pack_size")
    orders = X.book_orders(t).withColumn("status", F.when(F.col("id") % 19 == 0, "Lost").otherwise(F.col("status")))
    items = X.book_items(t).withColumn("product_id", F.when(F.col("line_no") == 7, -F.col("product_id")).otherwise(F.col("product_id")))
    return {"suppliers": X.book_suppliers(t), "products": products, "orders": orders, "order_items": items}


_BOOK_SQL = f"""{P_SQL},
bp AS (SELECT id, 'SKU-' || CASE WHEN id % 50 = 0 THEN id + 1 ELSE id END AS sku, CASE WHEN id % 77 <> 0 THEN name END AS name,
              quantity - CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS quantity, price, CASE WHEN id % 13 = 0 THEN id + 1000000 ELSE supplier_id END AS supplier_id,
              pack_size FROM products),
bo AS (SELECT id, customer_name, order_date, CASE WHEN id % 19 = 0 THEN 'Lost' ELSE status END AS status FROM orders_b),
bi AS (SELECT order_id, line_no, CASE WHEN line_no = 7 THEN -product_id ELSE product_id END AS product_id, quantity, price_at_order FROM items)"""


@query("constraint_violations", f"""WITH {_BOOK_SQL}
SELECT 'products' AS "table", 'name required' AS rule, CAST(id AS VARCHAR) AS value, count(*) AS n FROM bp WHERE name IS NULL GROUP BY id
UNION ALL SELECT 'products', 'quantity >= 0', CAST(id AS VARCHAR), count(*) FROM bp WHERE quantity < 0 GROUP BY id
UNION ALL SELECT 'products', 'price > 0', CAST(id AS VARCHAR), count(*) FROM bp WHERE price <= 0 GROUP BY id
UNION ALL SELECT 'products', 'sku unique', sku, count(*) FROM bp GROUP BY sku HAVING count(*) > 1
UNION ALL SELECT 'suppliers', 'name unique', name, count(*) FROM suppliers GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'orders', 'status', CAST(id AS VARCHAR), count(*) FROM bo WHERE status = 'Lost' GROUP BY id
UNION ALL SELECT 'order_items', 'quantity > 0', NULL, count(*) FROM bi WHERE quantity <= 0 HAVING count(*) > 0
UNION ALL SELECT 'products', 'supplier_id refers to suppliers', CAST(supplier_id AS VARCHAR), count(*) FROM bp
          WHERE supplier_id NOT IN (SELECT id FROM suppliers) GROUP BY supplier_id
UNION ALL SELECT 'order_items', 'order_id refers to orders', CAST(order_id AS VARCHAR), count(*) FROM bi WHERE order_id NOT IN (SELECT id FROM bo) GROUP BY order_id
UNION ALL SELECT 'order_items', 'product_id refers to products', CAST(product_id AS VARCHAR), count(*) FROM bi
          WHERE product_id NOT IN (SELECT id FROM bp) GROUP BY product_id""")
def constraint_violations(spark, sf_dir):
    """SRC-10: every breach of the book's declared keys, required columns, checks and references."""
    return R.violations(_book(X.Tables(spark, sf_dir)), R.BOOK)


def _deleted(spark, sf_dir):
    t = X.Tables(spark, sf_dir)
    tables = {"suppliers": X.book_suppliers(t), "products": X.book_products(t), "orders": X.book_orders(t), "order_items": X.book_items(t)}
    asked = {"orders": t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id")),
             "suppliers": t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("id")),
             "products": t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"))}
    return R.delete_rows(tables, R.BOOK, asked)


_DELETE_SQL = f"""{P_SQL},
ask AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0),
refused AS (SELECT id FROM ask WHERE id IN (SELECT product_id FROM items)),
debt AS (SELECT s_suppkey AS id FROM supplier WHERE s_acctbal < 0)"""


@query("cascade_items", f"""WITH {_DELETE_SQL}
SELECT i.* FROM items i WHERE order_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def cascade_items(spark, sf_dir):
    """JN-14: order lines after the delete of urgent orders (they go with their order)."""
    return _deleted(spark, sf_dir)[0]["order_items"]


@query("cascade_products", f"""WITH {_DELETE_SQL}
SELECT id, sku, name, quantity, price, CASE WHEN supplier_id NOT IN (SELECT id FROM debt) THEN supplier_id END AS supplier_id, pack_size
FROM products WHERE id NOT IN (SELECT id FROM ask) OR id IN (SELECT id FROM refused)""")
def cascade_products(spark, sf_dir):
    """JN-14: products after deletes of products and of suppliers in debt (the reference becomes null)."""
    return _deleted(spark, sf_dir)[0]["products"]


@query("cascade_refused", f"""WITH {_DELETE_SQL} SELECT 'products' AS "table", CAST(id AS BIGINT) AS id FROM refused""")
def cascade_refused(spark, sf_dir):
    """JN-14: requests refused because order lines refer to the product."""
    return _deleted(spark, sf_dir)[1]


# ------------------------------------------------------------------------- files


@query("mixed_folder", """
SELECT CAST(l_partkey AS VARCHAR) AS part, CASE WHEN l_linenumber % 4 <> 3 THEN CAST(l_suppkey AS VARCHAR) END AS supp,
       CAST(l_quantity AS VARCHAR) AS qty, CASE WHEN l_linenumber % 4 = 2 THEN 'caf' || chr(233) || ' ' || l_returnflag END AS note
FROM lineitem""")
def mixed_folder(spark, sf_dir):
    """SRC-1/3: four kinds of files in one folder, unlike in delimiter, encoding, column order and columns."""
    li = X.Tables(spark, sf_dir).lineitem
    text = {"part": F.col("l_partkey").cast("string"), "supp": F.col("l_suppkey").cast("string"), "qty": F.col("l_quantity").cast("string"),
            "note": F.concat(F.lit("café "), F.col("l_returnflag"))}
    folder = _folder(spark, "mixed")
    kinds = [(",", "UTF-8", ["part", "supp", "qty"]), (";", "UTF-8", ["qty", "part", "supp"]),
             ("|", "ISO-8859-1", ["note", "supp", "part", "qty"]), ("\t", "UTF-8", ["part", "qty"])]
    for k, (sep, enc, cols) in enumerate(kinds):
        (li.where(F.col("l_linenumber") % 4 == k).select(*[text[c].alias(c) for c in cols])
         .write.option("header", True).option("sep", sep).option("encoding", enc).csv(f"{folder}/kind{k}"))
    return read_mixed_folder(spark, f"{folder}/*", ["part", "supp", "qty", "note"]).drop("_ord")


@query("header_row_offset", "SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS id FROM customer")
def header_row_offset(spark, sf_dir):
    """SRC-8: a file whose header is its third line; two named columns of it."""
    c = X.Tables(spark, sf_dir).customer
    body = c.select((F.col("c_custkey") + 3).alias("o"), F.concat_ws(",", F.col("c_custkey").cast("string"), "c_mktsegment", "c_name").alias("value"))
    # the lines above the data stand before the first customer
    top = c.groupBy().agg(F.array(F.lit("Customers"), F.lit(""), F.lit("id,segment,name")).alias("v")).select(F.posexplode("v").alias("o", "value"))
    folder = _folder(spark, "offset")
    (top.select((F.col("o") - 10).cast("long").alias("o"), "value").unionByName(body).repartition(1).sortWithinPartitions("o")
     .select("value").write.text(folder))
    return read_with_header_row(spark, folder, 2, columns=["name", "id"]).drop("_ord")


@query("named_chunk_files", """
WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS row_num FROM orders)
SELECT 'orders_20240131_' || ((row_num - 1) // 400 + 1) || '.csv' AS file, o_orderkey AS id, o_custkey AS customer FROM r""")
def named_chunk_files(spark, sf_dir):
    """SNK-3/DT-1: orders in chunks of 400, one file each under its dated name, read back with the names."""
    o = X.Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    rows = global_row_number(o, ["id"], "row_num").withColumn("chunk_id", F.floor((F.col("row_num") - 1) / 400) + 1)
    folder = _folder(spark, "named")
    write_named_chunks(rows, folder, "orders", ["id", "customer"], date_tag="20240131")
    back = spark.read.option("header", True).schema("id long, customer long").csv(folder)
    return back.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "id", "customer")


@query("export_products_of_supplier", f"""WITH {P_SQL}
SELECT CAST(id AS VARCHAR) AS id, sku, name, coalesce(pack_size, '') AS pack_size, CAST(quantity AS VARCHAR) AS quantity FROM products WHERE supplier_id = 7""")
def export_products_of_supplier(spark, sf_dir):
    """SNK-7/SNK-4: the products of one supplier as one CSV file with a byte order mark, read back."""
    p = X.book_products(X.Tables(spark, sf_dir)).where("supplier_id = 7")
    folder = _folder(spark, "export")
    write_single_file(clean_export(p, ["id", "sku", "name", "pack_size", "quantity"]), f"{folder}/products.csv", bom=True)
    back = read_mixed_folder(spark, f"{folder}/products.csv", blanks_as_empty=True)
    return back.select("id", "sku", "name", "pack_size", "quantity")


@query("export_suppliers", f"WITH {P_SQL} SELECT id, name, 's' || id || '@example.com' AS email, printf('+61-%08d', id) AS phone FROM suppliers")
def export_suppliers(spark, sf_dir):
    """SNK-7: supplier export."""
    return clean_export(X.book_suppliers(X.Tables(spark, sf_dir)), ["id", "name", "email", "phone"])


@query("export_products", f"""WITH {P_SQL}
SELECT p.id, p.sku, p.name, p.quantity, p.price, coalesce(s.name, '') AS supplier, p.pack_size
FROM products p LEFT JOIN suppliers s ON s.id = p.supplier_id""")
def export_products(spark, sf_dir):
    """SNK-7: product export with supplier names."""
    t = X.Tables(spark, sf_dir)
    rows = products_view(X.book_products(t), X.book_suppliers(t)).drop("_supplier_raw").withColumnRenamed("supplier_name", "supplier")
    return clean_export(rows, ["id", "sku", "name", "quantity", "price", "supplier", "pack_size"])


# ------------------------------------------------------------------------- imports, generations, seeding


def _scoped_sql() -> str:
    sql = _import_sql().replace("rpack <> '' AS pack_set", "TRUE AS pack_set")
    a, b = sql.index("NULLIF(", sql.index("b AS (SELECT row")), sql.index(" AS supplier,", sql.index("b AS (SELECT row"))
    return sql[:a] + "'Scoped Supplier'" + sql[b:]


@query("supplier_scoped_import", f"WITH {_scoped_sql()} SELECT * FROM result")
def supplier_scoped_import(spark, sf_dir):
    """DML-4: the import of one supplier: its name on every row, the quantity under ``qty``, a blank pack clears."""
    p, s = _products_suppliers(spark, sf_dir)
    batch = product_batch(spark, sf_dir).withColumnRenamed("quantity", "qty")
    return U.upsert_products(p, s, batch, ImportPolicy(forced_supplier="Scoped Supplier", blank_pack="clear"))[0]


@query("first_import_errors", f"WITH {_import_sql()} SELECT row, sku, error AS message FROM v WHERE error IS NOT NULL ORDER BY row LIMIT 20")
def first_import_errors(spark, sf_dir):
    """AGG-15: the first 20 errors of the product import by file row."""
    p, s = _products_suppliers(spark, sf_dir)
    _, _, errors, log = U.upsert_products(p, s, product_batch(spark, sf_dir))
    return U.import_summary(log, errors)[1]


@query("table_generations", f"""WITH {P_SQL}
SELECT id, sku, name, quantity, price, CASE WHEN id % 3 = 0 THEN NULL ELSE supplier_id END AS supplier_id,
       CASE id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'small' ELSE pack_size END AS pack_size FROM products""")
def table_generations(spark, sf_dir):
    """DML-13: three generations of products files as one table: a renamed column, a widened one, two added ones."""
    p, folder = X.book_products(X.Tables(spark, sf_dir)), _folder(spark, "generations")
    p.where("id % 3 = 0").select("id", "sku", F.col("name").alias("title"), F.col("quantity").cast("int").alias("quantity"), "price").write.parquet(f"{folder}/1")
    p.where("id % 3 = 1").select("id", "sku", "name", "quantity", "price", F.col("supplier_id").cast("int").alias("supplier_id")).write.parquet(f"{folder}/2")
    p.where("id % 3 = 2").write.parquet(f"{folder}/3")
    return read_generations(spark, [f"{folder}/{k}" for k in (1, 2, 3)], PRODUCTS, {"title": "name"}, {"pack_size": "small"})


@query("seeded_products", """
SELECT 'SKU-' || p_partkey AS sku, p_name AS name FROM part
UNION ALL SELECT DISTINCT 'SKU-' || (o_custkey * 2), 'unnamed' FROM orders WHERE o_custkey * 2 NOT IN (SELECT p_partkey FROM part)""")
def seeded_products(spark, sf_dir):
    """SRC-13: default rows are inserted for the keys that the table lacks, ignored otherwise."""
    t = X.Tables(spark, sf_dir)
    wanted = t.orders.select(F.concat(F.lit("SKU-"), (F.col("o_custkey") * 2).cast("string")).alias("sku"), F.lit("unnamed").alias("name")).distinct()
    return U.seed_defaults(X.book_products(t).select("sku", "name"), wanted, "sku")


@query("visible_order_columns", "SELECT o_orderstatus, o_orderkey FROM orders")
def visible_order_columns(spark, sf_dir):
    """PRJ-3: a preset of columns in its order; unknown names are ignored."""
    return visible_columns(X.Tables(spark, sf_dir).orders, ["o_orderstatus", "no_such", "o_orderkey"], ["o_orderkey"])


@query("orders_keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 200")
def orders_keyset_page(spark, sf_dir):
    """SRT-5: the page after key 100, by the key instead of an offset."""
    return keyset_page(X.Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey"), "o_orderkey", 100, 200)
