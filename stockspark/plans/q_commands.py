"""Order creation (DML-6), bulk commands under a unique key (DML-10, DML-12) and the two-step
change feed (STM-1), on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockspark.operators import admission as A
from stockspark.operators import claims as K
from stockspark.plans import fixtures as X
from stockspark.plans.catalog import query
from stockspark.plans.q_book import P_SQL
from stockspark.session import checkpoint_dir
from stockspark.sinks.tableset import TableSet

# ------------------------------------------------------------------------- DML-6


def _order_requests(t):
    """Requests from orders, lines from lineitem: second lines name the order's smallest product, some
    products are unknown, some quantities 0, some customers blank. Stock is three times p_size."""
    requests = t.orders.select(
        F.col("o_orderkey").alias("row"),
        F.when(F.col("o_custkey") % 97 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" Customer "), F.col("o_custkey").cast("string"))).alias("customer_name"),
        F.col("o_orderdate").cast("string").alias("order_date"))
    first = F.min("l_partkey").over(Window.partitionBy("l_orderkey"))
    n = F.col("l_linenumber")
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("row"), n.alias("line"),
        F.when((n == 6) & (F.col("l_tax") == 0), F.lit(-1)).when(n == 2, first).otherwise(F.col("l_partkey")).cast("long").alias("product_id"),
        F.when((n == 7) & (F.col("l_discount") == 0), F.lit(0)).otherwise(1 + F.col("l_quantity").cast("int") % 3).alias("quantity"))
    return requests, lines


def _created(spark, sf_dir, table):
    """The table as readers see it after one published batch of orders."""
    t = X.Tables(spark, sf_dir)
    tables = TableSet(spark, f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}")
    products = X.book_products(t).drop("quantity").join(t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 3).cast("long").alias("quantity")), "id")
    tables.publish("seed", 0, replace={
        "products": products.select("id", "sku", "name", "quantity", "price", "supplier_id", "pack_size"),
        "orders": X.book_orders(t).withColumn("order_date", F.col("order_date").cast("string")),
        "order_items": X.book_items(t).withColumn("quantity", F.col("quantity").cast("long"))})
    A.publish_orders(tables, 1, *_order_requests(t))
    return tables.read(table)


_CREATE_CTE = f"""{P_SQL},
rq AS (SELECT o_orderkey AS row, CASE WHEN o_custkey % 97 = 0 THEN '' ELSE 'Customer ' || o_custkey END AS customer_name,
              CAST(o_orderdate AS VARCHAR) AS order_date FROM orders),
li AS MATERIALIZED (SELECT l_orderkey AS row, l_linenumber AS line,
              CASE WHEN l_linenumber = 6 AND l_tax = 0 THEN -1
                   WHEN l_linenumber = 2 THEN min(l_partkey) OVER (PARTITION BY l_orderkey) ELSE l_partkey END AS pid,
              CASE WHEN l_linenumber = 7 AND l_discount = 0 THEN 0 ELSE 1 + CAST(l_quantity AS INTEGER) % 3 END AS q FROM lineitem),
hd AS (SELECT rq.*, CASE WHEN customer_name = '' THEN 'Customer name is required.' WHEN n IS NULL THEN 'Order must contain at least one product.'
                         WHEN bad > 0 THEN 'Quantity must be greater than 0.' END AS header_error
       FROM rq LEFT JOIN (SELECT row, count(*) AS n, count(*) FILTER (WHERE q <= 0) AS bad FROM li GROUP BY row) USING (row)),
mg AS MATERIALIZED (SELECT row, pid, CAST(sum(q) AS BIGINT) AS dq, min(line) AS line FROM li
       WHERE row IN (SELECT row FROM hd WHERE header_error IS NULL) GROUP BY row, pid),
st AS (SELECT p_partkey AS pid, CAST(p_size * 3 AS BIGINT) AS stock FROM part),
rounds AS (
  SELECT 0 AS k, pid, row, dq, line, stock,
         CASE WHEN row IN (SELECT row FROM mg WHERE pid NOT IN (SELECT pid FROM st)) THEN 'R' ELSE 'U' END AS s FROM mg JOIN st USING (pid)
  UNION ALL
  SELECT k + 1, pid, row, dq, line, stock,
         CASE WHEN s = 'U' AND bool_and(stock - ub >= dq) OVER (PARTITION BY row) THEN 'A'
              WHEN s = 'U' AND bool_or(stock - lb < dq) OVER (PARTITION BY row) THEN 'R' ELSE s END
  FROM (SELECT *, CAST(coalesce(sum(CASE WHEN s = 'A' THEN dq ELSE 0 END) OVER before, 0) AS BIGINT) AS lb,
               CAST(coalesce(sum(CASE WHEN s <> 'R' THEN dq ELSE 0 END) OVER before, 0) AS BIGINT) AS ub,
               bool_or(s = 'U') OVER () AS more
        FROM rounds WINDOW before AS (PARTITION BY pid ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE more),
fin AS MATERIALIZED (SELECT *, stock - CAST(coalesce(sum(CASE WHEN s = 'A' THEN dq ELSE 0 END) OVER (
                      PARTITION BY pid ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS avail
        FROM rounds WHERE k = (SELECT max(k) FROM rounds)),
ids AS MATERIALIZED (SELECT row, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY row) AS order_id FROM (SELECT DISTINCT row FROM fin WHERE s = 'A')),
made AS (SELECT order_id, line, pid, dq, price FROM fin JOIN ids USING (row) JOIN products ON products.id = pid)"""


@query("created_orders", f"""WITH RECURSIVE {_CREATE_CTE}
SELECT id, customer_name, CAST(order_date AS VARCHAR) AS order_date, status FROM orders_b
UNION ALL SELECT order_id, customer_name, order_date, 'Pending' FROM hd JOIN ids USING (row)""")
def created_orders(spark, sf_dir):
    """DML-6: orders after a published batch of requests, ids in request order."""
    return _created(spark, sf_dir, "orders")


@query("created_items", f"""WITH RECURSIVE {_CREATE_CTE}
SELECT order_id, line_no, product_id, CAST(quantity AS BIGINT) AS quantity, price_at_order FROM items
UNION ALL SELECT order_id, line, pid, dq, price FROM made""")
def created_items(spark, sf_dir):
    """DML-6: order lines after the batch, lines of one product merged, at the product's price."""
    return _created(spark, sf_dir, "order_items")


@query("created_stock", f"""WITH RECURSIVE {_CREATE_CTE}
SELECT p.id, p.sku, p.name, CAST(st.stock - coalesce(u.taken, 0) AS BIGINT) AS quantity, p.price, p.supplier_id, p.pack_size
FROM products p JOIN st ON st.pid = p.id LEFT JOIN (SELECT pid, sum(dq) AS taken FROM made GROUP BY pid) u ON u.pid = p.id""")
def created_stock(spark, sf_dir):
    """DML-6: products with the stock that the created orders left."""
    return _created(spark, sf_dir, "products")


@query("created_decisions", f"""WITH RECURSIVE {_CREATE_CTE},
sh AS (SELECT mg.row, arg_min({{'sku': products.sku, 'avail': fin.avail}}, (mg.line, mg.pid)) AS f
       FROM mg LEFT JOIN fin ON fin.row = mg.row AND fin.pid = mg.pid LEFT JOIN products ON products.id = mg.pid
       WHERE fin.pid IS NULL OR fin.avail < mg.dq GROUP BY mg.row)
SELECT hd.row, order_id, coalesce(header_error, CASE WHEN order_id IS NULL
         THEN printf('Not enough stock for %s. Available: %d', coalesce(f.sku, '?'), coalesce(f.avail, 0)) END) AS error
FROM hd LEFT JOIN ids USING (row) LEFT JOIN sh USING (row)""")
def created_decisions(spark, sf_dir):
    """DML-6: every request with its order id, or why it was refused."""
    return _created(spark, sf_dir, "order_decisions")


# ------------------------------------------------------------------------- DML-10, DML-12


def _settled(claims: str, holders: str) -> str:
    """CTEs ending in ``verdicts`` (seq, ent, granted): the rounds over ``claims`` and ``holders`` (ent, key)."""
    return f"""
rounds AS (
  SELECT 0 AS k, seq, ent, key, st FROM (SELECT CAST(0 AS BIGINT) AS seq, ent, key, 'A' AS st FROM {holders}
                                         UNION ALL SELECT seq, ent, key, 'U' FROM {claims})
  UNION ALL
  SELECT k + 1, seq, ent, key,
         CASE WHEN st <> 'U' THEN st
              WHEN c IS NOT NULL AND c.ent <> ent AND coalesce(c.may > seq, true) THEN 'R'
              WHEN (c IS NULL OR c.ent = ent OR coalesce(c.gone < seq, false)) AND (u IS NULL OR coalesce(u < c.seq, false)) THEN 'A' ELSE 'U' END
  FROM (SELECT *, last_value(CASE WHEN st = 'A' THEN {{'seq': seq, 'ent': ent, 'may': may, 'gone': gone}} END IGNORE NULLS) OVER kw AS c,
               max(CASE WHEN st = 'U' THEN seq END) OVER kw AS u
        FROM (SELECT *, min(CASE WHEN st <> 'R' THEN seq END) OVER ew AS may, min(CASE WHEN st = 'A' THEN seq END) OVER ew AS gone,
                     bool_or(st = 'U') OVER () AS more
              FROM rounds WINDOW ew AS (PARTITION BY ent ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
        WHERE more WINDOW kw AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
verdicts AS MATERIALIZED (SELECT seq, ent, st = 'A' AS granted FROM rounds WHERE k = (SELECT max(k) FROM rounds) AND seq > 0)"""


def _supplier_commands(t):
    """Commands from customer rows: one in three updates the supplier numbered custkey / 15 (0 is none),
    the others insert; names overlap with those of the suppliers and of each other."""
    k = F.col("c_custkey")
    name = F.when(k % 41 == 0, F.lit(" ")).otherwise(F.format_string(" Supplier#%09d", F.floor(k / 10) + F.col("c_nationkey")))
    return t.customer.select(k.alias("seq"), F.when(k % 3 == 0, "update").otherwise("insert").alias("op"),
                             F.when(k % 3 == 0, F.floor(k / 15)).cast("long").alias("id"), name.alias("name"),
                             F.when(k % 2 == 0, F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com"))).otherwise("").alias("email"),
                             F.col("c_mktsegment").alias("phone"))


_SUPPLIER_CTE = f"""
ex AS (SELECT s_suppkey AS id, s_name AS name, 's' || s_suppkey || '@example.com' AS email, printf('+61-%08d', s_suppkey) AS phone FROM supplier),
cm AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN 'update' ELSE 'insert' END AS op,
              CASE WHEN c_custkey % 3 = 0 THEN c_custkey // 15 END AS id,
              CASE WHEN c_custkey % 41 = 0 THEN '' ELSE printf('Supplier#%09d', c_custkey // 10 + c_nationkey) END AS name,
              CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey || '@example.com' END AS email, c_mktsegment AS phone FROM customer),
cl AS (SELECT seq, CASE WHEN op = 'insert' THEN -seq ELSE id END AS ent, name AS key FROM cm
       WHERE name <> '' AND (op = 'insert' OR id IN (SELECT id FROM ex))),
ho AS (SELECT id AS ent, name AS key FROM ex),{_settled('cl', 'ho')},
nw AS (SELECT seq, (SELECT max(id) FROM ex) + row_number() OVER (ORDER BY seq) AS nid FROM verdicts WHERE granted AND ent < 0),
dn AS (SELECT cm.*, granted, CASE WHEN op = 'update' THEN cm.id ELSE nid END AS tid FROM cm LEFT JOIN verdicts USING (seq) LEFT JOIN nw USING (seq))"""


@query("bulk_suppliers", f"""WITH RECURSIVE {_SUPPLIER_CTE}
SELECT id, name, email, phone FROM ex WHERE id NOT IN (SELECT tid FROM dn WHERE granted)
UNION ALL SELECT tid, x.name, x.email, x.phone FROM (
  SELECT tid, arg_max({{'name': name, 'email': email, 'phone': phone}}, seq) AS x FROM dn WHERE granted GROUP BY tid)""")
def bulk_suppliers(spark, sf_dir):
    """DML-10: suppliers after inserts, updates and renames in sequence, names unique at every moment."""
    t = X.Tables(spark, sf_dir)
    return K.bulk_suppliers(X.book_suppliers(t), _supplier_commands(t))[0]


@query("bulk_suppliers_log", f"""WITH RECURSIVE {_SUPPLIER_CTE}
SELECT seq, op, tid AS id,
       CASE WHEN name = '' OR NOT granted THEN 'refused' WHEN granted IS NULL THEN 'no such row' WHEN op = 'update' THEN 'updated' ELSE 'inserted' END AS action,
       CASE WHEN name = '' THEN 'Name is required.' WHEN NOT granted THEN 'A supplier with the name ''' || name || ''' already exists.' END AS message
FROM dn""")
def bulk_suppliers_log(spark, sf_dir):
    """DML-10: what became of every supplier command."""
    t = X.Tables(spark, sf_dir)
    return K.bulk_suppliers(X.book_suppliers(t), _supplier_commands(t))[1]


def _product_commands(t):
    """Commands from orders: one in two updates the product numbered custkey, the others insert."""
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    sku = F.when(o % 53 == 0, F.lit("")).otherwise(F.concat(F.lit("SKU-"), (k + (o % 7) * 500).cast("string")))
    return t.orders.select(
        o.alias("seq"), F.when(o % 2 == 0, "update").otherwise("insert").alias("op"), F.when(o % 2 == 0, k).alias("id"), sku.alias("sku"),
        F.concat(F.lit("Item "), o.cast("string")).alias("name"),
        F.when(o % 31 == 0, "many").otherwise((o % 19).cast("string")).alias("quantity"),
        F.when(o % 37 == 0, "dear").otherwise((o % 11).cast("string")).alias("price"),
        F.format_string("Supplier#%09d", k % 150).alias("supplier"),
        F.when(o % 29 == 0, "vast").when(o % 5 == 0, "small").when(o % 5 == 1, " bulky ").otherwise("").alias("pack_size"))


@query("bulk_products", f"""WITH RECURSIVE {P_SQL},
cm AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'update' ELSE 'insert' END AS op, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS id,
              'SKU-' || (o_custkey + (o_orderkey % 7) * 500) AS sku, 'Item ' || o_orderkey AS name, CAST(o_orderkey % 19 AS BIGINT) AS quantity,
              CAST(o_orderkey % 11 AS DOUBLE) AS price, (SELECT min(id) FROM suppliers s WHERE s.name = printf('Supplier#%09d', o_custkey % 150)) AS supplier_id,
              CASE WHEN o_orderkey % 5 = 0 THEN 'small' WHEN o_orderkey % 5 = 1 THEN 'bulky' END AS pack_size FROM orders
       WHERE o_orderkey % 53 <> 0 AND o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0 AND o_orderkey % 29 <> 0),
cl AS (SELECT seq, CASE WHEN op = 'insert' THEN -seq ELSE id END AS ent, sku AS key FROM cm WHERE op = 'insert' OR id IN (SELECT id FROM products)),
ho AS (SELECT id AS ent, sku AS key FROM products),{_settled('cl', 'ho')},
nw AS (SELECT seq, (SELECT max(id) FROM products) + row_number() OVER (ORDER BY seq) AS nid FROM verdicts WHERE granted AND ent < 0),
dn AS (SELECT cm.*, CASE WHEN op = 'update' THEN cm.id ELSE nid END AS tid FROM cm JOIN verdicts USING (seq) LEFT JOIN nw USING (seq) WHERE granted)
SELECT id, sku, name, quantity, price, supplier_id, pack_size FROM products WHERE id NOT IN (SELECT tid FROM dn)
UNION ALL SELECT tid, x.* FROM (SELECT tid, arg_max({{'sku': sku, 'name': name, 'quantity': quantity, 'price': price,
  'supplier_id': supplier_id, 'pack_size': pack_size}}, seq) AS x FROM dn GROUP BY tid)""")
def bulk_products(spark, sf_dir):
    """DML-10: products after inserts and updates in sequence, skus unique at every moment."""
    t = X.Tables(spark, sf_dir)
    return K.bulk_products(X.book_products(t), X.book_suppliers(t), _product_commands(t))[0]


def _product_documents(t):
    """New product documents from lineitem orders: skus of parts and unknown ones, many repeated."""
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(o.alias("seq"), F.concat(F.when(o % 3 == 0, "SKU-").otherwise("DOC-"), k.cast("string")).alias("sku"),
                           F.col("o_orderpriority").alias("name"), (o % 9).cast("long").alias("stock"), F.lit(None).cast("string").alias("sap_article_id"))


@query("created_products", f"""WITH {P_SQL},
ex AS (SELECT id, sku, name, quantity AS stock, CAST(NULL AS VARCHAR) AS sap_article_id FROM products),
d AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'SKU-' ELSE 'DOC-' END || o_custkey AS sku, o_orderpriority AS name,
             CAST(o_orderkey % 9 AS BIGINT) AS stock FROM orders),
n AS (SELECT sku, min(seq) AS seq, arg_min(name, seq) AS name, arg_min(stock, seq) AS stock FROM d WHERE sku NOT IN (SELECT sku FROM ex) GROUP BY sku)
SELECT * FROM ex
UNION ALL SELECT (SELECT max(id) FROM ex) + row_number() OVER (ORDER BY seq), sku, name, stock, NULL FROM n""")
def created_products(spark, sf_dir):
    """DML-12: product documents become products, the first of a new sku counts."""
    t = X.Tables(spark, sf_dir)
    existing = X.book_products(t).select("id", "sku", "name", F.col("quantity").alias("stock"), F.lit(None).cast("string").alias("sap_article_id"))
    return K.create_products(existing, _product_documents(t))[0]
