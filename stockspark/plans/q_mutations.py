"""Mutation queries: product/supplier imports, stock ledger, status changes, deletes,
mapping-quality metrics and distinct-row export."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockspark.config import ImportPolicy
from stockspark.operators import quality as Q
from stockspark.operators import upsert as U
from stockspark.plans import fixtures as X
from stockspark.plans.catalog import query
from stockspark.plans.q_book import P_SQL
from stockspark.plans.sqlkit import LI_ORDER_ASC, strip

# ------------------------------------------------------------------------- product import


def product_batch(spark, sf_dir):
    """Import file rows (sku, name, quantity, price, supplier, pack_size as text, plus
    the file order) from lineitem x part, with the bad cells the import must reject."""
    t = X.Tables(spark, sf_dir)
    p = t.part.select("p_partkey", "p_name", "p_retailprice")
    li = t.lineitem.join(p, F.col("l_partkey") == F.col("p_partkey"))
    ln = F.col("l_linenumber")
    sku = F.when(ln == 7, F.concat(F.lit("NEW-"), F.col("l_partkey").cast("string"))) \
           .otherwise(F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")))
    name = F.when((ln == 3) & (F.col("l_discount") == 0), F.lit("")) \
            .otherwise(F.concat(F.col("p_name"), F.lit(" v"), ln.cast("string")))
    qty = (F.when(F.col("l_tax") == 0, F.lit("5.0")).when(F.col("l_tax") == 0.01, F.lit("-1"))
           .when(F.col("l_tax") == 0.02, F.lit(" 7 ")).otherwise(F.col("l_quantity").cast("int").cast("string")))
    price = (F.when(F.col("l_discount") == 0.01, F.lit("abc")).when(F.col("l_discount") == 0.02, F.lit("0"))
             .when(F.col("l_discount") == 0.03, F.lit("nan")).otherwise(F.col("p_retailprice").cast("string")))
    sup = (F.when(F.col("l_suppkey") % 10 == 0, F.lit(""))
           .when(F.col("l_suppkey") % 7 == 0, F.concat(F.lit("New Supplier "), (F.col("l_suppkey") % 3).cast("string")))
           .otherwise(F.format_string("Supplier#%09d", F.col("l_suppkey"))))
    pack = (F.when(ln == 1, "Small").when(ln == 2, " medium ").when(ln == 3, "").when(ln == 4, "huge")
            .when(ln == 5, F.lit(None).cast("string")).when(ln == 6, "LARGE").otherwise("bulky"))
    return li.select(sku.alias("sku"), name.alias("name"), qty.alias("quantity"), price.alias("price"),
                     sup.alias("supplier"), pack.alias("pack_size"), X.li_ord())


def _products_suppliers(spark, sf_dir):
    t = X.Tables(spark, sf_dir)
    s = X.book_suppliers(t)
    return X.book_products(t), s


def _run_import(spark, sf_dir, policy=ImportPolicy()):
    p, s = _products_suppliers(spark, sf_dir)
    return U.upsert_products(p, s, product_batch(spark, sf_dir), policy)


def _py_int(x):
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN CAST(0 AS BIGINT) "
            f"WHEN regexp_full_match({x}, '\\s*[+-]?\\d(_?\\d)*\\s*') "
            f"THEN TRY_CAST(replace({strip(x)}, '_', '') AS BIGINT) END")


def _py_float(x):
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN 0.0 "
            f"WHEN regexp_full_match(lower({x}), '\\s*[+-]?((\\d(_?\\d)*(\\.(\\d(_?\\d)*)?)?|\\.\\d(_?\\d)*)"
            f"(e[+-]?\\d(_?\\d)*)?|inf|infinity|nan)\\s*') "
            f"THEN TRY_CAST(replace({strip(x)}, '_', '') AS DOUBLE) END")


def _import_sql(allow_name=True, allow_price=True, allow_supplier=True) -> str:
    def attr(allowed, last, existing, ins):
        return last if allowed else f"CASE WHEN eid IS NOT NULL THEN {existing} ELSE {ins} END"
    return f"""{P_SQL},
b0 AS (
  SELECT row_number() OVER (ORDER BY {LI_ORDER_ASC}) AS row,
         CASE WHEN l_linenumber = 7 THEN 'NEW-' ELSE 'SKU-' END || CAST(l_partkey AS VARCHAR) AS sku_t,
         CASE WHEN l_linenumber = 3 AND l_discount = 0 THEN '' ELSE p_name || ' v' || CAST(l_linenumber AS VARCHAR) END AS name_t,
         CASE WHEN l_tax = 0 THEN '5.0' WHEN l_tax = 0.01 THEN '-1' WHEN l_tax = 0.02 THEN ' 7 '
              ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS qty_t,
         CASE WHEN l_discount = 0.01 THEN 'abc' WHEN l_discount = 0.02 THEN '0' WHEN l_discount = 0.03 THEN 'nan'
              ELSE CAST(p_retailprice AS VARCHAR) END AS price_t,
         CASE WHEN l_suppkey % 10 = 0 THEN '' WHEN l_suppkey % 7 = 0 THEN 'New Supplier ' || CAST(l_suppkey % 3 AS VARCHAR)
              ELSE printf('Supplier#%09d', l_suppkey) END AS sup_t,
         CASE l_linenumber WHEN 1 THEN 'Small' WHEN 2 THEN ' medium ' WHEN 3 THEN '' WHEN 4 THEN 'huge' WHEN 5 THEN NULL
              WHEN 6 THEN 'LARGE' ELSE 'bulky' END AS pack_t
  FROM lineitem JOIN part ON l_partkey = p_partkey),
b AS (SELECT row, {strip("COALESCE(sku_t, '')")} AS sku, {strip("COALESCE(name_t, '')")} AS name,
             {_py_int('qty_t')} AS q, {_py_float('price_t')} AS p,
             NULLIF({strip("COALESCE(sup_t, '')")}, '') AS supplier,
             lower({strip("COALESCE(pack_t, '')")}) AS rpack FROM b0),
v AS (SELECT row, sku, name, CAST(q AS BIGINT) AS quantity, p AS price, supplier,
             rpack <> '' AS pack_set,
             CASE WHEN rpack IN ('small', 'medium', 'large', 'bulky', 'extra_bulky') THEN rpack END AS pack,
             CASE WHEN sku = '' OR name = '' THEN printf('Row %d: ''sku'' and ''name'' required.', row)
                  WHEN q IS NULL OR q < 0 THEN printf('Row %d (SKU %s): invalid ''quantity'' (>=0).', row, sku)
                  WHEN p IS NULL OR NOT (p > 0 AND NOT isnan(p)) THEN printf('Row %d (SKU %s): invalid ''price'' (>0).', row, sku)
             END AS error
      FROM b),
valid AS (SELECT * FROM v WHERE error IS NULL),
sn AS (SELECT supplier, min(row) AS first FROM valid WHERE supplier IS NOT NULL GROUP BY supplier),
sj AS (SELECT sn.*, s.id AS sid FROM sn LEFT JOIN suppliers s ON s.name = sn.supplier),
snew AS (SELECT supplier, (SELECT COALESCE(max(id), 0) FROM suppliers) + row_number() OVER (ORDER BY first, supplier) AS nid
         FROM sj WHERE sid IS NULL),
sids AS (SELECT sj.supplier, COALESCE(sj.sid, snew.nid) AS supplier_id FROM sj LEFT JOIN snew ON sj.supplier = snew.supplier),
vv AS (SELECT valid.*, sids.supplier_id FROM valid LEFT JOIN sids ON valid.supplier = sids.supplier),
pj AS (SELECT vv.*, p.id AS eid, p.name AS ename, p.price AS eprice, p.supplier_id AS esup, p.pack_size AS epack,
              min(vv.row) OVER (PARTITION BY vv.sku) AS first
       FROM vv LEFT JOIN products p ON p.sku = vv.sku),
per AS (SELECT sku, any_value(eid) AS eid, any_value(ename) AS ename, any_value(eprice) AS eprice,
               any_value(esup) AS esup, any_value(epack) AS epack, min(row) AS first,
               arg_max({{'v': quantity}}, row).v AS q_last, arg_max({{'v': name}}, row).v AS name_last,
               arg_max({{'v': price}}, row).v AS price_last, arg_max({{'v': supplier_id}}, row).v AS sup_last,
               arg_min({{'v': name}}, row).v AS name_ins, arg_min({{'v': price}}, row).v AS price_ins,
               arg_min({{'v': supplier_id}}, row).v AS sup_ins,
               arg_max({{'v': pack}}, row) FILTER (WHERE pack_set OR (eid IS NULL AND row = first)).v AS pack_last,
               count(*) FILTER (WHERE pack_set OR (eid IS NULL AND row = first)) AS npack
        FROM pj GROUP BY sku),
pnew AS (SELECT sku, (SELECT COALESCE(max(id), 0) FROM products) + row_number() OVER (ORDER BY first, sku) AS nid
         FROM per WHERE eid IS NULL),
touched AS (
  SELECT COALESCE(per.eid, pnew.nid) AS id, per.sku,
         {attr(allow_name, 'name_last', 'ename', 'name_ins')} AS name, q_last AS quantity,
         {attr(allow_price, 'price_last', 'eprice', 'price_ins')} AS price,
         {attr(allow_supplier, 'sup_last', 'esup', 'sup_ins')} AS supplier_id,
         CASE WHEN npack > 0 THEN pack_last ELSE epack END AS pack_size
  FROM per LEFT JOIN pnew ON per.sku = pnew.sku),
result AS (
  SELECT id, sku, name, quantity, price, supplier_id, pack_size FROM products
  WHERE sku NOT IN (SELECT sku FROM per)
  UNION ALL SELECT * FROM touched)"""


@query("upsert_products", f"WITH {_import_sql()} SELECT * FROM result")
def upsert_products(spark, sf_dir):
    """DML-2/3: product import (validation, supplier creation, per-sku closed-form upsert)."""
    return _run_import(spark, sf_dir)[0]


@query("upsert_products_locked", f"WITH {_import_sql(False, False, False)} SELECT * FROM result")
def upsert_products_locked(spark, sf_dir):
    """DML-2 policy flags: name, price and supplier not updatable; quantity/pack still are."""
    pol = ImportPolicy(allow_update_name=False, allow_update_price=False, allow_update_supplier=False)
    return _run_import(spark, sf_dir, pol)[0]


@query("import_errors", f"WITH {_import_sql()} SELECT row, sku, error AS message FROM v WHERE error IS NOT NULL")
def import_errors(spark, sf_dir):
    """DML-3 rejects with their 1-based file row (WIN-4)."""
    return _run_import(spark, sf_dir)[2]


@query("import_new_suppliers", f"""WITH {_import_sql()}
SELECT nid AS id, supplier AS name, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS phone FROM snew""")
def import_new_suppliers(spark, sf_dir):
    """JN-18: suppliers created by the product import (ids after max id, first-appearance order)."""
    _, s, _, _ = _run_import(spark, sf_dir)
    base = X.book_suppliers(X.Tables(spark, sf_dir))
    return s.join(base.select("id"), "id", "left_anti")


@query("import_summary", f"""WITH {_import_sql()}
SELECT count(*) FILTER (WHERE row = first AND eid IS NULL) AS inserted,
       count(*) FILTER (WHERE NOT (row = first AND eid IS NULL)) AS updated,
       (SELECT count(*) FROM v WHERE error IS NOT NULL) AS errors
FROM pj""")
def import_summary(spark, sf_dir):
    """AGG-15: inserted / updated / error counts of the product import."""
    _, _, errors, log = _run_import(spark, sf_dir)
    return U.import_summary(log, errors)[0]


# ------------------------------------------------------------------------- supplier import

def supplier_batch(spark, sf_dir):
    """Supplier file rows: every supplier again (some emails blanked) followed by
    vendor rows per customer (new names repeated, a few blank names)."""
    t = X.Tables(spark, sf_dir)
    s = t.supplier.select(
        F.concat(F.lit(" "), F.col("s_name")).alias("name"),
        F.when(F.col("s_nationkey") % 2 == 0, F.lit(" ")).otherwise(
            F.concat(F.lit("new"), F.col("s_suppkey").cast("string"), F.lit("@mail.test"))).alias("email"),
        F.format_string("%d-555", F.col("s_suppkey")).alias("phone"),
        F.struct(F.lit(0).alias("src"), F.col("s_suppkey").alias("k")).alias("_ord"))
    c = t.customer.select(
        F.when(F.col("c_custkey") % 50 == 0, F.lit("")).otherwise(
            F.concat(F.lit("Vendor "), F.col("c_nationkey").cast("string"))).alias("name"),
        F.lower(F.col("c_name")).alias("email"),
        F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_custkey").cast("string")).alias("phone"),
        F.struct(F.lit(1).alias("src"), F.col("c_custkey").alias("k")).alias("_ord"))
    return U.number_rows(s.unionByName(c), "_ord", "row")


@query("upsert_suppliers", f"""WITH b0 AS (
  SELECT 0 AS src, s_suppkey AS k, ' ' || s_name AS name,
         CASE WHEN s_nationkey % 2 = 0 THEN ' ' ELSE 'new' || CAST(s_suppkey AS VARCHAR) || '@mail.test' END AS email,
         CAST(s_suppkey AS VARCHAR) || '-555' AS phone FROM supplier
  UNION ALL
  SELECT 1, c_custkey, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE 'Vendor ' || CAST(c_nationkey AS VARCHAR) END,
         lower(c_name), CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END FROM customer),
b AS (SELECT row_number() OVER (ORDER BY src, k) AS row, {strip('name')} AS name,
             NULLIF({strip('email')}, '') AS email, NULLIF({strip('phone')}, '') AS phone FROM b0),
valid AS (SELECT * FROM b WHERE name <> ''),
per AS (SELECT name, min(row) AS first, arg_max({{'e': email, 'p': phone}}, row) AS last FROM valid GROUP BY name),
j AS (SELECT per.*, s.s_suppkey AS eid FROM per LEFT JOIN supplier s ON s.s_name = per.name),
n AS (SELECT name, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY first, name) AS nid
      FROM j WHERE eid IS NULL)
SELECT s_suppkey AS id, s_name AS name, 's' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS email,
       printf('+61-%08d', s_suppkey) AS phone FROM supplier WHERE s_name NOT IN (SELECT name FROM per)
UNION ALL
SELECT COALESCE(j.eid, n.nid), j.name, j.last.e, j.last.p FROM j LEFT JOIN n ON j.name = n.name""")
def upsert_suppliers(spark, sf_dir):
    """DML-1: supplier upsert by name (last row wins, blank -> null, new ids after max id)."""
    ex = X.book_suppliers(X.Tables(spark, sf_dir))
    return U.upsert_suppliers(ex, supplier_batch(spark, sf_dir))[0]


# ------------------------------------------------------------------------- stock effects

_OPEN_ITEMS = """items i JOIN orders_b o ON o.id = i.order_id"""


@query("stock_ledger", f"""WITH {P_SQL},
d AS (SELECT i.product_id, sum(-i.quantity) AS d FROM {_OPEN_ITEMS} WHERE o.status <> 'Cancelled' GROUP BY i.product_id)
SELECT p.id, p.sku, p.name, CAST(p.quantity + COALESCE(d.d, 0) AS BIGINT) AS quantity, p.price, p.supplier_id, p.pack_size
FROM products p LEFT JOIN d ON d.product_id = p.id""")
def stock_ledger(spark, sf_dir):
    """DML-9: stock after deducting every line of non-cancelled orders."""
    t = X.Tables(spark, sf_dir)
    p, o, i = X.book_products(t), X.book_orders(t), X.book_items(t)
    open_ids = o.where(F.col("status") != "Cancelled").select(F.col("id").alias("_oid"))
    lines = i.join(open_ids, i["order_id"] == F.col("_oid"), "left_semi")
    return U.apply_stock_deltas(p, lines.select("product_id", (-F.col("quantity")).alias("delta")))


_STATUS_CTE = f"""{P_SQL},
ch AS (SELECT o.o_orderkey AS seq, o.o_orderkey AS order_id, b.status AS old,
              CASE o_orderpriority WHEN '2-HIGH' THEN 'Cancelled' WHEN '3-MEDIUM' THEN 'Pending' ELSE 'Bogus' END AS new_status
       FROM orders o JOIN orders_b b ON b.id = o.o_orderkey WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM', '5-LOW')),
ev AS (SELECT *, CASE WHEN new_status = 'Bogus' THEN 'X' WHEN new_status = 'Cancelled' AND old <> 'Cancelled' THEN 'K'
                      WHEN new_status <> 'Cancelled' AND old = 'Cancelled' THEN 'U' ELSE 'P' END AS st FROM ch),
dem AS (SELECT ev.seq, ev.st, i.product_id AS pid, CAST(sum(i.quantity) AS BIGINT) AS dq, max(i.quantity) AS maxq,
               CAST(min(p.quantity) AS BIGINT) AS stock
        FROM ev JOIN items i ON i.order_id = ev.order_id JOIN products p ON p.id = i.product_id WHERE ev.st IN ('K', 'U')
        GROUP BY ev.seq, ev.st, i.product_id),
rounds AS (
  SELECT 0 AS k, seq, st, pid, dq, maxq, stock FROM dem
  UNION ALL
  SELECT k + 1, seq, CASE WHEN st = 'U' AND bool_and(stock - most >= maxq) OVER (PARTITION BY seq) THEN 'A'
                          WHEN st = 'U' AND bool_or(stock - least < maxq) OVER (PARTITION BY seq) THEN 'R' ELSE st END,
         pid, dq, maxq, stock
  FROM (SELECT *, CAST(coalesce(sum(CASE st WHEN 'K' THEN -dq WHEN 'A' THEN dq ELSE 0 END) OVER before, 0) AS BIGINT) AS least,
               CAST(coalesce(sum(CASE st WHEN 'K' THEN -dq WHEN 'A' THEN dq WHEN 'U' THEN dq ELSE 0 END) OVER before, 0) AS BIGINT) AS most,
               bool_or(st = 'U') OVER () AS more
        FROM rounds WINDOW before AS (PARTITION BY pid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE more),
final AS (SELECT *, stock - CAST(coalesce(sum(CASE st WHEN 'K' THEN -dq WHEN 'A' THEN dq ELSE 0 END) OVER (
                        PARTITION BY pid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS avail
          FROM rounds WHERE k = (SELECT max(k) FROM rounds)),
short AS (SELECT f.seq, arg_min(f.pid, (i.line_no, i.product_id)) AS pid
          FROM final f JOIN ev ON ev.seq = f.seq JOIN items i ON i.order_id = ev.order_id AND i.product_id = f.pid
          WHERE f.st = 'R' AND f.avail < i.quantity GROUP BY f.seq),
log AS (SELECT ev.seq, order_id, new_status,
               CASE WHEN new_status = 'Bogus' THEN 'Invalid order status.'
                    WHEN short.seq IS NOT NULL THEN printf('Not enough stock to un-cancel. Product ID %d.', short.pid) END AS error
        FROM ev LEFT JOIN short ON short.seq = ev.seq)"""


def _status_changes(spark, sf_dir):
    from stockspark.operators.status import change_status
    t = X.Tables(spark, sf_dir)
    new = (F.when(F.col("o_orderpriority") == "2-HIGH", "Cancelled").when(F.col("o_orderpriority") == "3-MEDIUM", "Pending")
           .otherwise("Bogus"))
    ch = t.orders.where(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM", "5-LOW")).select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("order_id"), new.alias("new_status"))
    return change_status(X.book_products(t), X.book_orders(t), X.book_items(t), ch)


@query("status_change_stock", f"""WITH RECURSIVE {_STATUS_CTE}
SELECT p.id, p.sku, p.name, CAST(p.quantity - coalesce(m.taken, 0) AS BIGINT) AS quantity, p.price, p.supplier_id, p.pack_size
FROM products p LEFT JOIN (SELECT pid, sum(CASE st WHEN 'K' THEN -dq WHEN 'A' THEN dq ELSE 0 END) AS taken FROM final GROUP BY pid) m
     ON m.pid = p.id""")
def status_change_stock(spark, sf_dir):
    """DML-7: stock after 2-HIGH orders are cancelled and cancelled 3-MEDIUM orders reopened where stock allows."""
    return _status_changes(spark, sf_dir)[0]


@query("status_change_log", f"""WITH RECURSIVE {_STATUS_CTE}
SELECT seq, order_id, new_status, error IS NULL AS applied, error FROM log""")
def status_change_log(spark, sf_dir):
    """DML-7: every change with its refusal: unknown status, or the first product short of stock."""
    return _status_changes(spark, sf_dir)[2]


@query("status_change_orders", f"""WITH RECURSIVE {_STATUS_CTE}
SELECT o.id, coalesce(log.new_status, o.status) AS status FROM orders_b o LEFT JOIN log ON log.order_id = o.id AND log.error IS NULL""")
def status_change_orders(spark, sf_dir):
    """DML-7: order statuses after the granted changes."""
    return _status_changes(spark, sf_dir)[1].select("id", "status")


@query("delete_orders_restock", f"""WITH {P_SQL},
del AS (SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'),
d AS (SELECT i.product_id, sum(i.quantity) AS d FROM items i JOIN orders_b o ON o.id = i.order_id
      WHERE o.id IN (SELECT id FROM del) AND o.status <> 'Cancelled' GROUP BY i.product_id)
SELECT p.id, p.sku, p.name, CAST(p.quantity + COALESCE(d.d, 0) AS BIGINT) AS quantity, p.price, p.supplier_id, p.pack_size
FROM products p LEFT JOIN d ON d.product_id = p.id""")
def delete_orders_restock(spark, sf_dir):
    """DML-8: delete 1-URGENT orders with their items; restock unless Cancelled."""
    t = X.Tables(spark, sf_dir)
    p, o, i = X.book_products(t), X.book_orders(t), X.book_items(t)
    dele = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("order_id"))
    _, _, restock = U.delete_orders(o, i, dele)
    return U.apply_stock_deltas(p, restock)


@query("delete_orders_remaining", f"""WITH {P_SQL}
SELECT o.* FROM orders_b o WHERE o.id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def delete_orders_remaining(spark, sf_dir):
    """DML-8: orders left after the delete (anti join)."""
    t = X.Tables(spark, sf_dir)
    o, i = X.book_orders(t), X.book_items(t)
    dele = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("order_id"))
    return U.delete_orders(o, i, dele)[0]


@query("delete_products_refused", f"""WITH {P_SQL}
SELECT p.id AS _pid FROM products p WHERE p.quantity = 0 AND EXISTS (SELECT 1 FROM items i WHERE i.product_id = p.id)""")
def delete_products_refused(spark, sf_dir):
    """DML-10/JN-14: deleting out-of-stock products is refused for those referenced by order lines."""
    t = X.Tables(spark, sf_dir)
    p, i = X.book_products(t), X.book_items(t)
    _, refused = U.delete_products(p, i, p.where(F.col("quantity") == 0).select("id"))
    return refused


# ------------------------------------------------------------------------- quality / distinct

@query("mapping_quality", """
WITH a AS (SELECT 'warehouse' AS side, CAST(l_partkey AS VARCHAR) AS sku,
                  CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END AS acc,
                  CASE WHEN l_discount = 0 THEN 'x' WHEN l_discount = 0.1 THEN '-' || CAST(l_quantity AS VARCHAR)
                       ELSE CAST(l_quantity AS VARCHAR) END AS q
           FROM lineitem WHERE l_linestatus = 'O'
           UNION ALL
           SELECT 'ecommerce', CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_quantity AS VARCHAR)
           FROM lineitem WHERE l_linestatus = 'F'),
k AS (SELECT side, upper(trim(COALESCE(sku, 'nan'))) AS sk, upper(trim(COALESCE(acc, 'nan'))) AS ak, count(*) AS n
      FROM a GROUP BY ALL),
s AS (SELECT side, count(*) FILTER (WHERE sku IS NULL) AS null_sku, count(*) FILTER (WHERE acc IS NULL) AS null_account,
             count(*) FILTER (WHERE TRY_CAST(trim(q) AS DOUBLE) IS NULL) AS non_numeric_qty,
             count(*) FILTER (WHERE TRY_CAST(trim(q) AS DOUBLE) < 0) AS negative_qty
      FROM a GROUP BY side)
SELECT s.*, (SELECT count(*) FROM k WHERE k.side = s.side AND n > 1) AS duplicate_key_groups FROM s""")
def mapping_quality(spark, sf_dir):
    """AGG-14: per side null keys, duplicate key groups, non-numeric and negative quantities."""
    li = X.Tables(spark, sf_dir).lineitem
    wh = li.where(F.col("l_linestatus") == "O").select(
        F.col("l_partkey").cast("string").alias("sku"),
        F.when(F.col("l_tax") == 0, F.lit(None).cast("string")).otherwise(F.col("l_suppkey").cast("string")).alias("acc"),
        F.when(F.col("l_discount") == 0, F.lit("x"))
         .when(F.col("l_discount") == 0.1, F.concat(F.lit("-"), F.col("l_quantity").cast("string")))
         .otherwise(F.col("l_quantity").cast("string")).alias("q"))
    ec = li.where(F.col("l_linestatus") == "F").select(
        F.col("l_partkey").cast("string").alias("sku"), F.col("l_suppkey").cast("string").alias("acc"),
        F.col("l_quantity").cast("string").alias("q"))
    return Q.mapping_quality(wh, "sku", "acc", "q", "warehouse").unionByName(
        Q.mapping_quality(ec, "sku", "acc", "q", "ecommerce"))


@query("distinct_rows", """
SELECT DISTINCT COALESCE(CAST(l_suppkey AS VARCHAR), '') AS supplier, COALESCE(l_returnflag, '') AS return_flag,
       COALESCE(CASE WHEN l_tax = 0 THEN NULL ELSE l_linestatus END, '') AS line_status
FROM lineitem""")
def distinct_rows(spark, sf_dir):
    """AGG-18: distinct rows over the selected export columns, null treated as ''."""
    li = X.Tables(spark, sf_dir).lineitem
    sel = li.select(F.col("l_suppkey").cast("string").alias("supplier"), F.col("l_returnflag").alias("return_flag"),
                    F.when(F.col("l_tax") == 0, F.lit(None).cast("string")).otherwise(F.col("l_linestatus"))
                     .alias("line_status"))
    return Q.distinct_rows(sel, ["supplier", "return_flag", "line_status"])


@query("stock_ledger_stream", f"""WITH {P_SQL},
d AS (SELECT i.product_id, sum(-i.quantity) AS d FROM {_OPEN_ITEMS} WHERE o.status <> 'Cancelled' GROUP BY i.product_id)
SELECT p.id, p.sku, p.name, CAST(p.quantity + COALESCE(d.d, 0) AS BIGINT) AS quantity, p.price, p.supplier_id, p.pack_size
FROM products p LEFT JOIN d ON d.product_id = p.id""")
def stock_ledger_stream(spark, sf_dir):
    """STM-3: the ledger deltas as a stream with running totals in the state store;
    current stock = snapshot + totals (must equal the batch stock_ledger)."""
    import uuid
    from stockspark.session import checkpoint_dir
    from stockspark.streaming.ledger import apply_totals, run_ledger_stream
    t = X.Tables(spark, sf_dir)
    p, o, i = X.book_products(t), X.book_orders(t), X.book_items(t)
    open_ids = o.where(F.col("status") != "Cancelled").select(F.col("id").alias("_oid"))
    deltas = i.join(open_ids, i["order_id"] == F.col("_oid"), "left_semi") \
              .select("product_id", (-F.col("quantity")).cast("bigint").alias("delta"))
    work = f"{checkpoint_dir(spark).rstrip('/')}/streams/ledger-{uuid.uuid4().hex}"
    totals = run_ledger_stream(deltas, work)
    out = apply_totals(p, totals)
    return out.select("id", "sku", "name", F.col("quantity").cast("bigint").alias("quantity"), "price",
                      "supplier_id", "pack_size")
