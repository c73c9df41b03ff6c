"""Order admission (DML-5) on orders x lineitem against part stock."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockspark.operators import admission as A
from stockspark.operators.upsert import number_rows
from stockspark.plans import fixtures as X
from stockspark.plans.catalog import query


def order_file(spark, sf_dir):
    """Order import rows (customer_name, order_date, status, items_json) in order-key order;
    items_json is built from the order's lineitems, with unknown skus, blank customers and
    non-list JSON mixed in."""
    t = X.Tables(spark, sf_dir)
    li = t.lineitem
    sku = F.when((F.col("l_linenumber") == 6) & (F.col("l_tax") == 0), F.lit("SKU-X")) \
           .otherwise(F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")))
    it = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("l_linenumber").alias("line"), sku.alias("product_sku"),
        F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").alias("price_at_order"))))
        .alias("items"))
    # numbered while the rows are narrow: the number needs the order keys only
    orders = number_rows(t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"), "o_orderkey", "row")
    o = orders.join(it, orders["o_orderkey"] == it["l_orderkey"], "left")
    items_json = (F.when(F.col("o_orderkey") % 101 == 0, F.lit("{}"))
                  .otherwise(F.coalesce(F.to_json("items"), F.lit("[]"))))
    return o.select(
        F.when(F.col("o_custkey") % 97 == 0, F.lit(" ")).otherwise(
            F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))).alias("customer_name"),
        F.col("o_orderdate").cast("string").alias("order_date"),
        F.when(F.col("o_orderstatus") == "P", "Cancelled").when(F.col("o_orderstatus") == "F", "Shipped")
         .otherwise("").alias("status"),
        items_json.alias("items_json"), F.col("o_orderkey").alias("_ord"), "row")


def stock(spark, sf_dir):
    p = X.Tables(spark, sf_dir).part
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
                    (F.col("p_size") * 8).cast("bigint").alias("quantity"))


# The same rule in SQL: every round, per product and in order sequence, what earlier orders
# have surely taken (lb) and may take at most (ub) decides those orders that it can.
_ADMIT_CTE = """
o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row FROM orders),
li AS (SELECT row, CASE WHEN l_linenumber = 6 AND l_tax = 0 THEN 'SKU-X' ELSE 'SKU-' || CAST(l_partkey AS VARCHAR) END AS sku,
              CAST(l_quantity AS BIGINT) AS qty,
              row_number() OVER (PARTITION BY row ORDER BY l_linenumber,
                  CASE WHEN l_linenumber = 6 AND l_tax = 0 THEN 'SKU-X' ELSE 'SKU-' || CAST(l_partkey AS VARCHAR) END,
                  CAST(l_quantity AS BIGINT), l_extendedprice) AS item
       FROM o JOIN lineitem ON l_orderkey = o_orderkey),
head AS (SELECT row, CASE WHEN o_custkey % 97 = 0 THEN '' ELSE 'Customer ' || CAST(o_custkey AS VARCHAR) END AS customer_name,
                CASE WHEN o_orderstatus = 'P' THEN 'Cancelled' ELSE 'Pending' END AS status,
                CASE WHEN o_custkey % 97 = 0 THEN printf('Row %d: customer_name required.', row)
                     WHEN o_orderkey % 101 = 0 OR row NOT IN (SELECT row FROM li)
                     THEN printf('Row %d: invalid items_json (items_json must be non-empty array).', row) END AS header_error
         FROM o),
prod AS (SELECT p_partkey AS pid, 'SKU-' || CAST(p_partkey AS VARCHAR) AS sku, CAST(p_size * 8 AS BIGINT) AS stock FROM part),
ln AS (SELECT li.*, pid, stock FROM li JOIN head USING (row) LEFT JOIN prod USING (sku) WHERE header_error IS NULL),
dem AS (SELECT pid, row, sum(qty) AS dq, max(qty) AS maxq, min(stock) AS stock,
               row IN (SELECT row FROM ln WHERE pid IS NULL) AS bad
        FROM ln WHERE pid IS NOT NULL GROUP BY pid, row),
rounds AS (
  SELECT 0 AS k, pid, row, CAST(dq AS BIGINT) AS dq, maxq, stock, CASE WHEN bad THEN 'R' ELSE 'U' END AS st FROM dem
  UNION ALL
  SELECT k + 1, pid, row, dq, maxq, stock,
         CASE WHEN st = 'U' AND bool_and(stock - ub >= maxq) OVER (PARTITION BY row) THEN 'A'
              WHEN st = 'U' AND bool_or(stock - lb < maxq) OVER (PARTITION BY row) THEN 'R' ELSE st END
  FROM (SELECT *, CAST(coalesce(sum(CASE WHEN st = 'A' THEN dq ELSE 0 END) OVER before, 0) AS BIGINT) AS lb,
               CAST(coalesce(sum(CASE WHEN st <> 'R' THEN dq ELSE 0 END) OVER before, 0) AS BIGINT) AS ub,
               bool_or(st = 'U') OVER () AS more
        FROM rounds WINDOW before AS (PARTITION BY pid ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE more),
final AS (SELECT *, stock - CAST(coalesce(sum(CASE WHEN st = 'A' THEN dq ELSE 0 END) OVER (
                        PARTITION BY pid ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS avail
          FROM rounds WHERE k = (SELECT max(k) FROM rounds)),
verdict AS (SELECT row, max(st) AS st FROM final GROUP BY row),
fails AS (SELECT ln.row, item, CASE WHEN ln.pid IS NULL THEN printf('Row %d item %d: unknown SKU ''%s''.', ln.row, item, sku)
                 ELSE printf('Row %d item %d: not enough stock for %s (avail %d).', ln.row, item, sku, avail) END AS msg
          FROM ln LEFT JOIN final ON final.pid = ln.pid AND final.row = ln.row WHERE ln.pid IS NULL OR avail < qty),
first_fail AS (SELECT row, arg_min(msg, item) AS msg FROM fails GROUP BY row)
"""


@query("order_admission", f"""WITH RECURSIVE {_ADMIT_CTE}
SELECT row, customer_name, status, coalesce(st = 'A', false) AS admitted,
       coalesce(header_error, CASE WHEN coalesce(st, 'R') <> 'A' THEN msg END) AS error
FROM head LEFT JOIN verdict USING (row) LEFT JOIN first_fail USING (row)""")
def order_admission(spark, sf_dir):
    """DML-5: sequential admission as a fix-point; one decision per order row."""
    dec, _ = A.admit(order_file(spark, sf_dir), stock(spark, sf_dir))
    return dec


@query("admission_stock", f"""WITH RECURSIVE {_ADMIT_CTE}
SELECT prod.pid AS id, prod.sku, CAST(prod.stock - coalesce(u, 0) AS BIGINT) AS quantity
FROM prod LEFT JOIN (SELECT pid, sum(dq) AS u FROM final WHERE st = 'A' GROUP BY pid) t USING (pid)""")
def admission_stock(spark, sf_dir):
    """DML-5: stock left after the admitted orders; never negative but for several lines of one order."""
    return A.admit(order_file(spark, sf_dir), stock(spark, sf_dir))[1]
