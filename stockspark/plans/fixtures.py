"""Stand-in inputs built from the driver's tables.

These only shape rows into the schemas the operators expect (snapshot
columns as text, with the case/space noise and bad cells real files carry);
they do none of the operators' work. Every frame grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Total order of lineitem rows ("file order" of a snapshot built from it).
LI_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
            "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


class Tables:
    """Lazy parquet readers for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def li_ord() -> F.Column:
    return F.struct(*[F.col(c) for c in LI_ORDER]).alias("_ord")


def lineitem_part(t: Tables) -> DataFrame:
    """lineitem with the part attributes the snapshots use (Spark picks the join
    strategy from the measured size of part)."""
    part = t.part.select("p_partkey", "p_brand", "p_type")
    return t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))


# ---------------------------------------------------------------- V1 composite snapshots

def v1_warehouse(t: Tables) -> DataFrame:
    """Open lines: brand upper-cased with leading blanks and an inner blank,
    type lower-cased with a trailing tab, supplier as plain digits, quantity as text."""
    lp = lineitem_part(t).where(F.col("l_linestatus") == "O")
    return lp.select(
        F.concat(F.lit("  "), F.upper(F.regexp_replace("p_brand", "#", " #"))).alias("brand"),
        F.concat(F.lower("p_type"), F.lit("\t")).alias("type"),
        F.col("l_suppkey").cast("string").alias("supplier"),
        F.col("l_quantity").cast("string").alias("qty"),
        li_ord())


def v1_ecommerce(t: Tables) -> DataFrame:
    """Closed lines: brand with a doubled inner blank, type with a leading blank,
    supplier zero-padded to 5, quantity text "n/a" when there is no discount."""
    lp = lineitem_part(t).where(F.col("l_linestatus") == "F")
    return lp.select(
        F.regexp_replace("p_brand", "#", "  #").alias("brand"),
        F.concat(F.lit(" "), F.col("p_type")).alias("type"),
        F.format_string("%05d", F.col("l_suppkey")).alias("supplier"),
        F.when(F.col("l_discount") == 0, F.lit("n/a"))
         .otherwise(F.col("l_quantity").cast("string")).alias("qty"),
        li_ord())


# ---------------------------------------------------------------- order book tables

def book_products(t: Tables) -> DataFrame:
    """products(id, sku, name, quantity, price, supplier_id, pack_size) from part."""
    p = t.part
    pack = (F.when(F.col("p_type") == "SMALL", "small").when(F.col("p_type") == "MEDIUM", "medium")
            .when(F.col("p_type") == "LARGE", "large").when(F.col("p_type") == "PROMO", "bulky")
            .when(F.col("p_type") == "STANDARD", "extra_bulky"))
    return p.select(F.col("p_partkey").alias("id"),
                    F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
                    F.col("p_name").alias("name"), (F.col("p_size") % 12).cast("bigint").alias("quantity"),
                    F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 100).alias("supplier_id"),
                    pack.alias("pack_size"))


def book_suppliers(t: Tables) -> DataFrame:
    """suppliers(id, name, email, phone) from supplier."""
    s = t.supplier
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                    F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@example.com")).alias("email"),
                    F.format_string("+61-%08d", F.col("s_suppkey")).alias("phone"))


def book_orders(t: Tables) -> DataFrame:
    """orders(id, customer_name, order_date, status) from orders."""
    o = t.orders
    status = (F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "P", "Cancelled")
              .otherwise("Pending"))
    return o.select(F.col("o_orderkey").alias("id"),
                    F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("customer_name"),
                    F.col("o_orderdate").alias("order_date"), status.alias("status"))


def book_items(t: Tables) -> DataFrame:
    """order_items(order_id, line_no, product_id, quantity, price_at_order) from lineitem."""
    li = t.lineitem
    return li.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
                     F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"),
                     F.col("l_extendedprice").alias("price_at_order"))
