"""Order documents (DML-11, DML-12, PRJ-6/7, JN-15): ingest nested order
documents into the flat order/item tables, and patch product attributes.

A whole batch of documents is one job: references already in the table or
repeated earlier in the batch are rejected (the API answers 409 per
request), defaults are filled, the address and retailer structs are
flattened, and new ids continue after max(id) in batch order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockspark.functions.keys import strip_ws
from stockspark.operators.ordering import global_row_number
from stockspark.operators.upsert import reject_known

# order fields carried as given; absent ones are null
ORDER_EXTRAS = ("test_flag", "subtotal", "tax", "total", "supplier", "retailer")
ADDRESS_FIELDS = ("country", "line_1", "line_2", "city", "postal_code", "state", "phone", "full_name", "email")


def ingest_order_documents(existing: DataFrame, docs: DataFrame, run_ts: str, order_col: str = "_ord",
                           default_currency: str = "AUD"):
    """Returns (orders, items, rejects).

    existing: id, order_reference. docs: order_reference, order_date, status,
    comment, currency_code, shipping_address struct, retailer_data struct,
    items array<struct>, plus the batch order column.
    """
    known = existing.select("id", "order_reference")
    _, rejects = reject_known(known, docs, "order_reference", order_col)
    base = int(existing.agg(F.max("id")).first()[0] or 0)  # one number
    # judged and numbered by reference and order alone; the documents with their items move once,
    # to their numbers. Documents alike in both are told apart by a count.
    at = ["order_reference", order_col]
    copy = F.row_number().over(Window.partitionBy(*at).orderBy(*at))
    accepted, _ = reject_known(known, docs.select(*at), "order_reference", order_col)
    number = global_row_number(accepted, [order_col], "_n").withColumn("_copy", copy)
    numbered = (docs.withColumn("_copy", copy).join(number, [*at, "_copy"])
                .withColumn("_max", F.lit(base).cast("bigint")))
    def opt(c: str):
        return F.col(c) if c in docs.columns else F.lit(None).cast("string")
    sa = F.col("shipping_address")
    flat = numbered.select(
        (F.col("_max") + F.col("_n")).alias("id"), "order_reference",
        F.coalesce(F.col("order_date"), F.to_timestamp(F.lit(run_ts))).alias("order_date"),
        F.coalesce(opt("status"), F.lit("ORDER")).alias("status"),
        F.coalesce(opt("comment"), F.lit("")).alias("comment"),
        F.coalesce(opt("currency_code"), F.lit(default_currency)).alias("currency_code"),
        *[opt(c).alias(c) for c in ORDER_EXTRAS],
        *[sa[f].alias(f"ship_{f}") for f in ADDRESS_FIELDS],
        F.col("retailer_data.name").alias("retailer_name"),
        F.col("items"))
    items = flat.select(F.col("id").alias("order_id"), F.posexplode("items").alias("_pos", "_it")) \
                .select("order_id", (F.col("_pos") + 1).alias("line_no"), "_it.*")
    return flat.drop("items"), items, rejects


def order_document_view(orders: DataFrame, items: DataFrame, item_cols) -> DataFrame:
    """PRJ-7 for flat orders: shipping_address null when every field is blank,
    retailer_data only when a name exists, items nested per order."""
    it = items.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in item_cols]))).alias("items"))
    fields = [F.col(f"ship_{f}").alias(f) for f in ADDRESS_FIELDS]
    any_set = F.lit(False)
    for f in ADDRESS_FIELDS:
        any_set = any_set | (F.coalesce(F.col(f"ship_{f}"), F.lit("")) != "")
    addr = F.when(any_set, F.struct(*fields))
    retailer = F.when(F.col("retailer_name").isNotNull() & (F.col("retailer_name") != ""),
                      F.struct(F.col("retailer_name").alias("name")))
    j = orders.join(it, orders["id"] == it["order_id"], "left")
    extras = [c for c in ORDER_EXTRAS if c in orders.columns]
    return j.select("id", "order_reference", "order_date", "status", "comment", "currency_code", *extras,
                    addr.alias("shipping_address"), retailer.alias("retailer_data"),
                    F.coalesce(F.col("items"), F.array().cast(it.schema["items"].dataType)).alias("items"))


def patch_article_ids(products: DataFrame, patches: DataFrame, order_col: str = "_ord"):
    """DML-12: external article id per sku, trimmed; each patch is judged on its own:
    unknown sku (404) and empty id (400) are rejected, the last valid one counts.
    Returns (products, rejects: the order column, sku, reason)."""
    named = patches.withColumn("_v", strip_ws(F.coalesce(F.col("sap_article_id").cast("string"), F.lit(""))))
    known = named.join(products.select(F.col("sku").alias("_k")), named["sku"] == F.col("_k"), "left")
    rejects = known.where(F.col("_k").isNull() | (F.col("_v") == "")).select(
        order_col, "sku", F.when(F.col("_k").isNull(), "Product not found").otherwise("sap_article_id cannot be empty")
        .alias("reason"))
    ok = named.where("_v <> ''").groupBy(F.col("sku").alias("_ps")).agg(F.max_by("_v", order_col).alias("_v"))
    j = products.join(ok, products["sku"] == F.col("_ps"), "left")
    return j.select(*[F.coalesce(F.col("_v"), F.col(c)).alias(c) if c == "sap_article_id" else F.col(c)
                      for c in products.columns]), rejects
