"""Order documents: ingest, nesting view, article-id patches."""
import datetime as dt

from pyspark.sql import functions as F

from stockspark.operators import documents as D
from stockspark.sources.tables import ORDER_DOC


def test_ingest_and_view(spark):
    addr = ("AU", "", None, None, None, None, None, None, None)
    blank = ("", "", None, None, None, None, None, None, None)
    item = (None, None, None, "1", 2, "n", None, None, None, None, None, None, None, None)
    rows = [
        {"order_reference": "R1", "shipping_address": dict(zip(D.ADDRESS_FIELDS, addr)), "items": [
            {"line_reference": "1", "quantity": 2, "name": "n"}]},
        {"order_reference": "R2", "order_date": dt.datetime(2024, 1, 2), "comment": "c",
         "shipping_address": dict(zip(D.ADDRESS_FIELDS, blank)), "items": []},
        {"order_reference": "R1", "items": []},
        {"order_reference": "R9", "items": []},
    ]
    df = spark.createDataFrame(rows, ORDER_DOC).withColumn("_ord", F.monotonically_increasing_id())
    existing = spark.createDataFrame([(5, "R9")], "id long, order_reference string")
    orders, items, rejects = D.ingest_order_documents(existing, df.coalesce(1), "2026-01-01 00:00:00")
    o = {r["order_reference"]: r for r in orders.collect()}
    assert set(o) == {"R1", "R2"} and o["R1"]["id"] == 6 and o["R2"]["id"] == 7
    assert o["R1"]["status"] == "ORDER" and o["R1"]["currency_code"] == "AUD" and o["R1"]["comment"] == ""
    assert o["R1"]["order_date"] == dt.datetime(2026, 1, 1)
    assert sorted(r["reason"] for r in rejects.collect()) == ["duplicate in batch", "exists"]
    assert [(r["order_id"], r["line_no"], r["quantity"]) for r in items.collect()] == [(6, 1, 2)]
    view = {r["order_reference"]: r for r in D.order_document_view(
        orders, items, ["line_no", "quantity"]).collect()}
    assert view["R1"]["shipping_address"]["country"] == "AU"
    assert view["R2"]["shipping_address"] is None and view["R2"]["items"] == []


def test_patch_article_ids(spark):
    p = spark.createDataFrame([("A", "a", 1, None), ("B", "b", 2, "x")], "sku string, name string, stock int, "
                                                                      "sap_article_id string")
    patches = spark.createDataFrame([("A", " 77 ", 1), ("A", "78", 2), ("B", "  ", 1), ("Z", "1", 1)],
                                    "sku string, sap_article_id string, _ord int")
    new, rej = D.patch_article_ids(p, patches)
    assert {r["sku"]: r["sap_article_id"] for r in new.collect()} == {"A": "78", "B": "x"}
    assert sorted((r["sku"], r["reason"]) for r in rej.collect()) == [
        ("B", "sap_article_id cannot be empty"), ("Z", "Product not found")]
