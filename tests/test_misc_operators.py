"""Smaller operators: sorts, paging, view filters, exports, table helpers."""
import os

import pytest
from pyspark.sql import functions as F

from stockspark.functions.numeric import money
from stockspark.operators import compare as C
from stockspark.operators import quality as Q
from stockspark.operators import upsert as U
from stockspark.operators.ordering import keyset_page, numeric_first_sort_key, page, typed_sort_key
from stockspark.sinks import clean_export, rounded_view, write_subsets
from stockspark.sources import carriers, preview, read_table, settings_defaults
from stockspark.sources.tables import PRODUCTS


def test_typed_sorts(spark):
    df = spark.createDataFrame([("1,000",), ("20",), ("3",)], "v string")
    assert [r[0] for r in df.orderBy(*typed_sort_key(df, "v")).collect()] == ["3", "20", "1,000"]
    mixed = spark.createDataFrame([("b",), ("",), ("A",), ("10",)], "v string")
    assert [r[0] for r in mixed.orderBy(*typed_sort_key(mixed, "v")).collect()] == ["10", "A", "b", ""]
    assert [r[0] for r in mixed.orderBy(*numeric_first_sort_key("v")).collect()][0] == "10"
    m = spark.createDataFrame([("$1,200.50",), ("$99",), ("abc",)], "p string")
    assert [r[0] for r in m.orderBy(money("p").asc_nulls_last()).collect()] == ["$99", "$1,200.50", "abc"]


def test_paging(spark):
    df = spark.range(1, 501).withColumnRenamed("id", "k")
    assert [r[0] for r in page(df, ["k"], offset=10, limit=5).collect()] == [11, 12, 13, 14, 15]
    for bad in (dict(offset=0, limit=10_000), dict(offset=0, limit=0), dict(offset=-1, limit=5)):   # refused, not clamped
        with pytest.raises(ValueError):
            page(df, ["k"], **bad)
    assert [r[0] for r in keyset_page(df, "k", 495, limit=50).collect()] == [496, 497, 498, 499, 500]


def test_view_filter_v3(spark):
    r = spark.createDataFrame([(12, "AbC", "Matched"), (3, "x.c", "Only in A"), (31, "abd", "Mismatched")],
                              "vendor_id long, sku string, Status string")
    assert C.view_filter_v3(r, vendor="1").count() == 2
    assert C.view_filter_v3(r, sku="b.").count() == 2                # regex: '.' matches any char
    assert C.view_filter_v3(r, sku="x.c", regex=False).count() == 1
    assert C.view_filter_v3(r, status="Matched", sku="abc").count() == 1


def test_exports(spark, tmpdir_path):
    df = spark.createDataFrame([("﻿A’s ", 2.5, "x"), ("B", 3.5, "y")], "Name string, Qty double, Extra string")
    assert [tuple(r) for r in rounded_view(df).select("Qty").collect()] == [(2,), (4,)]
    ce = clean_export(df, ["name", "qty", "missing"])
    assert ce.columns == ["name", "qty", "missing"] and ce.first()["name"] == "A's"
    write_subsets(df, os.path.join(tmpdir_path, "subsets"), {"all": None, "big": F.col("Qty") > 3})
    back = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "subsets", "big"))
    assert back.count() == 1


def test_table_helpers(spark, tmpdir_path):
    old = spark.createDataFrame([(1, "S1", "n", 2, 1.0, None)],
                                "id long, sku string, name string, quantity int, price double, supplier_id long")
    path = os.path.join(tmpdir_path, "products")
    old.write.parquet(path)
    t = read_table(spark, path, PRODUCTS)
    assert t.columns == [f.name for f in PRODUCTS.fields] and t.first()["pack_size"] is None
    assert U.add_missing_columns(old, {"pack_size": "string"}).columns[-1] == "pack_size"
    existing = spark.createDataFrame([("freight_rate_small", "7.5")], "key string, value string")
    seeded = {r["key"]: r["value"] for r in U.seed_defaults(existing, settings_defaults(spark)).collect()}
    assert seeded["freight_rate_small"] == "7.5" and seeded["freight_rate_large"] == "20.0"
    assert carriers(spark).count() == 3


def test_deletes_and_patches(spark):
    sups = spark.createDataFrame([(1, "a", None, None), (2, "b", None, None)], "id long, name string, email string, phone string")
    prods = spark.createDataFrame([(1, "P1", 2), (2, "P2", 1)], "id long, sku string, supplier_id long")
    s2, p2 = U.delete_suppliers(sups, prods, spark.createDataFrame([(1,)], "id long"))
    assert s2.count() == 1 and {r["sku"]: r["supplier_id"] for r in p2.collect()} == {"P1": 2, "P2": None}
    stock = spark.createDataFrame([("A", 5), ("B", 1)], "sku string, stock int")
    patches = spark.createDataFrame([("A", 3, 1), ("A", 9, 2), ("B", -1, 1), ("Z", 1, 1)], "sku string, stock int, _ord int")
    new, rej = U.patch_stock(stock, patches)
    assert {r["sku"]: r["stock"] for r in new.collect()} == {"A": 9, "B": 1}
    assert sorted(r["sku"] for r in rej.collect()) == ["B", "Z"]


def test_quality_helpers(spark):
    a = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), (None, 3, "z")], "k string, _ord int, v string")
    firsts = {r["k"]: r["v"] for r in Q.first_occurrence(a, ["k"]).collect()}
    assert firsts == {"k": "x", "": "z"}
    c = {r["side"]: r["rows"] for r in Q.side_counts(wh=a, ec=a.limit(1)).collect()}
    assert c == {"wh": 3, "ec": 1}
    assert [r["v"] for r in preview(a, 2).collect()] == ["x", "y"]
