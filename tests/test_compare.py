"""Comparison variants on hand-made snapshots with the edge rows of FIXTURES F1-F3."""
import pytest
from pyspark.sql import functions as F

from stockspark.config import Normalization, SideMapping
from stockspark.operators import compare as C
from stockspark.sources.files import sample_snapshots


def with_ord(df):
    return df.withColumn("_ord", F.monotonically_increasing_id())


def snap(spark, rows):
    return with_ord(spark.createDataFrame(rows, "sku string, store string, qty string").coalesce(1))


NORM = Normalization(case="lower", trim=True, collapse_spaces=True, zero_pad=4)
MAP = SideMapping(key_cols=("sku", "store"), qty_col="qty", norm=NORM)


def test_v1_semantics(spark):
    wh = snap(spark, [(" A1 ", "st 1", "5"), ("a1", "ST  1", "7"), ("12", "x", "abc"), ("b", None, "1"),
                      (None, None, "3"), ("only", "wh", " 2 ")])
    ec = snap(spark, [("A1", "st 1", "7"), ("0012", "X", "1e1"), ("b", None, "2"), ("e", "c", "-2.5")])
    rows = {r["key"]: r for r in C.compare_v1(wh, ec, MAP, MAP).collect()}
    assert rows["a1|st 1"]["wh_qty"] == 7.0 and rows["a1|st 1"]["diff"] == 0.0   # last row wins
    assert rows["0012|x"]["wh_qty"] == 0.0 and rows["0012|x"]["ec_qty"] == 10.0  # zero-pad, bad qty -> 0
    assert rows["b|"]["presence"] == "Both"
    assert rows["|"]["presence"] == "Only in Warehouse"     # 2-column blank key is kept
    assert rows["only|wh"]["presence"] == "Only in Warehouse"
    assert rows["e|c"]["presence"] == "Only in Ecommerce" and rows["e|c"]["diff"] == 2.5
    # presence-specific plans give the same partition of rows
    total = len(rows)
    parts = sum(C.compare_v1(wh, ec, MAP, MAP, presence=p).count() for p in (C.BOTH, C.ONLY_WH, C.ONLY_EC))
    assert parts == total
    assert sorted(C.union_compare_v1(wh, ec, MAP, MAP).collect()) == sorted(C.compare_v1(wh, ec, MAP, MAP).collect())


def test_v1_filters(spark):
    wh = snap(spark, [("a", "1", "5"), ("b", "1", "1"), ("c", "1", "3")])
    ec = snap(spark, [("a", "1", "5"), ("b", "1", "4")])
    r = C.compare_v1(wh, ec, MAP, MAP)
    assert {x["key"] for x in C.filter_result(r).collect()} == {"b|0001", "c|0001"}   # default hides matches
    assert {x["key"] for x in C.filter_result(r, diff_op=">", threshold=0).collect()} == {"c|0001"}
    assert {x["key"] for x in C.filter_result(r, presence=C.BOTH, diff_op=None).collect()} == {"a|0001", "b|0001"}


def test_v1_sample_template(spark):
    wh, ec = sample_snapshots(spark)
    m = SideMapping(key_cols=("SKU", "Store", "Bin"), qty_col="Quantity", norm=Normalization(case="asis"))
    r = C.compare_v1(with_ord(wh), with_ord(ec), m, m).collect()
    assert len(r) == 20 and all(x["presence"] == "Both" for x in r)
    d = {x["key"]: x["diff"] for x in r}
    # i = 1: SKU1001|ST02|A-01, wh 3, ec 2
    assert d["SKU1001|ST02|A-01"] == 1.0


def test_v2(spark):
    wh = with_ord(spark.createDataFrame([(" 1 ", "5"), ("2", "x"), (None, "9"), ("1", "6")], "id string, q string")
                  .coalesce(1))
    ec = with_ord(spark.createDataFrame([("1", "6"), ("2", "1"), ("3", "1")], "id string, q string").coalesce(1))
    r = {x["key"]: x for x in C.compare_v2(wh, ec, "id", "q", "id", "q").collect()}
    assert set(r) == {"1", "2"} and r["1"]["sign"] == "zero" and r["2"]["sign"] == "neg"
    assert {x["key"] for x in C.compare_v2(wh, ec, "id", "q", "id", "q", only_diffs=True).collect()} == {"2"}


def test_v3_mxn_and_strict(spark):
    a = spark.createDataFrame([("1", "s", "2"), ("1", "s", "3"), (None, None, None), ("2", "t", "1.9")],
                              "v string, sku string, q string")
    b = spark.createDataFrame([("1", "s", "2"), ("1", "s", "5"), ("3", "u", "4")], "v string, sku string, q string")
    r = C.compare_v3(a, b, ("v", "sku", "q"), ("v", "sku", "q")).collect()
    both = [x for x in r if x["vendor_id"] == 1]
    assert len(both) == 4                                # 2 x 2
    assert sum(x["Status"] == "Matched" for x in both) == 1
    nulls = [x for x in r if x["vendor_id"] == 0]
    assert nulls[0]["sku"] == "nan" and nulls[0]["Status"] == "Only in A"
    assert [x["qty_A"] for x in r if x["vendor_id"] == 2] == [1]
    stats = C.stats_v3(a, b, "sku", "sku", C.compare_v3(a, b, ("v", "sku", "q"), ("v", "sku", "q"))).first()
    assert stats["matched"] == 1 and stats["mismatched"] == 3 and stats["match_rate"] == 25.0
    assert stats["unique_skus_a"] == 2 and stats["rows_a"] == 4
    counts = [tuple(x) for x in C.status_counts_v3(C.compare_v3(a, b, ("v", "sku", "q"), ("v", "sku", "q")))
              .orderBy("pos").collect()]
    assert [c[1] for c in counts] == ["Matched", "Mismatched", "Only in A", "Only in B"]
    bad = spark.createDataFrame([("1", "s", "abc")], "v string, sku string, q string")
    with pytest.raises(Exception):
        C.compare_v3(bad, b, ("v", "sku", "q"), ("v", "sku", "q")).collect()


def test_v4_null_matches_null(spark):
    a = spark.createDataFrame([(None, "1", "5"), ("s", "1", "x"), ("s", "1", "3")], "sku string, acc string, q string")
    b = spark.createDataFrame([(None, "1", "5"), ("s", "1", "4"), ("s", "1", "3")], "sku string, acc string, q string")
    r = C.compare_v4(a, b, ("sku", "acc", "q"), ("sku", "acc", "q")).collect()
    assert len(r) == 3
    assert sum(x["status"] == "Match" for x in r) == 2
    k = C.kpis_v4(C.compare_v4(a, b, ("sku", "acc", "q"), ("sku", "acc", "q"))).first()
    assert k["total_matched"] == 3 and k["total_discrepancy"] == 1.0


@pytest.mark.parametrize("how,expect", [("sum", 0.0), ("max", None), ("first", None)])
def test_v5_all_null_group(spark, how, expect):
    a = with_ord(spark.createDataFrame([("k", "a", None), ("k", "a", "x")], "s string, a string, q string").coalesce(1))
    b = with_ord(spark.createDataFrame([("K ", "A", "1")], "s string, a string, q string"))
    na = C.normalize_v5(a, "s", "a", "q")
    nb = C.normalize_v5(b, "s", "a", "q")
    r = C.compare_v5(na, nb, how).first()
    assert r["present_wh"] == (expect is not None)
    assert r["qty_wh"] == 0.0 and r["source_status"] == ("Both" if expect is not None else "E-Commerce Only")


def test_v5_first_last_order(spark):
    a = with_ord(spark.createDataFrame([("k", "a", None), ("k", "a", "2"), ("k", "a", "3"), ("k", "a", None)],
                                       "s string, a string, q string").coalesce(1))
    na = C.normalize_v5(a, "s", "a", "q")
    assert C.aggregate_dupes(na, "first").first()["qty"] == 2.0
    assert C.aggregate_dupes(na, "last").first()["qty"] == 3.0
    assert C.aggregate_dupes(na, "sum").first()["qty"] == 5.0


def test_v5_rollup_matches_kpis(spark):
    a = with_ord(spark.createDataFrame([("1", "a", "1"), ("2", "a", "0"), ("3", "b", "4")], "s string, a string, q string"))
    b = with_ord(spark.createDataFrame([("1", "a", "1"), ("2", "a", "2"), ("4", "b", "4")], "s string, a string, q string"))
    m = C.compare_v5(C.normalize_v5(a, "s", "a", "q"), C.normalize_v5(b, "s", "a", "q"))
    k = C.kpis_v5(m).first()
    roll = C.rollup_by_account(m).collect()
    assert sum(r["matched"] for r in roll) == k["match_count"]
    assert sum(r["abs_diff_total"] for r in roll) == k["total_abs_diff"]


def test_v6_change_feed(spark):
    ec = with_ord(spark.createDataFrame([("A", "1", "5", ""), ("B", "1", "2.9", "SKU-B"), ("C", "1", "x", "SKU-C")],
                                        "k1 string, k2 string, q string, sku string").coalesce(1))
    wh = with_ord(spark.createDataFrame([("a ", "1", "5"), ("b", "1", "1"), ("d", "1", "4")],
                                        "k1 string, k2 string, q string").coalesce(1))
    r = {x["key"]: x for x in C.change_feed(ec, wh, ["k1", "k2"], "q", "sku", ["k1", "k2"], "q").collect()}
    sep = "⋮"
    assert set(r) == {f"b{sep}1", f"d{sep}1"}            # a matches, c is 0 on both sides
    assert r[f"b{sep}1"]["sku"] == "SKU-B" and r[f"b{sep}1"]["ec_qty"] == 2
    assert r[f"d{sep}1"]["sku"] == f"d{sep}1" and r[f"d{sep}1"]["ec_qty"] == 0
