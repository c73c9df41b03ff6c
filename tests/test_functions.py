"""Scalar functions: every trap listed for normalisation and number parsing."""
import math

from pyspark.sql import functions as F

from stockspark.config import Normalization
from stockspark.functions import (coerce_numeric, composite_key, normalize_piece, split_sku, to_int_safe,
                                  whole_number, guess_column, snake_case, normalize_header, clean_value)
from stockspark.functions.numeric import py_float, py_int


def col1(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_normalize_piece_traps(spark):
    n = Normalization(case="lower", trim=True, collapse_spaces=True, zero_pad=5)
    vals = ["  Ab\tC ", " X ", "a  b", "ẞig", "123", "1234567", "00042", None, "12a"]
    got = col1(spark, vals, lambda c: normalize_piece(c, n))
    assert got == ["ab c", "x", "a b", "ßig", "00123", "1234567", "00042", "", "12a"]


def test_normalize_upper_asis_and_null_token(spark):
    up = Normalization(case="upper", trim=True, collapse_spaces=False, null_token="nan")
    assert col1(spark, [" ab  c ", None], lambda c: normalize_piece(c, up)) == ["AB  C", "NAN"]
    asis = Normalization(case="asis", trim=False, collapse_spaces=True)
    assert col1(spark, [" a  B "], lambda c: normalize_piece(c, asis)) == [" a B "]


def test_composite_key_missing_and_blank(spark):
    df = spark.createDataFrame([("A ", None), ("", "")], "a string, b string")
    n = Normalization()
    got = [r[0] for r in df.select(composite_key(df, ["a", "b", "zz"], n)).collect()]
    assert got == ["a|", "|"]          # a 2-column blank key is the bare separator
    got = [r[0] for r in df.select(composite_key(df, ["zz"], n)).collect()]
    assert got == ["", ""]


def test_coerce_numeric_edge_cells(spark):
    vals = ["", "abc", " 5 ", "1,000", "1e3", "-2.5", "5d", "inf", "nan", None, "0x10", "1_000"]
    got = col1(spark, vals, coerce_numeric)
    assert got[:7] == [0.0, 0.0, 5.0, 0.0, 1000.0, -2.5, 0.0]
    assert math.isinf(got[7]) and got[8] == 0.0 and got[9] == 0.0 and got[10] == 0.0 and got[11] == 0.0


def test_to_int_safe(spark):
    vals = ["12.9", "-2.5", " 5 ", "1_000", "inf", "nan", "abc", "", None, "1e3"]
    assert col1(spark, vals, to_int_safe) == [12, -2, 5, 1000, 0, 0, 0, 0, 0, 1000]


def test_whole_number_rules(spark):
    vals = ["0.5", "1.5", "2.5", "-1.5", "-0.5", "x", "3"]
    assert col1(spark, vals, lambda c: whole_number(c, "round")) == [0, 2, 2, -2, 0, 0, 3]
    assert col1(spark, vals, lambda c: whole_number(c, "floor")) == [0, 1, 2, -2, -1, 0, 3]
    assert col1(spark, vals, lambda c: whole_number(c, "ceil")) == [1, 2, 3, -1, 0, 0, 3]
    assert col1(spark, vals, lambda c: whole_number(c, "round", True)) == [0, 2, 2, 0, 0, 0, 3]


def test_py_int_py_float(spark):
    assert col1(spark, ["5", " 7 ", "5.0", "-1", "", None, "1_0"], py_int) == [5, 7, None, -1, 0, 0, 10]
    got = col1(spark, ["1.5", "abc", "", "inf", "1e2"], py_float)
    assert got[0] == 1.5 and got[1] is None and got[2] == 0.0 and math.isinf(got[3]) and got[4] == 100.0


def test_split_sku(spark):
    assert col1(spark, [" AB | 12 ", "NOPIPE", "|x"], split_sku) == ["AB", "NOPIPE", ""]


def test_names():
    assert snake_case("Free Stock (TGT)") == "free_stock_tgt"
    assert normalize_header("﻿Customer Name") == "customer_name"
    assert guess_column(["Item Code", "Qty"], "sku") == "Item Code"
    assert guess_column(["x", "On-Hand"], "qty") == "On-Hand"
    assert guess_column(["a", "b"], "account") == "a"


def test_clean_value(spark):
    got = col1(spark, ["﻿ ‘hi’ – x "], clean_value)
    assert got == ["'hi' - x"]


def test_casefold_option(spark):
    n = Normalization(case="casefold")
    assert col1(spark, ["Straße ", "ABC"], lambda c: normalize_piece(c, n)) == ["strasse", "abc"]
