"""File sources on awkward files: wide headers, late bytes, quoted line ends, long lines."""
import os
import tempfile

import pytest

from stockspark.sources import columns_and_count, read_snapshot, read_with_header_row, sniff_csv_meta


def put(data: bytes) -> str:
    path = os.path.join(tempfile.mkdtemp(), "f.csv")
    with open(path, "wb") as f:
        f.write(data)
    return path


def cells(df):
    return sorted(tuple("" if v is None else v for v in r)[:-1] for r in df.collect())


def test_wide_header(spark):
    head = ",".join(f"column_with_a_long_name_{i}" for i in range(6000))
    path = put((head + "\n" + "\n".join(",".join(f"{r}" for _ in range(6000)) for r in range(3))).encode())
    df = read_snapshot(spark, path)
    assert len(df.columns) == 6001 and [r[0] for r in df.orderBy("_ord").collect()] == ["0", "1", "2"]


def test_encoding_is_decided_by_the_whole_file(spark):
    body = "sku,name\n" + "A,plain\n" * 3000
    assert sniff_csv_meta(spark, put(body.encode()))["encoding"] == "UTF-8"
    late = read_snapshot(spark, put(body.encode() + "B,Café\n".encode("cp1252")))
    assert late.where("sku = 'B'").first()["name"] == "Café"
    assert sniff_csv_meta(spark, put(body.encode() + b"B,\x81\xe9\n"))["encoding"] == "ISO-8859-1"


def test_quoted_line_ends(spark):
    path = put(b'sku,note,qty\nA,"two\nlines",5\nB,"say ""hi""",6\n')
    with pytest.raises(ValueError, match="multi_line"):
        read_snapshot(spark, path)
    assert cells(read_snapshot(spark, path, multi_line=True)) == [("A", "two\nlines", "5"), ("B", 'say "hi"', "6")]
    quoted = put(b'"a\nb",c\n1,2\n')
    assert cells(read_snapshot(spark, quoted, multi_line=True)) == [("1", "2")]


def test_long_lines_go_and_short_lines_stay(spark):
    path = put(b'a,b,c\nA,1,5\nB,2,6,\nC,3\nD,"x,y",7\nE,2,6,,X\nF,,\n')
    assert cells(read_snapshot(spark, path)) == [("A", "1", "5"), ("C", "3", ""), ("D", "x,y", "7"), ("F", "", "")]
    assert columns_and_count(spark, path) == (["a", "b", "c"], 6)


def test_header_row_far_down(spark):
    lead = b"".join(b"# note %d with some words in it to fill the line\n" % i for i in range(3000))
    df = read_with_header_row(spark, put(lead + b"a,b\n1,2\n3,4,5\n"), 3000)
    assert cells(df) == [("1", "2")]
