"""Declared constraints, unlike files, named files, table generations, long cells."""
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockspark.functions.numeric import py_float, py_int, to_int_safe
from stockspark.operators import constraints as R
from stockspark.operators.constraints import CASCADE, RESTRICT, SET_NULL, Constraints, ForeignKey
from stockspark.sinks.writers import write_named_chunks, write_single_file
from stockspark.sources.files import folder_formats, read_mixed_folder
from stockspark.sources.tables import read_generations


def test_violations(spark):
    tables = {"a": spark.createDataFrame([(1, "x", 3), (2, "x", -1), (3, None, None), (4, "y", 0)], "id long, k string, q int"),
              "b": spark.createDataFrame([(1, 1), (2, 9), (3, 9), (4, None)], "id long, a_id long")}
    rules = Constraints(required={"a": ["k"]}, unique={"a": ["k"]}, checks={"a": {"q >= 0": "q >= 0"}}, foreign=(ForeignKey("b", "a_id", "a"),))
    assert sorted(map(tuple, R.violations(tables, rules).collect())) == [
        ("a", "k required", "3", 1), ("a", "k unique", "x", 2), ("a", "q >= 0", "2", 1), ("b", "a_id refers to a", "9", 2)]
    with pytest.raises(ValueError):
        R.violations({"a": tables["a"]}, Constraints())


def loop_delete(tables, keys, requests):
    """Each request on its own: what goes with it; refused if a restricted row refers to any of that."""
    def goes(name, i):
        seen, todo = set(), [(name, i)]
        while todo:
            t, k = todo.pop()
            if (t, k) in seen:
                continue
            seen.add((t, k))
            todo += [(fk.table, r["id"]) for fk in keys if fk.parent == t and fk.on_delete == CASCADE for r in tables[fk.table] if r[fk.column] == k]
        return seen

    gone, refused = set(), set()
    for name, i in requests:
        if not any(r["id"] == i for r in tables[name]):
            continue
        mine = goes(name, i)
        if any(fk.on_delete == RESTRICT and (fk.parent, r[fk.column]) in mine for fk in keys for r in tables[fk.table]):
            refused.add((name, i))
        else:
            gone |= mine
    out = {}
    for name, rows in tables.items():
        out[name] = sorted(str([None if any(fk.table == name and fk.column == c and fk.on_delete == SET_NULL and (fk.parent, v) in gone for fk in keys) else v
                                for c, v in r.items()]) for r in rows if (name, r["id"]) not in gone)
    return out, refused


@pytest.mark.parametrize("seed", [1, 2])
def test_deletes_follow_the_foreign_keys(spark, seed):
    r = random.Random(seed)
    ref = lambda n: r.choice([None, *range(1, n + 1)])
    tables = {"p": [{"id": i, "boss": ref(12) if i > 6 else None} for i in range(1, 13)], "q": [{"id": i, "p_id": ref(12)} for i in range(1, 21)],
              "s": [{"id": i, "q_id": ref(20), "p_id": ref(12)} for i in range(1, 21)], "t": [{"id": i, "q_id": r.randint(1, 20)} for i in range(1, 4)]}
    keys = (ForeignKey("p", "boss", "p", CASCADE), ForeignKey("q", "p_id", "p", CASCADE), ForeignKey("s", "q_id", "q", CASCADE),
            ForeignKey("s", "p_id", "p", SET_NULL), ForeignKey("t", "q_id", "q", RESTRICT))
    asked = {"p": [1, 3, 7, 99], "q": [2, 4], "t": [1]}
    frames = {n: spark.createDataFrame([tuple(x.values()) for x in rows], ", ".join(f"{c} long" for c in rows[0])) for n, rows in tables.items()}
    new, refused = R.delete_rows(frames, Constraints(foreign=keys), {n: spark.createDataFrame([(i,) for i in ids], "id long") for n, ids in asked.items()})
    want, want_refused = loop_delete(tables, keys, [(n, i) for n, ids in asked.items() for i in ids])
    assert {tuple(x) for x in refused.collect()} == want_refused
    assert {n: sorted(str(list(x)) for x in df.collect()) for n, df in new.items()} == want


def put(folder, name, data):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)


def test_unlike_files_of_a_folder(spark, tmpdir_path):
    put(tmpdir_path, "a b.csv", "﻿SKU,Qty\nA,1\nB,2\n".encode())
    put(tmpdir_path, "c+d.csv", "Qty;SKU;Note\n3;C;café\n".encode("cp1252"))
    put(tmpdir_path, "e%20f.csv", "SKU|Price\nD|4|extra\nE|5\n".encode())
    put(tmpdir_path, "g.csv", "SKU\tQty\nF\t€6\n".encode("cp1252"))
    put(tmpdir_path, "h.csv", "SKU,Qty\nG,7\n".encode())
    put(tmpdir_path, "empty.csv", b"")
    rows = read_mixed_folder(spark, tmpdir_path, ["SKU", "Qty", "Note", "Price"])
    assert sorted(map(str, (tuple(r)[:4] for r in rows.collect()))) == sorted(map(str, [
        ("A", "1", None, None), ("B", "2", None, None), ("C", "3", "café", None), ("E", None, None, "5"), ("F", "€6", None, None), ("G", "7", None, None)]))
    assert sorted(f["sep"] for f in folder_formats(spark, tmpdir_path)) == sorted([",", ";", "|", "\t"])  # files of one format are read together
    with pytest.raises(ValueError):
        read_mixed_folder(spark, tmpdir_path, ["Nothing"])


def test_named_files(spark, tmpdir_path, monkeypatch):
    rows = spark.range(0, 25).select("id", (F.col("id") + 1).alias("row_num"), F.floor(F.col("id") / 10).alias("chunk_id"))
    assert sorted(write_named_chunks(rows, tmpdir_path, "x", ["id"])) == ["x_part0.csv", "x_part1.csv", "x_part2.csv"]
    assert sorted(write_named_chunks(rows, tmpdir_path, "x", ["id"], date_tag="20240131", bom=True)) == [f"x_20240131_{k}.csv" for k in range(3)]
    read = lambda n: open(os.path.join(tmpdir_path, n), "rb").read()
    assert read("x_part2.csv") == b"id\n20\n21\n22\n23\n24\n"
    assert read("x_20240131_0.csv").startswith(b"\xef\xbb\xbfid\n0\n")
    with pytest.raises(FileExistsError):
        write_named_chunks(rows, tmpdir_path, "x", ["id"])
    broken = rows.withColumn("id", F.when(F.col("id") < 24, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")))
    with pytest.raises(Exception, match="broken"):
        write_named_chunks(broken, tmpdir_path, "y", ["id"])
    write_single_file(rows.select("id"), f"{tmpdir_path}/one.csv", bom=True)
    write_single_file(rows.select("id").limit(2).orderBy("id"), f"{tmpdir_path}/one.csv")
    assert read("one.csv") == b"id\n0\n1\n"
    left = [n for n in os.listdir(tmpdir_path) if not n.endswith(".crc")]
    assert sorted(left) == sorted(["one.csv", *(f"x_part{k}.csv" for k in range(3)), *(f"x_20240131_{k}.csv" for k in range(3))])


def test_generations(spark, tmpdir_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("size", T.StringType())])
    spark.createDataFrame([(1, "a")], "id int, title string").write.parquet(tmpdir_path + "/1")
    spark.createDataFrame([(2, "b", 7)], "id long, name string, size int").write.parquet(tmpdir_path + "/2")
    spark.createDataFrame([(3.5,)], "id double").write.parquet(tmpdir_path + "/3")
    got = read_generations(spark, [tmpdir_path + "/1", tmpdir_path + "/2"], schema, {"title": "name"}, {"size": "s"})
    assert sorted(map(tuple, got.collect())) == [(1, "a", "s"), (2, "b", "7")] and got.schema == schema
    with pytest.raises(ValueError):
        read_generations(spark, [tmpdir_path + "/3"], schema)


def test_long_cells(spark):
    long = "1" * 1_000_000
    df = spark.createDataFrame([(long,), ("1_" * 500_000 + "1",), (long + "x",), ("-1_0.5e1",), ("1__0",)], "s string")
    assert [tuple(r) for r in df.select(to_int_safe("s"), py_int("s")).collect()] == [(0, None), (0, None), (0, None), (-105, None), (0, None)]
    assert [r[0] for r in df.select(py_float("s")).collect()] == [float("inf"), float("inf"), None, -105.0, None]
