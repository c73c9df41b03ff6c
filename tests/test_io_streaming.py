"""File sources, sinks and the streaming jobs."""
import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from stockspark.config import Normalization
from stockspark.operators import importfile as I
from stockspark.operators.lifecycle import replay_commands
from stockspark.sinks import write_chunks
from stockspark.sources import read_snapshot, read_with_header_row, sniff_csv_meta, columns_and_count
from stockspark.sources.files import number_files
from stockspark.streaming import file_feed, ledger, lifecycle_stream


def write(path, text, enc="utf-8"):
    with open(path, "w", encoding=enc, newline="") as f:
        f.write(text)
    return path


def test_sniff_and_bad_lines(spark, tmpdir_path):
    clean = write(os.path.join(tmpdir_path, "clean.csv"), "﻿SKU;Store;Qty\nA;1;5\nD;4;7\n")
    meta = sniff_csv_meta(spark, clean)
    assert meta["sep"] == ";" and meta["header"] == ["SKU", "Store", "Qty"]
    p = write(os.path.join(tmpdir_path, "wh.csv"),
              "﻿SKU;Store;Qty\nA;1;5\nB;2;6;EXTRA\nC;3\nD;4;7\n")
    df = read_snapshot(spark, p, sep=";")
    rows = [(r["SKU"], r["Qty"]) for r in df.orderBy("_ord").collect()]
    assert rows == [("A", "5"), ("C", None), ("D", "7")]        # long line dropped, short kept
    hdr, n = columns_and_count(spark, clean)
    assert hdr == ["SKU", "Store", "Qty"] and n == 2


def test_cp1252_and_usecols(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "ec.csv"), "sku,name,qty\nA,Café,1\nB,,2\n", enc="cp1252")
    meta = sniff_csv_meta(spark, p)
    assert meta["encoding"] == "windows-1252"
    df = read_snapshot(spark, p, usecols=["name", "qty"], blanks_as_empty=True)
    assert [r["name"] for r in df.orderBy("_ord").collect()] == ["Café", ""]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<name:string,qty:string" in plan


def test_header_row_offset(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "x.csv"), "title line\n\nsku,qty\nA,1\nB,2\n")
    df = read_with_header_row(spark, p, 2, columns=["qty", "sku"])
    assert [tuple(r)[:2] for r in df.orderBy("_ord").collect()] == [("1", "A"), ("2", "B")]


def test_chunks_written(spark, tmpdir_path):
    rows = spark.range(0, 2500).select(F.format_string("S%04d", "id").alias("sku"), F.lit(1).alias("stock_status"),
                                       F.lit("pos_337").alias("source_code"), F.col("id").alias("qty"))
    numbered = I.assign_chunks(rows, ["sku"], 1000)
    out = os.path.join(tmpdir_path, "chunks")
    write_chunks(numbered, out, ["sku", "stock_status", "source_code", "qty"])
    dirs = sorted(os.path.basename(d) for d in glob.glob(out + "/chunk_id=*"))
    assert dirs == ["chunk_id=1", "chunk_id=2", "chunk_id=3"]
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 2500
    assert back.where("chunk_id = 3").count() == 500
    first = back.where("chunk_id = 1").agg(F.max("sku")).first()[0]
    assert first == "S0999"


def test_import_rows_and_stats(spark):
    df = spark.createDataFrame([("A | 1", "1.5"), ("B", "-2"), ("A|2", "0.5"), (" C |x", "abc")],
                               "key string, q string").withColumn("_ord", F.monotonically_increasing_id())
    rows = I.import_rows(df, "key", "q", "round", True).orderBy("_ord", "_src_pos").collect()
    assert [(r["sku"], r["qty"], r["stock_status"], r["source_code"]) for r in rows[:2]] == [
        ("A", 2, 1, "pos_337"), ("A", 2, 1, "src_virtualstock")]
    assert len(rows) == 8
    st = I.import_stats(I.import_rows(df, "key", "q", "round", True), 2).first()
    assert (st["total_skus"], st["in_stock"], st["out_of_stock"]) == (3, 1, 3)
    assert I.text_search(I.import_rows(df, "key", "q").drop("_ord"), "VIRTUAL").count() == 4


def test_file_feed_stream(spark, tmpdir_path):
    landing = os.path.join(tmpdir_path, "landing")
    ec = write(os.path.join(tmpdir_path, "ec1.csv"), "code,qty,sku\nA,5,SKU-A\nB,3,\n")
    wh = write(os.path.join(tmpdir_path, "wh1.csv"), "code,free\nA,5\nB,1\nC,2\n")
    file_feed.publish_snapshot(spark, landing, "ec", ec)
    file_feed.publish_snapshot(spark, landing, "wh", wh)
    out = os.path.join(tmpdir_path, "out")
    q = file_feed.start_change_feed(spark, landing, out, os.path.join(tmpdir_path, "ck"), ["code"], "qty", "sku",
                                    ["code"], "free", Normalization(), chunk_size=100, available_now=True)
    q.awaitTermination(120)
    res = spark.read.option("header", True).csv(glob.glob(out + "/batch=*")[0])
    got = sorted((r["sku"], r["qty"]) for r in res.collect())
    assert got == [("b", "3"), ("b", "3"), ("c", "0"), ("c", "0")]


def test_second_snapshot_is_compared_with_the_state(spark, tmpdir_path):
    landing, out, ck = (os.path.join(tmpdir_path, x) for x in ("landing", "out", "ck"))

    def run():
        file_feed.start_change_feed(spark, landing, out, ck, ["code"], "qty", "sku", ["code"], "free", Normalization(),
                                    chunk_size=100, available_now=True).awaitTermination(120)

    def rows(batch):
        df = spark.read.option("header", True).csv(os.path.join(out, f"batch={batch}"))
        return sorted({(r["sku"], r["qty"]) for r in df.collect()})

    wh = write(os.path.join(tmpdir_path, "wh1.csv"), "code,free\nA,5\nB,1\nC,2\nE,4\n")
    file_feed.publish_snapshot(spark, landing, "ec", write(os.path.join(tmpdir_path, "ec1.csv"), "code,qty,sku\nA,5,SKU-A\nB,3,\nD,7,\nE,4,\n"))
    file_feed.publish_snapshot(spark, landing, "wh", wh)
    run()
    first = max(int(d.split("=")[-1]) for d in glob.glob(out + "/batch=*"))
    assert rows(first) == [("b", "3"), ("c", "0"), ("d", "7")]
    os.remove(wh)  # the second run reads the new snapshot and the state only
    # A changes, B stays, C comes with the warehouse quantity, D and E go
    file_feed.publish_snapshot(spark, landing, "ec", write(os.path.join(tmpdir_path, "ec2.csv"), "code,qty,sku\nA,6,SKU-A\nB,3,\nC,2,\n"))
    run()
    second = max(int(d.split("=")[-1]) for d in glob.glob(out + "/batch=*"))
    assert second > first and rows(second) == [("SKU-A", "6"), ("e", "0")]
    state = file_feed.side_state(file_feed.TableSet(spark, out + "-state"), "ec")
    assert sorted((r.key, r.qty) for r in state.current().collect()) == [("a", 6), ("b", 3), ("c", 2)]


def test_a_new_snapshot_is_joined_with_the_state_once(spark, tmpdir_path, monkeypatch):
    written, materialize = [], file_feed.materialize
    monkeypatch.setattr(file_feed, "materialize", lambda df, *a: written.append(df.columns) or materialize(df, *a))
    new = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 3, "y"), ("e", None, "z")], "key string, qty long, sku string")
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "w"), ("d", 4, "v"), ("e", None, "z")], "key string, qty long, sku string")
    changed, gone = file_feed._difference(new, old)
    assert sorted(map(tuple, changed.collect())) == [("b", 2, None), ("c", 3, "y")] and [tuple(r) for r in gone.collect()] == [("d",)]
    assert len(written) == 1 and "Join" not in changed._jdf.queryExecution().executedPlan().toString()


def test_file_numbers_keep_the_order_of_paths(spark, tmpdir_path):
    for i, name in enumerate(["b 1", "a+é", "a", "Z", "b"]):
        write(os.path.join(tmpdir_path, f"{name}.csv"), f"k,v\nx,{i}\ny,{i}\n")
    rows = read_snapshot(spark, tmpdir_path)
    numbered = number_files(rows, tmpdir_path)
    assert [f.dataType.simpleString() for f in numbered.schema if f.name == "_ord"] == ["struct<f:int,b:bigint,i:bigint>"]
    order = lambda d: [(r.k, r.v) for r in d.orderBy("_ord").collect()]
    assert order(numbered) == order(rows) and len(order(rows)) == 10
    one = os.path.join(tmpdir_path, "a.csv")
    assert order(number_files(read_snapshot(spark, one), one)) == [("x", "2"), ("y", "2")]


def test_local_chunk_files_are_those_of_the_csv_writer(spark, tmpdir_path):
    cells = ["a,b", 'say "x"', "", None, "  lead ", "two\nlines", "cr\rx", "back\\s", "\\", "é⋮", "#c", "NULL"]
    rows = spark.createDataFrame([(i, s, k, None if i % 3 else i / 4) for i, (s, k) in enumerate((s, k) for s in cells for k in (1, 2, None, 2 ** 40))],
                                 "row_num long, `sku ,` string, chunk_id long, qty double")
    write_chunks(rows, f"{tmpdir_path}/now", ["sku ,", "qty"])
    (rows.repartition("chunk_id").sortWithinPartitions("chunk_id", "row_num").select("`sku ,`", "qty", "chunk_id")
     .write.partitionBy("chunk_id").option("header", True).csv(f"{tmpdir_path}/spark"))

    def files(side):
        return {os.path.relpath(os.path.dirname(f), f"{tmpdir_path}/{side}"): open(f, "rb").read() for f in glob.glob(f"{tmpdir_path}/{side}/*/*.csv")}
    assert files("now") == files("spark") and len(files("now")) == 4
    # no process and checksum file for each file, nothing left beside the result
    assert not glob.glob(f"{tmpdir_path}/now/*/.*") and sorted(os.listdir(tmpdir_path)) == ["now", "spark"]
    write_chunks(rows.where("false"), f"{tmpdir_path}/now", ["sku ,", "qty"])
    assert files("now") == {} and os.path.exists(f"{tmpdir_path}/now/_SUCCESS")


def test_a_failed_local_chunk_task_leaves_the_earlier_files(spark, tmpdir_path):
    rows = spark.range(0, 25).select("id", F.lit("x").alias("x"), (F.col("id") + 1).alias("row_num"), F.floor(F.col("id") / 10).alias("chunk_id"))
    write_chunks(rows, f"{tmpdir_path}/c", ["id", "x"])
    broken = rows.withColumn("id", F.when(F.col("id") < 24, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")))
    with pytest.raises(Exception, match="broken"):
        write_chunks(broken, f"{tmpdir_path}/c", ["id", "x"])
    assert spark.read.option("header", True).csv(f"{tmpdir_path}/c").count() == 25
    assert os.listdir(tmpdir_path) == ["c"]


def test_only_the_last_batch_is_read_back(spark, tmpdir_path):
    def rows(n):
        return spark.range(n).select(F.format_string('S"%d,', "id").alias("sku"), F.lit(1).alias("stock_status"), F.lit("").alias("source_code"),
                                     F.when(F.col("id") > 0, F.col("id")).alias("qty"), (F.col("id") + 1).alias("row_num"), (F.floor(F.col("id") / 2) + 1).alias("chunk_id"))
    assert file_feed.exported_rows(spark, f"{tmpdir_path}/none").columns == ["sku", "stock_status", "source_code", "qty", "chunk_id"]
    for batch, n in ((2, 9), (10, 5), (11, 0)):  # the last one had nothing to export
        write_chunks(rows(n), f"{tmpdir_path}/out/batch={batch}", ["sku", "stock_status", "source_code", "qty"])
    back = file_feed.exported_rows(spark, f"{tmpdir_path}/out")
    assert all("/batch=10/" in f for f in back.inputFiles())
    assert sorted(map(tuple, back.collect())) == sorted((f'S"{i},', 1, None, i or None, i // 2 + 1) for i in range(5))
    as_csv = spark.read.option("header", True).schema(back.schema).csv(f"{tmpdir_path}/out/batch=10")
    assert sorted(map(str, as_csv.collect())) == sorted(map(str, back.collect()))


def commands_table(spark):
    return spark.createDataFrame(
        [(1, "2024-01-01 00:00:00", 1, "acknowledge", "TOLL"), (1, "2024-01-01 00:01:00", 2, "acknowledge", "TOLL"),
         (1, "2024-01-01 00:02:00", 3, "dispatch", "DHL"), (1, "2024-01-01 00:03:00", 4, "dispatch", "TOLL"),
         (2, "2024-01-01 00:00:00", 5, "cancel", "TOLL"), (2, "2024-01-01 00:01:00", 6, "cancel", "TOLL")],
        "order_id long, ts string, seq long, command string, carrier string").withColumn("ts", F.to_timestamp("ts"))


def test_lifecycle_stream(spark, tmpdir_path):
    out = lifecycle_stream.run_lifecycle_stream(commands_table(spark), tmpdir_path)
    got = {r["seq"]: (r["accepted"], r["state_after"]) for r in out.collect()}
    assert got == {1: (True, "ACKNOWLEDGED"), 2: (False, "ACKNOWLEDGED"), 3: (False, "ACKNOWLEDGED"),
                   4: (True, "DISPATCHED"), 5: (True, "CANCELLATION_ACK"), 6: (True, "CANCELLATION_ACK")}


def test_lifecycle_batches_equal_one_replay(spark, tmpdir_path):
    """A hot order and others over several micro-batches, one of them retried: as one batch replay."""
    import random
    r = random.Random(2)
    kinds = ["acknowledge", "backorder", "dispatch", "cancel", "refund"]
    made = [(r.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, 8]), k, r.choice(kinds if k > 40 else kinds[:2]), r.choice(["TOLL", "DHL", "DHL"])) for k in range(1, 81)]
    cmds = spark.createDataFrame(made, "order_id long, seq long, command string, carrier string").withColumn(
        "ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    tables, out = file_feed.TableSet(spark, tmpdir_path + "/state"), tmpdir_path + "/out"
    for batch, (lo, hi) in enumerate([(0, 20), (20, 21), (21, 60), (60, 80)]):
        part = cmds.where((F.col("seq") > lo) & (F.col("seq") <= hi))
        for _ in range(2 if batch == 2 else 1):
            lifecycle_stream.replay_batch(tables, part, batch, out)
    whole = replay_commands(cmds, n_buckets=None).select(*lifecycle_stream.OUTCOME)
    assert sorted(map(tuple, spark.read.parquet(out).select(*lifecycle_stream.OUTCOME).collect())) == sorted(map(tuple, whole.collect()))


def test_ledger_stream(spark, tmpdir_path):
    deltas = spark.createDataFrame([(1, -2), (1, -3), (2, 4), (3, 1), (None, 9)], "product_id long, delta long").repartition(4)
    totals = ledger.run_ledger_stream(deltas, tmpdir_path, files_per_batch=1)
    assert {r["product_id"]: (r["delta_total"], r["n_deltas"]) for r in totals.collect()} == {1: (-5, 2), 2: (4, 1), 3: (1, 1)}


def test_ledger_batch_killed_before_the_swap(spark, tmpdir_path, monkeypatch):
    tables = file_feed.TableSet(spark, tmpdir_path)
    batch = [spark.createDataFrame(rows, "product_id long, delta_total long, n_deltas long") for rows in ([(1, 5, 1), (2, 7, 1)], [(2, 9, 2)])]
    assert ledger.publish_totals(tables, batch[0], 0)

    def broken(self, record):
        raise OSError("lost before the swap")
    with monkeypatch.context() as m:
        m.setattr(file_feed.TableSet, "_commit", broken)
        with pytest.raises(OSError):
            ledger.publish_totals(tables, batch[1], 1)
    read = lambda: {r.product_id: r.delta_total for r in ledger.totals_table(tables).current().collect()}
    assert read() == {1: 5, 2: 7}
    assert ledger.publish_totals(tables, batch[1], 1) and not ledger.publish_totals(tables, batch[1], 1)
    assert read() == {1: 5, 2: 9}
    # only the touched product was written
    folders = tables.record()["tables"]["totals"]["folders"]
    assert [spark.read.parquet(f"{tables.root}/{f}").count() for f in folders] == [2, 1]
