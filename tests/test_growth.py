"""Work that must not grow with the number of rounds, hot keys or files."""
import os

import pytest
from pyspark.sql import functions as F

import stockspark.operators.admission as admission_mod
import stockspark.operators.claims as claims_mod
import stockspark.operators.ordering as ordering_mod
import stockspark.operators.status as status_mod
from stockspark.operators import compare
from stockspark.operators import upsert as U
from stockspark.operators.documents import ingest_order_documents
from stockspark.sinks.writers import write_chunks


def test_rounds_read_undecided_orders_only(spark, monkeypatch):
    # one product that the first orders use up, and a chain of orders that wait for each other
    lines = [(0, r, 1, 1, 3) for r in range(1, 41)] + [(k, 100 + k, 1, 1, 1) for k in range(1, 9)] + [(k, 101 + k, 1, 1, 1) for k in range(1, 9)]
    demand = spark.createDataFrame(lines, "pid long, row long, dq long, _maxq long, stock long")
    state = demand.select("row", F.lit("U").alias("state")).distinct()
    written, write = [], admission_mod.materialize
    monkeypatch.setattr(admission_mod, "materialize", lambda df, *a: (lambda d: written.append(d.count()) or d)(write(df, *a)))
    got = {r["row"]: r["state"] for r in admission_mod.decide(demand, write(state)).collect()}
    assert [r for r in range(1, 41) if got[r] == "A"] == [1, 2, 3]
    assert [got[100 + k] for k in range(1, 10)] == ["A", "R"] * 4 + ["A"]
    rounds = written[:-1]  # the last table has all verdicts
    assert len(rounds) > 3 and rounds[0] == len(lines) and max(rounds[2:]) < len(lines) / 2


def test_only_large_keys_have_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordering_mod, "ROWS_PER_BUCKET", 7)
    rows = [(0, i, i) for i in range(40)] + [(k, i, i) for k in (1, 2, None) for i in range(5)]
    df = spark.createDataFrame(rows, "pid long, row long, v long")
    d = ordering_mod.add_buckets(df, "row", keys=["pid"])
    assert {r["pid"]: r["n"] for r in d.groupBy("pid").agg(F.count_distinct("_bkt").alias("n")).collect()}[1] == 0
    got = ordering_mod.segmented_sums(d, ["pid"], ["row"], {"s": F.col("v")})
    assert {(r["pid"], r["row"]): r["s"] for r in got.collect()} == {(p, i): i * (i - 1) // 2 for p, i, _ in rows}
    assert d.where("pid = 0").select("_bkt").distinct().count() > 2
    assert "_bkt" not in ordering_mod.add_buckets(df.where("pid > 0"), "row", keys=["pid"]).columns


def test_import_reduces_the_batch_once(spark):
    products = spark.createDataFrame([(1, "A", "a", 1, 1.0, 1, "small")], "id long, sku string, name string, quantity long, price double, supplier_id long, pack_size string")
    suppliers = spark.createDataFrame([(1, "S", None, None)], "id long, name string, email string, phone string")
    batch = spark.createDataFrame([(1, "B", "b", "1", "2", "S", ""), (2, "A", "x", "3", "4", "T", ""), (3, "B", "c", "5", "6", None, "large"), (4, "C", "c", "1", "1", "T", None)],
                                  "row long, sku string, name string, quantity string, price string, supplier string, pack_size string")
    out, _, _, log = U.upsert_products(products, suppliers, batch)
    for d in (out, log):
        assert "max_by" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, "A", "x", 3, 4.0, 2, "small"), (2, "B", "c", 5, 6.0, None, "large"), (3, "C", "c", 1, 1.0, 2, None)]


def test_failed_chunks_leave_the_earlier_ones(spark, tmpdir_path):
    rows = spark.range(0, 25).select("id", (F.col("id") + 1).alias("row_num"), F.floor(F.col("id") / 10).alias("chunk_id"))
    write_chunks(rows, f"{tmpdir_path}/c", ["id"])
    broken = rows.withColumn("id", F.when(F.col("id") < 24, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")))
    with pytest.raises(Exception, match="broken"):
        write_chunks(broken, f"{tmpdir_path}/c", ["id"])
    assert spark.read.option("header", True).csv(f"{tmpdir_path}/c").count() == 25
    assert os.listdir(tmpdir_path) == ["c"]


def test_documents_are_numbered_without_their_items(spark, monkeypatch):
    import stockspark.operators.documents as documents
    from stockspark.operators.documents import ADDRESS_FIELDS
    address = "struct<" + ",".join(f"{f}:string" for f in ADDRESS_FIELDS) + ">"
    docs = spark.createDataFrame([(f"P{i // 2}", None, {"city": "x"}, ("r",), [(i, 1)], i) for i in range(6)] + [("P9", None, None, None, [(9, 1)], 9)] * 2,
                                 f"order_reference string, order_date timestamp, shipping_address {address}, retailer_data struct<name:string>, items array<struct<a:long,b:long>>, _ord long")
    seen, number = [], documents.global_row_number
    monkeypatch.setattr(documents, "global_row_number", lambda d, *a: seen.append(d.columns) or number(d, *a))
    existing = spark.createDataFrame([(7, "P1")], "id long, order_reference string")
    orders, items, rejects = ingest_order_documents(existing, docs, "2024-01-01 00:00:00")
    assert seen == [["order_reference", "_ord"]]
    assert sorted((r["id"], r["order_reference"]) for r in orders.collect()) == [(8, "P0"), (9, "P2"), (10, "P9"), (11, "P9")]
    assert sorted((r["order_id"], r["a"]) for r in items.collect()) == [(8, 0), (9, 4), (10, 9), (11, 9)]
    assert rejects.count() == 4


def test_settled_claims_leave_the_rounds(spark, monkeypatch):
    # 40 claims of keys of their own, and a chain of renames of which each waits for the one before
    claims = [(i, i, f"own{i}") for i in range(1, 41)] + [(100 + k, 100 + k, f"key{k + 1}") for k in range(9, 0, -1)]
    claims += [(200 + k, 100 + k, f"key{k}") for k in range(9, 0, -1)]
    holders = [(100 + k, f"key{k}") for k in range(1, 11)]
    written, write = [], claims_mod.materialize
    monkeypatch.setattr(claims_mod, "materialize", lambda df, *a: (lambda d: written.append(d.count()) or d)(write(df, *a)))
    got = claims_mod.settle(spark.createDataFrame(claims, "seq long, entity long, key string"),
                            spark.createDataFrame(holders, "entity long, key string")).collect()
    holds, names, expected = {k: e for e, k in holders}, dict(holders), {}
    for seq, entity, key in sorted(claims):
        expected[seq] = holds.get(key, entity) == entity
        if expected[seq]:
            holds.pop(names.get(entity), None)
            holds[key], names[entity] = entity, key
    assert {r["seq"]: r["granted"] for r in got} == expected and len(got) == len(claims)
    assert len(written) >= 3 and max(written[2:]) < len(claims) - 40


def test_rollup_holds_each_key_once(spark, capsys):
    side = "sku_key string, account_key string, qty double, _ord long"
    a = spark.createDataFrame([("S", "A", 1.0, 1), ("S", "A", 2.0, 2), ("T", "A", None, 3)], side)
    b = spark.createDataFrame([("S", "A", 3.0, 1), ("U", "B", 5.0, 2)], side)
    merged = compare.compare_v5(a, b, "sum")
    got = {(r["sku_key"], r["account_key"]): (r["qty_wh"], r["qty_ecom"], r["source_status"]) for r in merged.collect()}
    assert got == {("S", "A"): (3.0, 3.0, "Both"), ("T", "A"): (0.0, 0.0, "Warehouse Only"), ("U", "B"): (0.0, 5.0, "E-Commerce Only")}
    roll = compare.rollup_by_account(merged)
    assert {r["account_key"]: (r["total_items"], r["matched"], r["ecom_only"]) for r in roll.collect()} == {"A": (2, 2, 0), "B": (1, 0, 1)}
    roll.explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "distinct" not in plan and "Sort " not in plan


def test_totals_are_dealt_by_rows(spark, monkeypatch, capsys):
    a = spark.createDataFrame([(str(i % 7), f"P{i % 11}", i % 5) for i in range(300)] + [("1", None, 2)], "v string, s string, q int")
    b = spark.createDataFrame([(str(i % 5), f"P{i % 13}", i % 4) for i in range(200)], "v string, s string, q int")
    cols = ("v", "s", "q")
    expected = compare.stats_v3(a, b, "s", "s", compare.compare_v3(a, b, cols, cols)).first()
    monkeypatch.setattr(ordering_mod, "ROWS_PER_BUCKET", 10)
    totals = compare.totals_v3(a, b, cols, cols)
    assert compare.stats_from_totals_v3(totals).first().asDict() == expected.asDict()
    totals.explain()
    assert ", 51), REPARTITION_BY_NUM" in capsys.readouterr().out


def test_settled_status_changes_leave_the_rounds(spark, monkeypatch):
    # cancelled orders come back: one product that the first ones use up, and a chain of orders that wait for each other
    lines = [(r, 1, 0, 1) for r in range(1, 41)] + [(100 + k, 1, k, 1) for k in range(1, 9)] + [(101 + k, 2, k, 1) for k in range(1, 9)]
    items = spark.createDataFrame(lines, "order_id long, line_no int, product_id long, quantity int")
    products = spark.createDataFrame([(0, 3)] + [(k, 1) for k in range(1, 9)], "id long, quantity long")
    orders = items.select(F.col("order_id").alias("id"), F.lit("Cancelled").alias("status")).distinct()
    changes = orders.select(F.col("id").alias("seq"), F.col("id").alias("order_id"), F.lit("Pending").alias("new_status"))
    written, write = [], status_mod.materialize
    monkeypatch.setattr(status_mod, "materialize", lambda df, *a: (lambda d: written.append(d.count()) or d)(write(df, *a)))
    stock, after, log = status_mod.change_status(products, orders, items, changes)
    status = {r["id"]: r["status"] for r in after.collect()}
    assert [r for r in range(1, 41) if status[r] == "Pending"] == [1, 2, 3]
    assert [status[100 + k] for k in range(1, 10)] == ["Pending", "Cancelled"] * 4 + ["Pending"]
    assert {r["order_id"] for r in log.where("applied").collect()} == {o for o, s in status.items() if s == "Pending"}
    assert {r["id"]: r["quantity"] for r in stock.collect()} == {k: 0 for k in range(9)}
    rounds = written[3:-1]  # of changes, states and demands before, of all states after the rounds
    assert len(rounds) > 6 and max(rounds[4:]) < len(lines) / 2
