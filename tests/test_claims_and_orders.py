"""DML-6, DML-10, DML-12: bulk commands, order creation and publication against row loops."""
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from stockspark.operators import admission, claims
from stockspark.sinks import tableset
from stockspark.sinks.tableset import KeyedState, TableSet

SUPPLIERS = "id long, name string, email string, phone string"
COMMANDS = "seq long, op string, id long, name string, email string, phone string"


def loop_suppliers(existing, commands):
    table, log = {r[0]: r[1:] for r in existing}, []
    top = max(table, default=0)
    for seq, op, i, name, email, phone in sorted(commands):
        name, email, phone = ((x or "").strip(" \t") for x in (name, email, phone))
        if not name:
            log.append((seq, i if op == "update" else None, "refused", "Name is required."))
            continue
        if op == "update" and i not in table_ids:
            log.append((seq, i, "no such row", None))
            continue
        target = i if op == "update" else None
        if any(v[0] == name for k, v in table.items() if k != target):
            log.append((seq, target, "refused", f"A supplier with the name '{name}' already exists."))
            continue
        if op == "insert":
            top += 1
            target = top
        table[target] = (name, email or None, phone or None)
        log.append((seq, target, "updated" if op == "update" else "inserted", None))
    return sorted((k, *v) for k, v in table.items()), sorted(log)


@pytest.mark.parametrize("seed, n, names, buckets", [(1, 60, 12, None), (2, 200, 25, None), (3, 120, 3, 4), (4, 0, 3, None), (5, 150, 200, 3)])
def test_supplier_commands_equal_a_row_loop(spark, monkeypatch, seed, n, names, buckets):
    global table_ids
    r = random.Random(seed)
    existing = [(i, f"N{i}", "e", None) for i in range(1, 9)]
    table_ids = {x[0] for x in existing}
    made = [(s, r.choice(["insert", "update", "update"]), r.randint(1, 10), r.choice([f"N{r.randint(1, names)}"] * 9 + [" ", None, f" N{r.randint(1, names)}\t"]),
             r.choice(["", "x@y", None]), str(s)) for s in range(1, n + 1)]
    if buckets:  # scans over several buckets give the same verdicts
        whole = claims.settle
        monkeypatch.setattr(claims, "settle", lambda c, h: whole(c, h, buckets))
    table, log = claims.bulk_suppliers(spark.createDataFrame(existing, SUPPLIERS), spark.createDataFrame(made, COMMANDS).repartition(3))
    want_table, want_log = loop_suppliers(existing, made)
    assert sorted(map(tuple, table.collect())) == want_table
    assert sorted((x.seq, x.id, x.action, x.message) for x in log.collect()) == want_log


def test_rename_chain_frees_keys_in_sequence(spark):
    existing = [(i, f"N{i}", None, None) for i in range(1, 7)]
    # 6 moves away, then 5 takes its name, 4 takes that of 5, ...; a swap without a free name fails
    made = [(k, "update", 7 - k, f"N{8 - k}", None, None) for k in range(1, 7)] + [(10, "update", 1, "N3", None, None), (11, "insert", None, "N1", None, None)]
    table, log = claims.bulk_suppliers(spark.createDataFrame(existing, SUPPLIERS), spark.createDataFrame(made, COMMANDS))
    assert sorted((x.id, x.name) for x in table.collect()) == [(i, f"N{i + 1}") for i in range(1, 7)] + [(7, "N1")]
    assert {x.seq: x.action for x in log.collect()} == {**{k: "updated" for k in range(1, 7)}, 10: "refused", 11: "inserted"}


def test_product_commands(spark):
    products = spark.createDataFrame([(1, "A", "a", 5, 1.0, 7, "small"), (2, "B", "b", 6, 2.0, None, None)],
                                     "id long, sku string, name string, quantity long, price double, supplier_id long, pack_size string")
    suppliers = spark.createDataFrame([(7, "S7", None, None)], SUPPLIERS)
    rows = [(1, "insert", None, "C", "c", "3", "1.5", "S7", " bulky "), (2, "insert", None, "A", "x", "3", "1", "", ""),
            (3, "update", 1, "AA", "a2", "4", "2", "nobody", None), (4, "insert", None, "A", "again", "1", "1", None, "huge"),
            (5, "insert", None, "A", "again", "x", "1", None, None), (6, "insert", None, "A", "again", "1", " ", None, None),
            (7, "insert", None, " ", "again", "1", "1", None, None), (8, "insert", None, "A", "again", "1", "1", "S7", None),
            (9, "update", 99, "Z", "z", "1", "1", None, None)]
    table, log = claims.bulk_products(products, suppliers, spark.createDataFrame(
        rows, "seq long, op string, id long, sku string, name string, quantity string, price string, supplier string, pack_size string"))
    assert sorted(map(tuple, table.collect())) == [(1, "AA", "a2", 4, 2.0, None, None), (2, "B", "b", 6, 2.0, None, None),
                                                  (3, "C", "c", 3, 1.5, 7, "bulky"), (4, "A", "again", 1, 1.0, 7, None)]
    assert [x.message or x.action for x in log.orderBy("seq").collect()] == [
        "inserted", "A product with the SKU 'A' already exists.", "updated", "Invalid pack size.", "Quantity must be an integer.",
        "Price must be a number.", "SKU and Name are required.", "inserted", "no such row"]


def test_created_products(spark):
    have = spark.createDataFrame([(4, "A", "a", 1, None)], "id long, sku string, name string, stock int, sap_article_id string")
    new = spark.createDataFrame([(1, "A", "x", 1, None), (2, "B", "b", 2, "S"), (3, "B", "c", 3, None)],
                                "seq long, sku string, name string, stock int, sap_article_id string")
    table, log = claims.create_products(have, new)
    assert sorted(map(tuple, table.collect())) == [(4, "A", "a", 1, None), (5, "B", "b", 2, "S")]
    assert [x.message for x in log.orderBy("seq").collect()] == ["SKU already exists", None, "SKU already exists"]


# ------------------------------------------------------------------ orders

PRODUCTS = "id long, sku string, quantity long, price double"


def loop_orders(requests, lines, products, top):
    stock = {p: [sku, n, price] for p, sku, n, price in products}
    made, items, verdicts = [], [], []
    for row, customer, date in sorted(requests):
        mine, error = {}, None
        for _, line, p, q in sorted((x for x in lines if x[0] == row), key=lambda x: x[1]):
            if q is None or q <= 0:
                error = "Quantity must be greater than 0."
            line, total = mine.get(p, (line, 0))
            mine[p] = (line, total + (q or 0))
        if not mine:
            error = "Order must contain at least one product."
        if not (customer or "").strip():
            error = "Customer name is required."
        if not error:
            for p, (_, q) in mine.items():
                if p not in stock or stock[p][1] < q:
                    error = f"Not enough stock for {stock[p][0] if p in stock else '?'}. Available: {stock[p][1] if p in stock else 0}"
                    break
        if not error:
            top += 1
            made.append((top, customer.strip(), date, "Pending"))
            for p, (line, q) in mine.items():
                stock[p][1] -= q
                items.append((top, line, p, q, stock[p][2]))
        verdicts.append((row, None if error else top, error))
    return sorted(made), sorted(items), sorted((p, v[1]) for p, v in stock.items()), sorted(verdicts)


def order_case(seed, n):
    r = random.Random(seed)
    products = [(i, f"S{i}", r.randint(0, 25), float(i)) for i in range(1, 7)]
    requests = [(k, r.choice(["ann", " bob "] * 4 + ["", None]), "2024-01-01") for k in range(1, n + 1)]
    lines = [(k, j, r.choice([1, 2, 3, 4, 5, 6, 1, 2] + [99] * (k % 9 == 0)), r.choice([1, 1, 2, 3, 5] + [0, None] * (k % 7 == 0)))
             for k in range(1, n + 1) for j in range(1, r.randint(0, 5) + 1)]
    return requests, lines, products


def frames(spark, requests, lines, products):
    return (spark.createDataFrame(requests, "row long, customer_name string, order_date string").repartition(3),
            spark.createDataFrame(lines, "row long, line int, product_id long, quantity int"), spark.createDataFrame(products, PRODUCTS))


def test_documents_may_be_numbered_from_zero_or_below(spark):
    have = spark.createDataFrame([(0, "A", "a", 1, None), (5, "B", "b", 2, None)], "id long, sku string, name string, stock long, sap_article_id string")
    new = spark.createDataFrame([(-1, "C", "c", 3, None), (0, "B", "x", 4, None), (1, "C", "y", 5, None), (2, "D", "d", 6, None)],
                                "seq long, sku string, name string, stock long, sap_article_id string")
    table, log = claims.create_products(have, new)
    assert sorted((r.id, r.sku, r.name) for r in table.collect()) == [(0, "A", "a"), (5, "B", "b"), (6, "C", "c"), (7, "D", "d")]
    assert sorted((r.seq, r.id, r.action) for r in log.collect()) == [(-1, 6, "inserted"), (0, None, "refused"), (1, None, "refused"), (2, 7, "inserted")]


@pytest.mark.parametrize("seed, n", [(1, 40), (2, 15), (3, 60)])
def test_created_orders_equal_a_row_loop(spark, seed, n):
    case = order_case(seed, n)
    orders = spark.createDataFrame([(70, "old", "d", "Pending")], "id long, customer_name string, order_date string, status string")
    got = admission.create_orders(*frames(spark, *case), orders)
    made, items, stock, verdicts = loop_orders(*case, 70)
    assert sorted(map(tuple, got["orders"].collect())) == made
    assert sorted(map(tuple, got["items"].collect())) == items
    assert sorted((r.id, r.quantity) for r in got["products"].collect()) == stock
    assert sorted(map(tuple, got["decisions"].collect())) == verdicts


def seeded(spark, products):
    tables = TableSet(spark, tempfile.mkdtemp(prefix="stockspark-tables-"))
    tables.publish("seed", 0, replace={
        "products": spark.createDataFrame(products, PRODUCTS),
        "orders": spark.createDataFrame([], "id long, customer_name string, order_date string, status string"),
        "order_items": spark.createDataFrame([], "order_id long, line_no int, product_id long, quantity long, price_at_order double")})
    return tables


def state_of(tables):
    return {t: sorted(map(tuple, tables.read(t).collect())) for t in ("products", "orders", "order_items")}


def test_orders_appear_whole_or_not_at_all(spark, monkeypatch):
    requests, lines, products = order_case(4, 20)
    req, li, _ = frames(spark, requests, lines, products)
    tables = seeded(spark, products)
    before = state_of(tables)
    reader = TableSet(spark, tables.root).record()

    def broken(self, record):
        raise OSError("lost before the record")
    with monkeypatch.context() as m:
        m.setattr(TableSet, "_commit", broken)
        with pytest.raises(OSError):
            admission.publish_orders(tables, 1, req, li)
    assert state_of(tables) == before and TableSet(spark, tables.root).record() == reader
    assert admission.publish_orders(tables, 1, req, li)
    after = state_of(tables)
    made, items, stock, verdicts = loop_orders(requests, lines, products, 0)
    assert after["orders"] == made and after["order_items"] == items and [(r[0], r[2]) for r in after["products"]] == stock
    assert sorted(map(tuple, tables.read("order_decisions").collect())) == verdicts
    assert not admission.publish_orders(tables, 1, req, li) and state_of(tables) == after  # a retry changes nothing


def test_records_are_not_overwritten(spark):
    tables = TableSet(spark, tempfile.mkdtemp(prefix="stockspark-tables-"))
    for n in range(7):
        assert tables.publish("j", n, append={"t": spark.range(n, n + 1)})
    assert not tables.publish("j", 3, append={"t": spark.range(1)})
    assert sorted(r.id for r in tables.read("t").collect()) == list(range(7))
    assert len(tables._versions()) == tableset.KEPT_RECORDS
    with pytest.raises(Exception, match="exists"):
        tables._commit(tables.record())  # a second writer of the same version


def test_keyed_state_holds_the_last_row_of_every_key(spark, monkeypatch):
    monkeypatch.setattr(tableset, "MOST_DELTAS", 3)
    tables, want, r = TableSet(spark, tempfile.mkdtemp(prefix="stockspark-tables-")), {}, random.Random(1)
    state = KeyedState(tables, "s", "k", "k string, v long, w string")
    for batch in range(1, 8):
        rows = {f"k{r.randint(0, 9)}": r.choice([batch, None]) for _ in range(4)}
        gone = [k for k in sorted(want) if k not in rows][:batch % 3]
        want = {k: v for k, v in {**want, **rows}.items() if k not in gone}
        delta = spark.createDataFrame([(k, v, None) for k, v in rows.items()], "k string, v long, w string")
        replace, append = state.changed(delta, batch, spark.createDataFrame([(k,) for k in gone], "k string"))
        assert tables.publish("j", batch, replace, append)
        assert state.folders() <= 5
        assert {x.k: x.v for x in state.current().collect()} == want
