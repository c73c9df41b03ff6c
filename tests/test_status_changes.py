"""Status changes against shared stock vs a change-by-change model."""
import random

from stockspark.config import ORDER_STATUSES
from stockspark.operators import ordering
from stockspark.operators.status import change_status


def model(stock, status, items, changes):
    stock, status, log = dict(stock), dict(status), {}
    for seq, oid, new in changes:
        if new not in ORDER_STATUSES:
            log[seq] = "Invalid order status."
            continue
        if oid not in status:
            log[seq] = "Order not found."
            continue
        old, lines = status[oid], items.get(oid, [])
        log[seq] = None
        if new == "Cancelled" and old != "Cancelled":
            for p, q in lines:
                stock[p] = stock.get(p, 0) + q
        elif new != "Cancelled" and old == "Cancelled":
            short = [p for p, q in lines if p not in stock or stock[p] < q]
            if short:
                log[seq] = f"Not enough stock to un-cancel. Product ID {short[0]}."
                continue
            for p, q in lines:
                stock[p] -= q
        status[oid] = new
    return stock, status, log


def test_against_model(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 9)
    r = random.Random(12)
    stock = {p: r.randint(0, 25) for p in range(8)}
    status = {o: r.choice(ORDER_STATUSES) for o in range(25)}
    items = {o: [(p, r.randint(1, 6)) for p in r.sample(range(8), r.randint(1, 3))] for o in range(24)}
    changes = [(k, r.randint(0, 26), r.choice([*ORDER_STATUSES, "Cancelled", "Pending", "Bogus"])) for k in range(150)]
    want = model(stock, status, items, changes)
    p, o, log = change_status(
        spark.createDataFrame(list(stock.items()), "id long, quantity long"),
        spark.createDataFrame(list(status.items()), "id long, status string"),
        spark.createDataFrame([(k, n, a, b) for k, ls in items.items() for n, (a, b) in enumerate(ls)],
                              "order_id long, line_no int, product_id long, quantity int"),
        spark.createDataFrame(changes, "seq long, order_id long, new_status string"))
    assert {x.seq: x.error for x in log.collect()} == want[2]
    assert {x.id: x.status for x in o.collect()} == want[1]
    got = {x.id: x.quantity for x in p.collect()}
    assert got == want[0] and min(got.values()) >= 0
