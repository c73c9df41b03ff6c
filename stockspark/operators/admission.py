"""Sequential order admission against shared stock as a fix-point (DML-5, DML-6, WIN-5, JSN-1, AGG-16).

An order is admitted when every line has ``stock - earlier admitted demand >=
qty`` for its product (lines of the same order do not see each other);
admitted orders reduce stock for later ones. The orders are coupled through
shared products, so no single window answers it. Each round, per product and
in order sequence (two-level scans, skew-safe):

* ``lb`` = demand of earlier orders already admitted,
* ``ub`` = demand of earlier orders admitted or still undecided;

an undecided order is admitted when all its lines fit under ``ub`` and
rejected when some line does not fit even under ``lb``. The earliest
undecided order always has ``lb == ub``, so every round decides at least one
order; the loop runs until none is undecided (no round cap). A round works on
the lines of undecided orders only, and its verdicts are a written table, so a
lost executor never replays earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from stockspark.config import ORDER_STATUSES
from stockspark.functions.keys import strip_ws
from stockspark.functions.numeric import py_float
from stockspark.operators.ordering import add_buckets, global_row_number, segmented_sums
from stockspark.session import materialize, scratch_folder
from stockspark.sinks.tableset import TableSet

ITEM_SCHEMA = "array<struct<product_sku:string,quantity:string,price_at_order:string>>"


def _json_int(c):
    """int() of a JSON value: integers as is, JSON numbers with a fraction truncate."""
    s = strip_ws(F.coalesce(c, F.lit("")))
    return (F.when(s == "", F.lit(0).cast("bigint"))
            .when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint"))
            .when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double").try_cast("bigint")))


def parse_order_rows(rows: DataFrame, row_col: str = "row") -> tuple[DataFrame, DataFrame]:
    """JSN-1 + validation. Returns (orders, lines).

    orders: row, customer_name, order_date, status, header_error.
    lines:  row, item, sku, qty, price, line_bad (invalid sku/qty/price).
    """
    cust = strip_ws(F.coalesce(F.col("customer_name"), F.lit("")))
    txt = strip_ws(F.coalesce(F.col("items_json"), F.lit("")))
    # the JSON is parsed once, in a projection of its own, and the parsed rows are written
    rows = rows.select("*", txt.startswith("[").alias("_list"), F.from_json(txt, ITEM_SCHEMA).alias("_parsed"))
    parsed = F.col("_parsed")
    is_list = F.col("_list") & parsed.isNotNull()
    status = strip_ws(F.coalesce(F.col("status"), F.lit("")))
    status = F.when(status.isin(*ORDER_STATUSES), status).otherwise(F.lit("Pending"))
    row = F.col(row_col)
    herr = (F.when(cust == "", F.format_string("Row %d: customer_name required.", row))
            .when(~is_list | (F.size(parsed) < 1),
                  F.format_string("Row %d: invalid items_json (items_json must be non-empty array).", row)))
    base = materialize(rows.select(row.alias("row"), cust.alias("customer_name"),
                                   F.col("order_date"), status.alias("status"), herr.alias("header_error"),
                                   F.when(is_list, parsed).alias("_items")))
    orders = base.drop("_items")
    ex = base.where(F.col("header_error").isNull()).select(
        "row", F.posexplode("_items").alias("_pos", "_it"))
    qty = _json_int(F.col("_it.quantity"))
    price = py_float(F.col("_it.price_at_order"))
    sku = strip_ws(F.coalesce(F.col("_it.product_sku"), F.lit("")))
    lines = ex.select("row", (F.col("_pos") + 1).alias("item"), sku.alias("sku"), qty.alias("qty"),
                      price.alias("price"))
    bad = ((F.col("sku") == "") | F.col("qty").isNull() | (F.col("qty") <= 0) | F.col("price").isNull()
           | ~((F.col("price") > 0) & ~F.isnan("price")))
    return orders, lines.withColumn("line_bad", bad)


def _prefix(d: DataFrame, values: dict) -> DataFrame:
    return segmented_sums(d, ["pid"], ["row"], values, inclusive=False)


def decide(demand: DataFrame, state: DataFrame) -> DataFrame:
    """The rounds: ``state`` (row, state U or R; a written table) with every U turned into A or R.

    ``demand``: pid, row, dq, _maxq (the largest line), stock and, for large products, the bucket of ``row``.
    A round reads and writes only the lines of orders undecided before it. ``free`` is what earlier
    admitted orders surely leave; orders admitted in one round lower it in the next and then leave
    the table, so all rounds together cost what is undecided in each."""
    spark = state.sparkSession
    rounds = scratch_folder(spark)
    u, dq, free = F.col("state") == "U", F.col("dq"), F.col("free")
    zero = F.lit(0).cast("bigint")
    of_order = Window.partitionBy("row")
    # the largest line of a product in the order decides (lines do not see each other)
    fits = F.bool_and(free - F.col("_open") >= F.col("_maxq")).over(of_order)
    short = F.bool_or(free < F.col("_maxq")).over(of_order)
    d = demand.join(state.where(u), "row").withColumnRenamed("stock", "free")
    left, turn = None, 0
    while left != 0:
        turn += 1
        seen = _prefix(d, {"_granted": F.when(u, zero).otherwise(dq), "_open": F.when(u, dq).otherwise(zero)})
        # lines without a known stock judge nothing; an order of such lines only is refused
        verdict = (F.when(F.col("_fits"), "A").when(F.col("_short") | F.col("_fits").isNull(), "R").otherwise("U"))
        new = (seen.where(u).withColumn("free", free - F.col("_granted")).withColumn("_fits", fits)
               .withColumn("_short", short).select(*[c for c in d.columns if c != "state"], verdict.alias("state")))
        # the undecided lines of the next round are observed while this one is written
        obs = Observation(f"admission-round-{turn}")
        done = materialize(new.observe(obs, F.count_if(u).alias("u")), f"{rounds}/turn={turn}")
        if obs.get["u"] == left:
            raise ValueError("orders that repeat a row number cannot be decided")
        left, d = obs.get["u"], done.where("state <> 'R'")
    decided = (spark.read.parquet(rounds).where(~u).select("row", F.col("state").alias("_new")).distinct())
    return materialize(state.join(decided, "row", "left").select("row", F.coalesce("_new", "state").alias("state")))


def admit(rows: DataFrame, products: DataFrame, row_col: str = "row", n_buckets: int | None = None):
    """Run the admission. ``products``: id, sku, quantity.

    Returns (decisions, stock) where decisions has one row per input row
    (row, customer_name, status, admitted, error) and stock is
    (id, sku, quantity) after the admitted orders.
    """
    orders, lines = parse_order_rows(rows, row_col)
    p = products.select(F.col("id").alias("pid"), F.col("sku").alias("_psku"), F.col("quantity").alias("stock"))
    # parsed and joined once for the static verdict, the demand and the messages
    lines = materialize(lines.join(p, lines["sku"] == F.col("_psku"), "left").drop("_psku"))
    # static verdict: first bad/unknown item rejects the order whatever the stock
    static_bad = lines.where(F.col("line_bad") | F.col("pid").isNull()).groupBy("row").agg(
        F.min("item").alias("_first_static"))
    cand = orders.where(F.col("header_error").isNull()).join(static_bad, "row", "left")
    # demand per (product, order): the order's lines are checked one by one, but
    # all against the stock before the order, so line-level checks suffice.
    demand = (lines.join(cand.select("row"), "row").where(F.col("pid").isNotNull())
              .groupBy("pid", "row").agg(F.sum("qty").alias("dq"),
                                         F.min("stock").alias("stock"),
                                         F.max("qty").alias("_maxq")))
    # statically rejected orders stay in the scan (state R, zero demand) so that
    # their lines still get the exact availability for the error message
    # sequence buckets are fixed for the whole run: computed once
    demand = materialize(demand)
    demand = add_buckets(demand, "row", n_buckets, keys=["pid"])
    state = cand.select("row", F.when(F.col("_first_static").isNotNull(), F.lit("R")).otherwise(F.lit("U"))
                        .alias("state"))
    state = materialize(state)
    state = decide(demand, state)
    # final availability per line (accepted-only prefix) -> first failing item and its message
    d = demand.join(state, "row")
    d = _prefix(d, {"lb": F.when(F.col("state") == "A", F.col("dq")).otherwise(F.lit(0)).cast("bigint")})
    avail = d.select("pid", "row", (F.col("stock") - F.col("lb")).alias("avail"))
    li = lines.join(avail, ["pid", "row"], "left")
    fail = (F.when(F.col("line_bad"), F.lit(1)).when(F.col("pid").isNull(), F.lit(2))
            .when(F.col("avail") < F.col("qty"), F.lit(3)))
    first_fail = li.where(fail.isNotNull()).groupBy("row").agg(
        F.min_by(F.struct("item", "sku", "avail", fail.alias("kind")), F.col("item")).alias("_f"))
    msg = (F.when(F.col("_f.kind") == 1, F.format_string("Row %d item %d: invalid item (sku/qty/price).",
                                                          F.col("row"), F.col("_f.item")))
           .when(F.col("_f.kind") == 2, F.format_string("Row %d item %d: unknown SKU '%s'.", F.col("row"),
                                                         F.col("_f.item"), F.col("_f.sku")))
           .when(F.col("_f.kind") == 3, F.format_string("Row %d item %d: not enough stock for %s (avail %d).",
                                                         F.col("row"), F.col("_f.item"), F.col("_f.sku"),
                                                         F.col("_f.avail"))))
    dec = (orders.join(state, "row", "left").join(first_fail, "row", "left")
           .select("row", "customer_name", "status", F.coalesce(F.col("state") == "A", F.lit(False)).alias("admitted"),
                   F.coalesce(F.col("header_error"), F.when(F.col("state") != "A", msg)).alias("error")))
    used = demand.join(state.where(F.col("state") == "A"), "row").groupBy("pid").agg(F.sum("dq").alias("_u"))
    stock = products.join(used, products["id"] == used["pid"], "left").select(
        "id", "sku", (F.col("quantity") - F.coalesce(F.col("_u"), F.lit(0))).cast("bigint").alias("quantity"))
    return dec, stock


def merge_lines(items: DataFrame) -> DataFrame:
    """AGG-16: repeated lines of one product in an order become one line."""
    return items.groupBy("order_id", "product_id").agg(F.sum("quantity").alias("quantity"))


def create_orders(requests: DataFrame, lines: DataFrame, products: DataFrame, orders: DataFrame,
                  n_buckets: int | None = None) -> dict[str, DataFrame]:
    """DML-6: create orders in ``row`` sequence; all lines of an order or none.

    ``requests``: row (unique), customer_name, order_date. ``lines``: row, line,
    product_id, quantity. ``products``: id, sku, quantity, price. Lines of one product
    become one (at the place of the first) before they are held against the stock that
    earlier created orders left; a line keeps the product's price as ``price_at_order``.

    Returns ``decisions`` (row, order_id - null if refused -, error), the new ``orders``
    (id, customer_name, order_date, status) and ``items`` (order_id, line_no, product_id,
    quantity, price_at_order), and ``products`` with what is left. Ids follow the
    largest id of ``orders`` in row order.
    """
    customer = strip_ws(F.coalesce("customer_name", F.lit("")))
    bad = ~F.coalesce(F.col("quantity") > 0, F.lit(False))
    held = lines.groupBy("row").agg(F.count(F.lit(1)).alias("_lines"), F.count_if(bad).alias("_bad"))
    error = (F.when(customer == "", "Customer name is required.")
             .when(F.col("_lines").isNull(), "Order must contain at least one product.")
             .when(F.col("_bad") > 0, "Quantity must be greater than 0."))
    asked = materialize(requests.join(held, "row", "left").select(
        "row", customer.alias("customer_name"), "order_date", error.alias("header_error")))
    valid = asked.where(F.col("header_error").isNull())
    merged = (lines.join(valid.select("row"), "row", "left_semi").groupBy("row", "product_id")
              .agg(F.sum(F.col("quantity").cast("bigint")).alias("dq"), F.min("line").alias("line")))
    stock = products.select(F.col("id").alias("pid"), "sku", F.col("quantity").cast("bigint").alias("stock"), "price")
    merged = materialize(merged.join(stock, F.col("product_id") == F.col("pid"), "left"))
    unknown = merged.where(F.col("pid").isNull()).select("row").distinct().withColumn("_unknown", F.lit(True))
    state = materialize(valid.select("row").join(unknown, "row", "left").select(
        "row", F.when(F.col("_unknown"), "R").otherwise("U").alias("state")))
    known = merged.where(F.col("pid").isNotNull()).select("pid", "row", "dq", F.col("dq").alias("_maxq"), "stock")
    demand = add_buckets(materialize(known), "row", n_buckets, keys=["pid"])
    state = decide(demand, state)
    taken = F.when(F.col("state") == "A", F.col("dq")).otherwise(F.lit(0)).cast("bigint")
    left = _prefix(demand.join(state, "row"), {"lb": taken}).select("pid", "row", (F.col("stock") - F.col("lb")).alias("avail"))
    short = (merged.join(left, ["pid", "row"], "left").where(F.col("pid").isNull() | (F.col("avail") < F.col("dq")))
             .groupBy("row").agg(F.min_by(F.struct("sku", "avail"), F.struct("line", "product_id")).alias("_f")))
    created = state.where(F.col("state") == "A").select("row")
    base = int(orders.agg(F.max("id")).first()[0] or 0)
    ids = global_row_number(created, ["row"], "_rank").select("row", (F.col("_rank") + base).alias("order_id"))
    ids = materialize(ids)
    message = F.format_string("Not enough stock for %s. Available: %d", F.coalesce("_f.sku", F.lit("?")), F.coalesce("_f.avail", F.lit(0)))
    decisions = asked.join(ids, "row", "left").join(short, "row", "left").select(
        "row", "order_id", F.coalesce("header_error", F.when(F.col("order_id").isNull(), message)).alias("error"))
    new_orders = asked.join(ids, "row").select(F.col("order_id").alias("id"), "customer_name", "order_date", F.lit("Pending").alias("status"))
    items = merged.join(ids, "row").select("order_id", F.col("line").alias("line_no"), "product_id", F.col("dq").alias("quantity"),
                                           F.col("price").alias("price_at_order"))
    used = items.groupBy(F.col("product_id").alias("_pid")).agg(F.sum("quantity").alias("_used"))
    after = products.join(used, products["id"] == F.col("_pid"), "left").select(
        *[(F.col("quantity") - F.coalesce("_used", F.lit(0))).cast(products.schema["quantity"].dataType).alias("quantity")
          if c == "quantity" else F.col(c) for c in products.columns])
    return {"decisions": decisions, "orders": new_orders, "items": items, "products": after}


def publish_orders(tables: TableSet, batch: int, requests: DataFrame, lines: DataFrame) -> bool:
    """DML-6 on published tables ``orders``, ``order_items``, ``products``: orders, items and stock
    appear under one record, with the batch's ``order_decisions``. False if the batch was published before."""
    if tables.done("create_orders", batch):
        return False
    made = create_orders(requests, lines, tables.read("products"), tables.read("orders"))
    return tables.publish("create_orders", batch, replace={"products": made["products"], "order_decisions": made["decisions"]},
                          append={"orders": made["orders"], "order_items": made["items"]})
