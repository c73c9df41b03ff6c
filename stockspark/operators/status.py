"""Order status changes against shared stock (DML-7), a batch in one job.

Changes apply in the order of ``seq``. Cancelling an order returns its items to
stock; taking it out of Cancelled needs stock for every line and is refused
otherwise (the order stays as it was). Several changes of one order see each
other, and all orders share the stock.

Stock only moves when an order enters or leaves Cancelled. An order's changes fall
into segments, each begun by a change to Cancelled; in a segment that begins
cancelled the first granted change out of it takes the stock and later ones move
nothing. As in ``admission``, rounds decide by bounds: every undecided step takes
between nothing and its full amount (or returns between nothing and all); what fits
under the highest claim is granted, what does not fit under the lowest is refused.
The earliest undecided change is always decided, so the rounds end; each works on
running sums per product over the steps that were open before it (large products are
scanned in buckets of the sequence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from stockspark.config import ORDER_STATUSES
from stockspark.operators.ordering import add_buckets, segmented_sums
from stockspark.session import materialize, scratch_folder


def change_status(products: DataFrame, orders: DataFrame, items: DataFrame, changes: DataFrame):
    """products: id, quantity, ...; orders: id, status, ...; items: order_id, line_no, product_id,
    quantity; changes: seq (unique), order_id, new_status.

    Returns (products, orders, log) with log (seq, order_id, new_status, applied, error).
    """
    seen = changes.select("seq", "order_id", "new_status").join(
        orders.select(F.col("id").alias("order_id"), F.col("status").alias("_old")), "order_id", "left")
    static = (F.when(~F.coalesce(F.col("new_status").isin(*ORDER_STATUSES), F.lit(False)), F.lit("Invalid order status."))
              .when(F.col("_old").isNull(), F.lit("Order not found.")))
    seen = seen.withColumn("error", static)
    along = Window.partitionBy("order_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    cancels = F.col("new_status") == "Cancelled"
    ev = (seen.where(F.col("error").isNull())
          .withColumn("seg", F.sum(cancels.cast("int")).over(along))
          .withColumn("_c0", F.col("_old") == "Cancelled"))
    begins_cancelled = (F.col("seg") > 0) | F.col("_c0")
    ev = materialize(ev.withColumn("kind", F.when(cancels, "K").when(begins_cancelled, "T").otherwise("P"))
                     .drop("error"))

    stock = products.select(F.col("id").alias("pid"), F.col("quantity").cast("bigint").alias("stock"))
    lines = items.select("order_id", "line_no", F.col("product_id").alias("pid"), F.col("quantity").cast("bigint").alias("qty"))
    known = lines.join(stock, "pid", "left")
    need = known.groupBy("order_id", "pid").agg(F.sum("qty").alias("dq"), F.max("qty").alias("maxq"), F.min("stock").alias("stock"))
    moves = ev.where("kind <> 'P'").select("seq", "order_id", "seg", "kind", "_c0")
    tries = moves.where("kind = 'T'").select("seq", "order_id", "seg")
    hopeless = known.where("stock IS NULL").select("order_id").distinct().withColumn("_h", F.lit(True))
    # every try has a number of its own, by which its lines find its state
    state = materialize(tries.join(hopeless, "order_id", "left").select(
        F.monotonically_increasing_id().alias("try"), "seq", "order_id", "seg", F.when(F.col("_h"), "R").otherwise("U").alias("st")))
    dem = materialize(moves.join(need, "order_id").join(state.select("try", F.col("seq").alias("_seq")), F.col("seq") == F.col("_seq"), "left")
                      .drop("_seq").where("stock IS NOT NULL"))
    dem = add_buckets(dem, "seq", keys=["pid"])
    zero, dq = F.lit(0).cast("bigint"), F.col("dq")

    def bounds(lines: DataFrame, state: DataFrame) -> DataFrame:
        """``lines`` with the state of their try and what each step takes at least (lo) and at most (hi)."""
        ends = state.groupBy("order_id", (F.col("seg") + 1).alias("seg")).agg(
            F.bool_or(F.col("st") == "A").alias("_any"), F.bool_or(F.col("st") == "U").alias("_open"))
        d = lines.join(state.select("try", "st"), "try", "left").join(ends, ["order_id", "seg"], "left")
        sure = ((F.col("seg") == 1) & ~F.col("_c0")) | F.coalesce("_any", F.lit(False))
        back = F.col("kind") == "K"
        lo = (F.when(back & (sure | F.coalesce("_open", F.lit(False))), -dq).when(~back & (F.col("st") == "A"), dq).otherwise(zero))
        hi = (F.when(back & sure, -dq).when(~back & F.col("st").isin("A", "U"), dq).otherwise(zero))
        return d.select(*lines.columns, "st", lo.alias("_lo"), hi.alias("_hi"))

    # A round holds the lines of steps whose amount was open before it, and the segments with an open try.
    # What the other lines took is taken off the stock of the later ones when they leave.
    rounds = scratch_folder(products.sparkSession)
    first = state
    undecided = state.where("st = 'U'").count()
    turn, lines = 0, dem
    while undecided:
        turn += 1
        kept = lines.columns
        fixed = F.col("_lo").eqNullSafe(F.col("_hi")) & ~F.coalesce(F.col("st") == "U", F.lit(False))
        sums = segmented_sums(bounds(lines, state).withColumn("_fixed", fixed), ["pid"], ["seq"], {
            "least": F.col("_lo"), "most": F.col("_hi"), "_gone": F.when(F.col("_fixed"), F.col("_lo")).otherwise(zero)})
        stock = F.col("stock")
        judged = materialize(sums.where(~F.col("_fixed")).select(
            *[c for c in kept if c != "stock"], (stock - F.col("_gone")).alias("stock"),
            ((F.col("st") == "U") & (F.col("kind") == "T")).alias("_asks"),
            (stock - F.col("most") >= F.col("maxq")).alias("_fit"), (stock - F.col("least") < F.col("maxq")).alias("_short")))
        fits = judged.where("_asks").groupBy("seq").agg(F.bool_and("_fit").alias("_ok"), F.bool_or("_short").alias("_bad"))
        segment = Window.partitionBy("order_id", "seg")
        before = segment.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        queue = (state.withColumn("_wait", F.coalesce(F.bool_or(F.col("st") == "U").over(before), F.lit(False)))
                 .withColumn("_had", F.coalesce(F.bool_or(F.col("st") == "A").over(before), F.lit(False)))
                 .withColumn("_live", F.bool_or(F.col("st") == "U").over(segment)))
        new = queue.where("_live").join(fits, "seq", "left").select(
            "try", "seq", "order_id", "seg", (F.col("st") == "U").alias("_was"),
            F.when((F.col("st") != "U"), F.col("st")).when(F.col("_had"), "N").when(F.col("_wait"), "U")
            .when(F.coalesce("_ok", F.lit(True)), "A").when(F.col("_bad"), "R").otherwise("U").alias("st"))
        obs = Observation(f"status-round-{turn}")
        state = materialize(new.observe(obs, F.count_if(F.col("st") == "U").alias("u")), f"{rounds}/turn={turn}").drop("_was")
        undecided, lines = obs.get["u"], judged.select(*kept)
    if turn:
        decided = products.sparkSession.read.parquet(rounds).where("_was AND st <> 'U'").select("try", F.col("st").alias("_new"))
        state = materialize(first.join(decided, "try", "left").select("try", "seq", "order_id", "seg", F.coalesce("_new", "st").alias("st")))

    done = segmented_sums(bounds(dem, state), ["pid"], ["seq"], {"least": F.col("_lo")})
    moved = done.groupBy("pid").agg(F.sum("_lo").alias("_taken"))  # all decided: least equals most
    cols = products.columns
    out_products = products.join(moved, products["id"] == F.col("pid"), "left").withColumn(
        "quantity", (F.col("quantity") - F.coalesce("_taken", F.lit(0))).cast("bigint")).select(*cols)

    avail = done.where("st = 'R'").select("seq", "order_id", "pid", (F.col("stock") - F.col("least")).alias("_avail"))
    refused = state.where("st = 'R'").select("seq", "order_id").join(known, "order_id").join(avail, ["seq", "order_id", "pid"], "left")
    short = refused.where("stock IS NULL OR _avail < qty").groupBy("seq").agg(
        F.min(F.struct("line_no", "pid")).alias("_f"))
    log = (seen.join(short, "seq", "left").withColumn("error", F.coalesce("error", F.when(
        F.col("_f").isNotNull(), F.format_string("Not enough stock to un-cancel. Product ID %d.", F.col("_f.pid")))))
        .select("seq", "order_id", "new_status", F.col("error").isNull().alias("applied"), "error"))
    # a refused try has a line that falls short, so its state tells without the message that it is not applied
    refusals = state.where("st = 'R'").select("seq").distinct()
    last = seen.where(F.col("error").isNull()).join(refusals, "seq", "left_anti").groupBy("order_id").agg(F.max_by("new_status", "seq").alias("_new"))
    out_orders = orders.join(last, orders["id"] == F.col("order_id"), "left").withColumn(
        "status", F.coalesce("_new", "status")).select(*orders.columns)
    return out_products, out_orders, log
