"""Order lifecycle commands as one batch job (DML-14, WIN-6, JN-16, STR-10).

States ORDER -> ACKNOWLEDGED / BACKORDERED -> DISPATCHED | CANCELLATION_ACK.
DISPATCHED and CANCELLATION_ACK are absorbing, so per order:

* the first *valid* terminal command (dispatch with a known carrier, or
  cancel) fixes the final state;
* before it, the state is the type of the last acknowledge/backorder
  command (a rejected acknowledge only happens when the order is already
  ACKNOWLEDGED), else ORDER;
* after it only a repeated cancel (on a cancelled order) is accepted.

So the sequential replay becomes: a min-aggregate per order (terminal), a
"last non-null before" scan per order (previous state, skew-safe two-level
scan) and row-wise CASE logic. Commands are replayed in (ts, seq) order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.config import CARRIERS
from stockspark.operators.ordering import order_struct, segmented_scan

# Command names accepted by the lifecycle.
ACK, BACKORDER, DISPATCH, CANCEL = "acknowledge", "backorder", "dispatch", "cancel"
ORDER, ACKED, BACKORDERED, DISPATCHED, CANCEL_ACK = (
    "ORDER", "ACKNOWLEDGED", "BACKORDERED", "DISPATCHED", "CANCELLATION_ACK")


def replay_commands(cmds: DataFrame, order_col: str = "order_id", ts_col: str = "ts",
                    seq_col: str = "seq", n_buckets: int | None = 64, initial: DataFrame | None = None) -> DataFrame:
    """Per command: accepted flag and the state after it.

    Input columns: order_id, ts, seq, command, carrier, service, tracking_number, reason.
    ``initial`` (order_id, status; one row an order) gives the state that earlier
    commands left; orders without a row start in ORDER.
    """
    known = [c for c, _, _ in CARRIERS]
    cmd = F.col("command")
    valid_terminal = (cmd == CANCEL) | ((cmd == DISPATCH) & F.col("carrier").isin(known))
    d = cmds.withColumn("_vt", valid_terminal)
    d = d.withColumn("_ord", order_struct(ts_col, seq_col))
    # first valid terminal command per order (partial aggregate, skew-safe)
    term = d.where("_vt").groupBy(order_col).agg(
        F.min_by(F.struct("_ord", "command"), F.col("_ord")).alias("_t"))
    term = term.select(order_col, F.col("_t._ord").alias("_t_ord"), F.col("_t.command").alias("_t_cmd"))
    # previous acknowledge/backorder type before each command
    d = d.withColumn("_ab", F.when(cmd.isin(ACK, BACKORDER), cmd))
    d = d.withColumn("_tsd", F.unix_micros(F.col(ts_col).cast("timestamp")).cast("double"))
    d = segmented_scan(d, [order_col], [ts_col, seq_col], "_ab", "_prev_ab", how="last", inclusive=False,
                       bucket_col="_tsd", n_buckets=n_buckets)
    d = d.join(term, order_col, "left")
    start, over = F.lit(ORDER), F.lit(False)
    if initial is not None:
        d = d.join(initial.select(F.col("order_id").alias(order_col), F.col("status").alias("_start")), order_col, "left")
        start = F.coalesce("_start", F.lit(ORDER))
        over = start.isin(DISPATCHED, CANCEL_ACK)  # the terminal command came before all of these
        d = d.withColumn("_t_cmd", F.when(start == DISPATCHED, DISPATCH).when(start == CANCEL_ACK, CANCEL).otherwise(F.col("_t_cmd")))
    prev_state = (F.when(F.col("_prev_ab") == ACK, ACKED).when(F.col("_prev_ab") == BACKORDER, BACKORDERED)
                  .otherwise(start))
    t_state = F.when(F.col("_t_cmd") == DISPATCH, DISPATCHED).otherwise(CANCEL_ACK)
    before = ~over & (F.col("_t_ord").isNull() | (F.col("_ord") < F.col("_t_ord")))
    at = ~over & F.coalesce(F.col("_ord") == F.col("_t_ord"), F.lit(False))
    accepted = (F.when(before, (cmd == BACKORDER) | ((cmd == ACK) & (prev_state != ACKED)))
                .when(at, F.lit(True))
                .otherwise((F.col("_t_cmd") == CANCEL) & (cmd == CANCEL)))
    state_after = (F.when(before, F.when(cmd == ACK, ACKED).when(cmd == BACKORDER, BACKORDERED)
                          .otherwise(prev_state))
                   .otherwise(t_state))
    # after the terminal command the order sits in the terminal state
    state_before = F.when(before | at, prev_state).otherwise(t_state)
    return d.select(*cmds.columns, accepted.alias("accepted"), state_before.alias("state_before"),
                    state_after.alias("state_after"))


def final_orders(replayed: DataFrame, order_col: str = "order_id", ts_col: str = "ts",
                 seq_col: str = "seq") -> DataFrame:
    """Per order: final status, dispatch fields, counts and the backorder comment."""
    o = order_struct(ts_col, seq_col)
    acc = F.col("accepted")
    is_term_dispatch = acc & (F.col("command") == DISPATCH)
    bo = acc & (F.col("command") == BACKORDER) & (F.coalesce(F.col("reason"), F.lit("")) != "")
    g = replayed.groupBy(order_col).agg(
        F.max_by(F.col("state_after"), o).alias("status"),
        F.count(F.lit(1)).alias("n_commands"),
        F.count_if(acc).alias("n_accepted"),
        F.max_by(F.struct("carrier", "service", "tracking_number", F.col(ts_col).alias("dispatch_ts")),
                 F.when(is_term_dispatch, o)).alias("_d"),
        F.array_sort(F.collect_list(F.when(bo, F.struct(o.alias("o"), F.col("reason").alias("r"))))).alias("_bo"))
    comment = F.array_join(F.transform("_bo", lambda x: F.concat(F.lit(" | Backorder: "), x["r"])), "")
    return g.select(order_col, "status", "n_commands", "n_accepted",
                    F.col("_d.carrier").alias("dispatch_carrier"), F.col("_d.service").alias("delivery_service_code"),
                    F.col("_d.tracking_number").alias("dispatch_tracking_number"),
                    F.col("_d.dispatch_ts").alias("dispatch_ts"), comment.alias("comment"))
