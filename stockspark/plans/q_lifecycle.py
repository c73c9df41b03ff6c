"""Order lifecycle queries on the events table (user_id = order, event_type -> command)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockspark.operators import lifecycle as L
from stockspark.plans import fixtures as X
from stockspark.plans.catalog import query


def commands(spark, sf_dir):
    """Commands in the lifecycle schema: view -> acknowledge, click -> backorder,
    purchase -> dispatch, signup -> cancel, error -> an unknown command; carrier
    from the event's k (one code in four is not a known carrier)."""
    ev = X.Tables(spark, sf_dir).events
    k = F.get_json_object("props", "$.k").cast("int")
    command = (F.when(F.col("event_type") == "view", "acknowledge").when(F.col("event_type") == "click", "backorder")
               .when(F.col("event_type") == "purchase", "dispatch").when(F.col("event_type") == "signup", "cancel")
               .otherwise("refund"))
    carrier = (F.when(k % 4 == 0, "AUSPOST_PARCEL").when(k % 4 == 1, "STARTRACK").when(k % 4 == 2, "TOLL")
               .otherwise("DHL"))
    return ev.select(F.col("user_id").alias("order_id"), F.col("ts"), F.col("event_id").alias("seq"),
                     command.alias("command"), carrier.alias("carrier"),
                     F.when(k % 2 == 0, "STANDARD").otherwise("EXPRESS").alias("service"),
                     F.concat(F.lit("TRK"), F.col("event_id").cast("string")).alias("tracking_number"),
                     F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("low stock "), k.cast("string")))
                      .alias("reason"))


_CTE = """
c AS (
  SELECT user_id AS order_id, ts, event_id AS seq,
         CASE event_type WHEN 'view' THEN 'acknowledge' WHEN 'click' THEN 'backorder' WHEN 'purchase' THEN 'dispatch'
                         WHEN 'signup' THEN 'cancel' ELSE 'refund' END AS command,
         CASE CAST(json_extract(props, '$.k') AS INTEGER) % 4 WHEN 0 THEN 'AUSPOST_PARCEL' WHEN 1 THEN 'STARTRACK'
              WHEN 2 THEN 'TOLL' ELSE 'DHL' END AS carrier,
         CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0 THEN 'STANDARD' ELSE 'EXPRESS' END AS service,
         'TRK' || CAST(event_id AS VARCHAR) AS tracking_number,
         CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 3 = 0 THEN ''
              ELSE 'low stock ' || CAST(json_extract(props, '$.k') AS INTEGER) END AS reason
  FROM events),
v AS (SELECT *, command = 'cancel' OR (command = 'dispatch' AND carrier IN ('AUSPOST_PARCEL', 'STARTRACK', 'TOLL')) AS vt,
             last_value(CASE WHEN command IN ('acknowledge', 'backorder') THEN command END IGNORE NULLS)
               OVER (PARTITION BY order_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ab
      FROM c),
t AS (SELECT order_id, arg_min(command, (ts, seq)) AS t_cmd, min((ts, seq)) AS t_ord FROM v WHERE vt GROUP BY order_id),
r AS (
  SELECT v.*, t.t_cmd, t.t_ord,
         CASE prev_ab WHEN 'acknowledge' THEN 'ACKNOWLEDGED' WHEN 'backorder' THEN 'BACKORDERED' ELSE 'ORDER' END AS state_before,
         (t.t_ord IS NULL OR (v.ts, v.seq) < t.t_ord) AS before_t, (v.ts, v.seq) = t.t_ord AS at_t
  FROM v LEFT JOIN t ON v.order_id = t.order_id),
e AS (
  SELECT order_id, ts, seq, command, carrier, service, tracking_number, reason,
         CASE WHEN before_t THEN command = 'backorder' OR (command = 'acknowledge' AND state_before <> 'ACKNOWLEDGED')
              WHEN at_t THEN TRUE ELSE (t_cmd = 'cancel' AND command = 'cancel') END AS accepted,
         CASE WHEN before_t OR at_t THEN state_before WHEN t_cmd = 'dispatch' THEN 'DISPATCHED'
              ELSE 'CANCELLATION_ACK' END AS state_before,
         CASE WHEN before_t THEN (CASE command WHEN 'acknowledge' THEN 'ACKNOWLEDGED' WHEN 'backorder' THEN 'BACKORDERED'
                                  ELSE state_before END)
              WHEN t_cmd = 'dispatch' THEN 'DISPATCHED' ELSE 'CANCELLATION_ACK' END AS state_after
  FROM r)
"""


@query("lifecycle_commands", f"WITH {_CTE} SELECT * FROM e")
def lifecycle_commands(spark, sf_dir):
    """DML-14: every command with accepted flag and states before/after, replayed in (ts, event) order."""
    return L.replay_commands(commands(spark, sf_dir))


@query("lifecycle_orders", f"""WITH {_CTE}
SELECT order_id, arg_max(state_after, (ts, seq)) AS status, count(*) AS n_commands,
       count(*) FILTER (WHERE accepted) AS n_accepted,
       arg_max(carrier, (ts, seq)) FILTER (WHERE accepted AND command = 'dispatch') AS dispatch_carrier,
       arg_max(service, (ts, seq)) FILTER (WHERE accepted AND command = 'dispatch') AS delivery_service_code,
       arg_max(tracking_number, (ts, seq)) FILTER (WHERE accepted AND command = 'dispatch') AS dispatch_tracking_number,
       arg_max(ts, (ts, seq)) FILTER (WHERE accepted AND command = 'dispatch') AS dispatch_ts,
       COALESCE(string_agg(' | Backorder: ' || reason, '' ORDER BY ts, seq)
                FILTER (WHERE accepted AND command = 'backorder' AND reason <> ''), '') AS comment
FROM e GROUP BY order_id""")
def lifecycle_orders(spark, sf_dir):
    """DML-14: final status per order, dispatch fields and the backorder comment."""
    return L.final_orders(L.replay_commands(commands(spark, sf_dir)))


@query("lifecycle_stream_commands", f"""WITH {_CTE}
SELECT order_id, ts, seq, command, accepted, state_before, state_after FROM e""")
def lifecycle_stream_commands(spark, sf_dir):
    """STM-2: the same commands replayed by the keyed stream (per-order state in
    the state store, availableNow into a Parquet sink); must equal the batch form."""
    import uuid
    from stockspark.session import checkpoint_dir
    from stockspark.streaming.lifecycle_stream import run_lifecycle_stream
    work = f"{checkpoint_dir(spark).rstrip('/')}/streams/lifecycle-{uuid.uuid4().hex}"
    return run_lifecycle_stream(commands(spark, sf_dir), work)
