"""STM-2: order lifecycle commands as a stream with per-order state.

Every micro-batch is replayed with the batch closed form
(``operators.lifecycle.replay_commands``), starting from the status that each of its
orders had: a first-terminal aggregate, a two-level "last acknowledge or backorder"
scan and row-wise logic. No order's commands are brought together in one task, however
many a batch holds. The statuses are a keyed state table (``sinks.tableset``): a
batch reads those of its orders and publishes those that it changed.

A batch writes its outcomes to a folder of its own, then publishes the state. A
retried batch either repeats both, or finds the state published and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.operators.lifecycle import replay_commands
from stockspark.operators.ordering import order_struct
from stockspark.sinks.tableset import KeyedState, TableSet

COLUMNS = ["order_id", "ts", "seq", "command", "carrier"]
OUTCOME = ["order_id", "ts", "seq", "command", "accepted", "state_before", "state_after"]
JOB = "lifecycle"


def order_states(tables: TableSet) -> KeyedState:
    return KeyedState(tables, "orders", "order_id", "order_id long, status string")


def replay_batch(tables: TableSet, batch: DataFrame, batch_id: int, out: str) -> None:
    """Outcomes of one micro-batch to ``out/batch=N``, then the new statuses of its orders."""
    if tables.done(JOB, batch_id):
        return
    states = order_states(tables)
    cmds = batch.select(*COLUMNS)
    initial = states.current().join(cmds.select("order_id").distinct(), "order_id", "left_semi")
    path = f"{out}/batch={batch_id}"
    replay_commands(cmds, n_buckets=None, initial=initial).select(*OUTCOME).write.mode("overwrite").parquet(path)
    written = tables.spark.read.parquet(path)
    status = written.groupBy("order_id").agg(F.max_by("state_after", order_struct("ts", "seq")).alias("status"))
    tables.publish(JOB, batch_id, *states.changed(status, batch_id))


def start_lifecycle_stream(commands: DataFrame, out: str, state_dir: str, checkpoint: str, available_now: bool = True):
    """Start the replay of a stream of commands; ``state_dir`` belongs to one ``checkpoint``."""
    tables = TableSet(commands.sparkSession, state_dir)

    def run(batch: DataFrame, batch_id: int) -> None:
        # staged: a micro-batch runs in a session without adaptive plans
        staged = f"{tables.root}/_staged"
        batch.select(*COLUMNS).write.mode("overwrite").parquet(staged)
        replay_batch(tables, tables.spark.read.parquet(staged), batch_id, out)

    w = commands.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def run_lifecycle_stream(commands: DataFrame, work_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Stage commands as files, replay them as a stream (availableNow) and return the outcomes.
    ``work_dir`` must be on the shared file system (e.g. under spark.checkpoint.dir)."""
    spark = commands.sparkSession
    src, out = f"{work_dir}/in", f"{work_dir}/out"
    commands.select(*COLUMNS).write.mode("overwrite").parquet(src)
    reader = spark.readStream.schema(spark.read.parquet(src).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    start_lifecycle_stream(reader.parquet(src), out, f"{work_dir}/state", f"{work_dir}/ckpt").awaitTermination()
    return spark.read.parquet(out).select(*OUTCOME)
