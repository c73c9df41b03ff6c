"""STM-3: stock ledger deltas as a running total per product (update mode).

The running sums live in Spark's state store; a micro-batch hands on only the products
that it touched. These go as a delta folder to a published table (``sinks.tableset``):
readers see the totals before a batch or after it, never a part, and a retried batch
is published once. The table is written whole only when its deltas are compacted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.sinks.tableset import KeyedState, TableSet

JOB = "ledger"


def running_deltas(deltas: DataFrame, key: str = "product_id", delta: str = "delta") -> DataFrame:
    """Streaming sum of deltas per product; partial aggregation before the shuffle,
    totals kept in the state store."""
    return deltas.groupBy(key).agg(F.sum(delta).alias("delta_total"), F.count(F.lit(1)).alias("n_deltas"))


def apply_totals(products: DataFrame, totals: DataFrame, key: str = "product_id") -> DataFrame:
    """Current stock = snapshot quantity + running delta total (DML-9)."""
    t = totals.select(F.col(key).alias("_pid"), "delta_total")
    j = products.join(t, products["id"] == F.col("_pid"), "left")
    return j.select(*[F.col(c) for c in products.columns if c != "quantity"],
                    (F.col("quantity") + F.coalesce(F.col("delta_total"), F.lit(0))).alias("quantity"))


def totals_table(tables: TableSet, key: str = "product_id") -> KeyedState:
    """The published totals of the products that any delta named."""
    return KeyedState(tables, "totals", key, f"{key} long, delta_total long, n_deltas long")


def publish_totals(tables: TableSet, batch: DataFrame, batch_id: int, key: str = "product_id") -> bool:
    """One micro-batch of changed totals; False if it was published before."""
    state = totals_table(tables, key)
    if tables.done(JOB, batch_id):
        return False
    rows = batch.where(F.col(key).isNotNull())  # a delta without a product is nobody's stock
    return tables.publish(JOB, batch_id, *state.changed(rows, batch_id))


def start_ledger(deltas: DataFrame, tables: TableSet, checkpoint: str, key: str = "product_id", delta: str = "delta",
                 available_now: bool = True):
    """Keep the totals of a stream of deltas; ``tables`` belongs to one ``checkpoint``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        publish_totals(tables, batch, batch_id, key)

    w = (running_deltas(deltas, key, delta).writeStream.outputMode("update").foreachBatch(run)
         .option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if available_now else w).start()


def run_ledger_stream(deltas: DataFrame, work_dir: str, key: str = "product_id", delta: str = "delta",
                      files_per_batch: int | None = None) -> DataFrame:
    """Stage delta rows as files, stream them (availableNow) and return the published totals."""
    spark = deltas.sparkSession
    src = f"{work_dir}/in"
    deltas.select(key, delta).write.mode("overwrite").parquet(src)
    reader = spark.readStream.schema(spark.read.parquet(src).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    tables = TableSet(spark, f"{work_dir}/totals")
    start_ledger(reader.parquet(src), tables, f"{work_dir}/ckpt", key, delta).awaitTermination()
    return totals_table(tables, key).current()
