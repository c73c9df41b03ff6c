"""Bulk insert and update under a unique key, in sequence (DML-10, DML-12).

Each command claims a key (a supplier's name, a product's sku) for an entity: the
row it updates, or the one it inserts. It is granted when no other entity holds the
key at that moment; a granted rename frees the key held before, which a later command
may take. So a verdict depends on earlier verdicts on the same key and entity.

``settle`` finds all verdicts as a fix-point. Per round, from what is decided so far:

* an entity surely holds a key up to its next command that may be granted, and has
  surely left it after its next granted one;
* a claim is refused when another entity's last granted claim of the key surely still
  holds, and granted when no undecided claim of the key came since that one and its
  entity has surely left it (or is the claimant, or there is none).

All commands before the first undecided one are decided, so every round decides at
least that one; the loop ends when none is left. A round holds the undecided claims
and the granted ones that may still judge one of them. Scans of large keys and
entities are two-level, so neither lands in one task. Every round is a written table.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from stockspark.config import PACK_SIZES
from stockspark.functions.keys import strip_ws
from stockspark.functions.numeric import py_float, py_int
from stockspark.operators.ordering import add_buckets, global_row_number, segmented_last
from stockspark.session import checkpoint_dir, materialize, scratch_folder


def _around(d: DataFrame, by: str, order: Column, bucket: str, back: str, last: dict, next_state: str) -> DataFrame:
    """``d`` with the ``last`` non-null values before each row of its ``by`` in ``order``, and the state of the row after it."""
    if bucket not in d.columns:
        w = Window.partitionBy(by).orderBy(order)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        return d.select("*", *[F.last(v, ignorenulls=True).over(before).alias(n) for n, v in last.items()],
                        F.lead("state").over(w).alias(next_state))
    return segmented_last(segmented_last(d, [by], [order], last, bucket), [by], [-order], {next_state: F.col("state")}, back)


def settle(claims: DataFrame, holders: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """``claims`` (seq > 0, unique; entity; key) with ``granted``, against ``holders`` (entity, key) at the start.

    A round reads and writes undecided claims and those granted ones that may still judge one: a claim
    that is followed by an undecided one of its key (it may hold the key then), or that follows an
    undecided one of its entity (which it may end). Refused claims judge nothing. When the next claim of a
    holder's entity is granted, its time is kept in ``gone``, so the entity's later claims are not needed."""
    concerned = holders.join(claims.select("entity").distinct(), "entity", "left_semi").unionByName(
        holders.join(claims.select("key").distinct(), "key", "left_semi")).distinct()
    rows = claims.select("seq", "entity", "key", F.lit("U").alias("state")).unionByName(
        concerned.select(F.lit(0).cast("long").alias("seq"), "entity", "key", F.lit("A").alias("state")))
    d = materialize(rows.withColumn("gone", F.lit(None).cast("long")))
    d = add_buckets(d, "seq", n_buckets, "_kb", ["key"])
    d = add_buckets(d, "seq", n_buckets, "_eb", ["entity"])
    for c in ("_kb", "_eb"):
        if c in d.columns:
            d = d.withColumn(f"{c}_back", -F.col(c))
    rounds = scratch_folder(claims.sparkSession)
    seq, is_open, granted = F.col("seq"), F.col("state") == "U", F.col("state") == "A"
    kept, left, turn = d.columns, None, 0
    while left != 0:
        turn += 1
        # what follows in the same entity: its next command that is not refused, its next granted one
        ahead = _around(d, "entity", -seq, "_eb_back", "_eb", {
            "_next": F.struct("seq", "state"), "_left": F.when(granted, seq)}, "_before")
        ahead = ahead.withColumn("may_leave", F.coalesce("gone", "_next.seq")).withColumn("left", F.coalesce("gone", "_left"))
        seen = _around(ahead, "key", seq, "_kb", "_kb_back", {
            "held": F.when(granted, F.struct("seq", "entity", "may_leave", "left")), "open": F.when(is_open, seq)}, "_after")
        other = F.col("held").isNotNull() & (F.col("held.entity") != F.col("entity"))
        refused = other & F.coalesce(F.col("held.may_leave") > seq, F.lit(True))
        free = ~other | F.coalesce(F.col("held.left") < seq, F.lit(False))
        settled = F.col("open").isNull() | F.coalesce(F.col("open") < F.col("held.seq"), F.lit(False))
        verdict = F.when(~is_open, F.col("state")).when(refused, "R").when(free & settled, "A").otherwise("U")
        gone = F.coalesce("gone", F.when(granted & (F.col("_next.state") == "A"), F.col("_next.seq")))
        new = (seen.where(is_open | F.coalesce(F.col("_after") == "U", F.lit(False)) | F.coalesce(F.col("_before") == "U", F.lit(False)))
               .select(*[c for c in kept if c not in ("state", "gone")], verdict.alias("state"), gone.alias("gone"),
                       is_open.alias("_decides")))
        watch = Observation(f"claims-round-{turn}")
        done = materialize(new.observe(watch, F.count_if(is_open).alias("u")), f"{rounds}/turn={turn}")
        left, d = watch.get["u"], done.where("state <> 'R'").drop("_decides")
    return claims.sparkSession.read.parquet(rounds).where(F.col("_decides") & ~is_open).select("seq", "entity", "key", granted.alias("granted"))


def apply_commands(existing: DataFrame, commands: DataFrame, key: str, values: Sequence[str], taken: Column) -> tuple[DataFrame, DataFrame]:
    """``existing`` (id, values) after ``commands`` (seq, op insert or update, id, error, values).

    Commands with an error change nothing, nor do updates of an id that is not in the
    table. Returns (table, log of seq, op, id, action, message); ``taken`` is the message of a refused
    claim. Inserted rows get ids after the largest one, in sequence.
    """
    checkpoint_dir(existing.sparkSession)
    commands = materialize(commands)
    sound = commands.where(F.col("error").isNull())
    there = existing.select(F.col("id").alias("_there"))
    insert = F.col("op") == "insert"
    sound = sound.join(there, ~insert & (F.col("id") == F.col("_there")), "left")
    # an insert is an entity of its own, below 0; settle counts from 1
    shift = max(0, 1 - int(commands.agg(F.coalesce(F.min("seq"), F.lit(1))).first()[0]))
    at = F.col("seq") + shift
    claims = sound.where(insert | F.col("_there").isNotNull()).select(
        at.alias("seq"), F.when(insert, -at).otherwise(F.col("id")).cast("long").alias("entity"), F.col(key).alias("key"))
    verdicts = settle(claims, existing.where(F.col(key).isNotNull()).select(F.col("id").cast("long").alias("entity"), F.col(key).alias("key")))
    verdicts = materialize(verdicts.select((F.col("seq") - shift).alias("seq"), "entity", "granted"))
    base = int(existing.agg(F.max("id")).first()[0] or 0)
    born = global_row_number(verdicts.where("granted AND entity < 0").select("seq"), ["seq"], "_rank")
    born = born.select("seq", (F.col("_rank") + base).alias("new_id"))
    done = commands.join(verdicts, "seq", "left").join(born, "seq", "left")
    done = done.withColumn("id", F.when(F.col("op") == "update", F.col("id")).otherwise(F.col("new_id")))
    last = (done.where("granted").groupBy("id").agg(F.max_by(F.struct(*values), "seq").alias("_x")).select("id", "_x.*"))
    types = {f.name: f.dataType for f in existing.schema}
    table = existing.join(last.select("id"), "id", "left_anti").select("id", *values).unionByName(
        last.select(*[F.col(c).cast(types[c]).alias(c) for c in ("id", *values)]))
    refused = ~F.coalesce("granted", F.lit(True))
    action = (F.when(F.col("error").isNotNull() | refused, "refused").when(F.col("granted").isNull(), "no such row")
              .when(F.col("op") == "update", "updated").otherwise("inserted"))
    log = done.select("seq", "op", "id", action.alias("action"), F.coalesce("error", F.when(refused, taken)).alias("message"))
    return table, log


def _text(c: str) -> Column:
    return strip_ws(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def bulk_suppliers(existing: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DML-10: ``commands`` (seq, op, id, name, email, phone) on suppliers; a name is required and unique."""
    rows = commands.select("seq", "op", F.col("id").cast("long").alias("id"), _text("name").alias("name"),
                           _or_null(_text("email")).alias("email"), _or_null(_text("phone")).alias("phone"))
    rows = rows.withColumn("error", F.when(F.col("name") == "", "Name is required."))
    taken = F.format_string("A supplier with the name '%s' already exists.", F.col("name"))
    return apply_commands(existing, rows, "name", ["name", "email", "phone"], taken)


def bulk_products(existing: DataFrame, suppliers: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DML-10: ``commands`` (seq, op, id, sku, name, quantity, price, supplier, pack_size as text) on
    products; sku and name are required, the sku is unique, a supplier name that is unknown gives none."""
    quantity = F.when(_text("quantity") != "", py_int(F.col("quantity")))
    price = F.when(_text("price") != "", py_float(F.col("price")))
    rows = commands.select("seq", "op", F.col("id").cast("long").alias("id"), _text("sku").alias("sku"), _text("name").alias("name"),
                           quantity.alias("quantity"), price.alias("price"), F.coalesce("supplier", F.lit("")).alias("_supplier"),
                           _or_null(_text("pack_size")).alias("pack_size"))
    # names are unique: the join adds no rows
    names = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("_supplier"))
    rows = rows.join(names, "_supplier", "left").drop("_supplier")
    error = (F.when(F.col("quantity").isNull(), "Quantity must be an integer.")
             .when(F.col("price").isNull(), "Price must be a number.")
             .when(~F.col("pack_size").isin(*PACK_SIZES), "Invalid pack size.")
             .when((F.col("sku") == "") | (F.col("name") == ""), "SKU and Name are required."))
    taken = F.format_string("A product with the SKU '%s' already exists.", F.col("sku"))
    values = ["sku", "name", "quantity", "price", "supplier_id", "pack_size"]
    return apply_commands(existing, rows.withColumn("error", error), "sku", values, taken)


def create_products(existing: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DML-12: product documents (seq, sku, name, stock, sap_article_id) become products; a known sku is refused."""
    rows = payloads.select("seq", F.lit("insert").alias("op"), F.lit(None).cast("long").alias("id"), "sku", "name", "stock",
                           "sap_article_id", F.lit(None).cast("string").alias("error"))
    return apply_commands(existing, rows, "sku", ["sku", "name", "stock", "sap_article_id"], F.lit("SKU already exists"))
