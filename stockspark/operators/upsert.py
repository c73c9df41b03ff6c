"""Set-based table mutations (DML-1..4, DML-9, DML-10, DML-12, DML-13, SRC-13, JN-14/15/18).

The tools apply imports one row at a time inside a transaction. Here each
import is one job: validate every row (errors keep their 1-based file
row number), then reduce the valid rows per key in file order with
partial aggregates (first/last by row number) and join once to the
current table. New ids continue after max(id) in order of first
appearance. Results are new table DataFrames plus an action log; writing
them (new snapshot, then swap) is the caller's transaction.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark.config import PACK_SIZES, ImportPolicy
from stockspark.functions.keys import strip_ws
from stockspark.functions.numeric import py_float, py_int
from stockspark.operators.ordering import global_row_number
from stockspark.session import checkpoint_dir, materialize


def _blank_to_null(c: Column) -> Column:
    s = strip_ws(c)
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


def _assign_new_ids(new_keys: DataFrame, key: str, first_row: str, base_max: int,
                    out: str = "id") -> DataFrame:
    """ids = max(existing id) + rank of first appearance (global row number, no single-partition window)."""
    ranked = global_row_number(new_keys, [first_row, key], "_rank")
    return ranked.select(*new_keys.columns, (F.lit(base_max).cast("bigint") + F.col("_rank")).alias(out))


def _max_id(table: DataFrame) -> int:
    """The current max id (0 for an empty table): one number."""
    return int(table.agg(F.max("id")).first()[0] or 0)


def number_rows(batch: DataFrame, order_col: str = "_ord", out: str = "row") -> DataFrame:
    """WIN-4: 1-based file row numbers for error messages."""
    return global_row_number(batch, [order_col], out)


# ------------------------------------------------------------------------------ suppliers

def upsert_suppliers(existing: DataFrame, batch: DataFrame, row_col: str = "row"):
    """DML-1: upsert by name; blank email/phone -> null; an existing name has both
    overwritten by the last row. Returns (suppliers, log)."""
    checkpoint_dir(batch.sparkSession)
    b = batch.select(F.col(row_col).alias("row"), strip_ws(F.coalesce(F.col("name"), F.lit(""))).alias("name"),
                     _blank_to_null(F.col("email")).alias("email"),
                     _blank_to_null(F.col("phone")).alias("phone"))
    b = materialize(b)
    valid = b.where(F.col("name") != "")
    per = valid.groupBy("name").agg(
        F.max_by(F.struct("email", "phone"), "row").alias("_last"), F.min("row").alias("_first"),
        F.count(F.lit(1)).alias("_n"))
    ex = existing.select(F.col("id").alias("_eid"), F.col("name").alias("_ename"))
    j = per.join(ex, per["name"] == ex["_ename"], "left")
    new = j.where(F.col("_eid").isNull()).select("name", "_first")
    new_ids = _assign_new_ids(new, "name", "_first", _max_id(existing), "_nid")
    j = j.join(new_ids.select("name", "_nid"), "name", "left")
    touched = j.select(F.coalesce("_eid", "_nid").alias("id"), "name", F.col("_last.email").alias("email"),
                       F.col("_last.phone").alias("phone"))
    untouched = existing.join(per.select(F.col("name").alias("_n2")), existing["name"] == F.col("_n2"), "left_anti")
    suppliers = untouched.select("id", "name", "email", "phone").unionByName(touched)
    inserted_names = j.where(F.col("_eid").isNull()).select("name", F.col("_first").alias("_ins_row"))
    log = (b.join(inserted_names, "name", "left")
           .select("row", "name",
                   F.when(F.col("name") == "", "error").when(F.col("row") == F.col("_ins_row"), "inserted")
                    .otherwise("updated").alias("action"),
                   F.when(F.col("name") == "", F.lit("Supplier 'name' is required.")).alias("message")))
    return suppliers, log


# ------------------------------------------------------------------------------ products

def _validate_core(batch: DataFrame, policy: ImportPolicy, keep) -> DataFrame:
    """DML-3 row checks without the message text: values plus an error code
    (1 sku/name missing, 2 bad quantity, 3 bad price; null when valid)."""
    sku = strip_ws(F.coalesce(F.col("sku").cast("string"), F.lit("")))
    name = strip_ws(F.coalesce(F.col("name").cast("string"), F.lit("")))
    qcol = "quantity" if "quantity" in batch.columns else "qty"
    raw_pack = F.lower(strip_ws(F.coalesce(F.col("pack_size").cast("string"), F.lit(""))))
    # cells are parsed once, in a projection of their own; the checks below name them several times
    batch = batch.select("*", sku.alias("_sku"), name.alias("_name"), py_int(F.col(qcol)).alias("_q"),
                         py_float(F.col("price")).alias("_p"), raw_pack.alias("_raw_pack"))
    sku, name, q, p, raw_pack = map(F.col, ("_sku", "_name", "_q", "_p", "_raw_pack"))
    q_bad = q.isNull() | (F.lit(policy.enforce_quantity_ge_zero) & (q < 0))
    # Spark orders NaN above every number; Python's nan > 0 is False.
    p_bad = p.isNull() | (F.lit(policy.enforce_price_gt_zero) & ~((p > 0) & ~F.isnan(p)))
    code = F.when((sku == "") | (name == ""), 1).when(q_bad, 2).when(p_bad, 3)
    q_val = q if policy.enforce_quantity_ge_zero else F.when(q < 0, F.lit(0).cast("bigint")).otherwise(q)
    p_val = p if policy.enforce_price_gt_zero else F.when((p <= 0) & ~F.isnan(p), F.lit(0.01)).otherwise(p)
    if policy.forced_supplier is not None:
        sup = F.lit(policy.forced_supplier)
    else:
        sup = _blank_to_null(F.coalesce(F.col("supplier").cast("string"), F.lit("")))
    if policy.blank_pack == "clear":
        pack_set = F.lit(True)             # blank -> null -> clears
    else:
        pack_set = raw_pack != ""          # blank keeps the current pack
    pack_val = F.when(raw_pack.isin(*PACK_SIZES), raw_pack)
    return batch.select(*keep, sku.alias("sku"), name.alias("name"), q_val.cast("bigint").alias("quantity"),
                        p_val.alias("price"), sup.alias("supplier"), pack_set.alias("_pack_set"),
                        pack_val.alias("_pack"), code.alias("_err"))


def _with_messages(v: DataFrame) -> DataFrame:
    row, sku, code = F.col("row"), F.col("sku"), F.col("_err")
    err = (F.when(code == 1, F.format_string("Row %d: 'sku' and 'name' required.", row))
           .when(code == 2, F.format_string("Row %d (SKU %s): invalid 'quantity' (>=0).", row, sku))
           .when(code == 3, F.format_string("Row %d (SKU %s): invalid 'price' (>0).", row, sku)))
    return v.withColumn("error", err).drop("_err")


def validate_products(batch: DataFrame, policy: ImportPolicy = ImportPolicy(), row_col: str = "row") -> DataFrame:
    """DML-3 row checks; adds quantity/price values and an ``error`` text (null when valid)."""
    return _with_messages(_validate_core(batch, policy, [F.col(row_col).alias("row")]))


def _validated(batch: DataFrame, policy: ImportPolicy, row_col: str, order_col: str) -> DataFrame:
    """Validated batch, materialised once. Without a row-number column, rows are first
    numbered in file order (WIN-4): the numbering reads its input twice (range boundaries,
    then rows), so the checks of the cells come after it."""
    if row_col not in batch.columns:
        batch, row_col = global_row_number(batch, [order_col], "row").drop(order_col), "row"
    return _with_messages(materialize(_validate_core(batch, policy, [F.col(row_col).alias("row")])))


def resolve_suppliers(valid: DataFrame, suppliers: DataFrame):
    """JN-18: supplier names -> ids; unknown names become new suppliers (ids in order of
    first appearance). Returns (valid with supplier_id, new supplier rows)."""
    names = valid.where(F.col("supplier").isNotNull()).groupBy("supplier").agg(F.min("row").alias("_first"))
    ex = suppliers.select(F.col("id").alias("_sid"), F.col("name").alias("supplier"))
    j = names.join(ex, "supplier", "left")
    new = j.where(F.col("_sid").isNull()).select("supplier", "_first")
    new_ids = _assign_new_ids(new, "supplier", "_first", _max_id(suppliers), "_nid")
    ids = j.join(new_ids.select("supplier", "_nid"), "supplier", "left") \
           .select("supplier", F.coalesce("_sid", "_nid").alias("supplier_id"))
    # written, so that Spark knows its size: a short list is broadcast and the rows stay where
    # they are, also when most of them name one supplier or none
    ids = materialize(ids)
    out = valid.join(ids, "supplier", "left")
    new_rows = new_ids.select(F.col("_nid").alias("id"), F.col("supplier").alias("name"),
                              F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("phone"))
    return out, new_rows


def upsert_products(products: DataFrame, suppliers: DataFrame, batch: DataFrame,
                    policy: ImportPolicy = ImportPolicy(), row_col: str = "row", order_col: str = "_ord"):
    """DML-2/3/4 as one job. Returns (products, suppliers, errors, log).

    ``batch`` carries either 1-based file row numbers (``row_col``) or a file
    order column (``order_col``) from which they are numbered.

    Closed form per sku over its valid rows in file order: quantity = last row;
    name/price/supplier = last row when updatable, else the current value (or the
    first row's for a new sku); pack = last row that sets it (the inserting row
    always sets; valid -> value, invalid -> null), else the current pack.
    """
    # the validated batch feeds several outputs and the id assignment: it is
    # materialised once in the shared checkpoint folder (survives executor loss)
    v = _validated(batch, policy, row_col, order_col)
    errors = v.where(F.col("error").isNotNull()).select("row", "sku", F.col("error").alias("message"))
    valid = v.where(F.col("error").isNull()).drop("error")
    valid, new_suppliers = resolve_suppliers(valid, suppliers)
    ex = products.groupBy("sku").agg(
        F.first("id", ignorenulls=True).alias("_eid"), F.first("name", ignorenulls=True).alias("_ename"),
        F.first("price", ignorenulls=True).alias("_eprice"), F.first("supplier_id", ignorenulls=True).alias("_esup"),
        F.first("pack_size", ignorenulls=True).alias("_epack"))
    row = F.col("row")
    per = valid.groupBy("sku").agg(
        F.min("row").alias("_first"),
        F.max_by(F.struct("name", "quantity", "price", "supplier_id"), row).alias("_last"),
        F.min_by(F.struct("name", "price", "supplier_id", "_pack"), row).alias("_ins"),
        F.max_by(F.struct("_pack"), F.when(F.col("_pack_set"), row)).alias("_packrow"),
        F.bool_or("_pack_set").alias("_packed"))
    # one row per sku, needed for the new ids, the products and the log
    per = materialize(per.join(ex, "sku", "left"))
    exists = F.col("_eid").isNotNull()

    def attr(allowed: bool, last: str, existing: str, ins: str) -> Column:
        if allowed:
            return F.col(f"_last.{last}")
        return F.when(exists, F.col(existing)).otherwise(F.col(f"_ins.{ins}"))

    new_skus = per.where(~exists).select("sku", "_first")
    new_ids = _assign_new_ids(new_skus, "sku", "_first", _max_id(products), "_nid")
    per = per.join(new_ids.select("sku", "_nid"), "sku", "left")
    # the last row that sets the pack; the inserting row always sets it, and no row is before it
    pack = (F.when(F.col("_packed"), F.col("_packrow._pack")).when(exists, F.col("_epack"))
            .otherwise(F.col("_ins._pack")))
    touched = per.select(
        F.coalesce("_eid", "_nid").alias("id"), "sku",
        attr(policy.allow_update_name, "name", "_ename", "name").alias("name"),
        F.col("_last.quantity").alias("quantity"),
        attr(policy.allow_update_price, "price", "_eprice", "price").alias("price"),
        attr(policy.allow_update_supplier, "supplier_id", "_esup", "supplier_id").alias("supplier_id"),
        pack.alias("pack_size"))
    untouched = products.join(per.select(F.col("sku").alias("_s2")), products["sku"] == F.col("_s2"), "left_anti")
    cols = ["id", "sku", "name", "quantity", "price", "supplier_id", "pack_size"]
    out_products = untouched.select(*cols).unionByName(
        touched.select(*[F.col(c).cast(products.schema[c].dataType) for c in cols]))
    out_suppliers = suppliers.select("id", "name", "email", "phone").unionByName(new_suppliers)
    ins = per.where(~exists).select("sku", F.col("_first").alias("_ins_row"))
    log = (valid.select("row", "sku").join(ins, "sku", "left")
           .select("row", "sku", F.when(F.col("row") == F.col("_ins_row"), "inserted").otherwise("updated")
                   .alias("action")))
    return out_products, out_suppliers, errors, log


def import_summary(log: DataFrame, errors: DataFrame, n_errors_shown: int = 20):
    """AGG-15: inserted / updated / error counts (one row) and the first errors by row."""
    outcomes = log.select("action").unionByName(errors.select(F.lit("error").alias("action")))
    counts = outcomes.agg(F.count_if(F.col("action") == "inserted").alias("inserted"),
                          F.count_if(F.col("action") == "updated").alias("updated"),
                          F.count_if(F.col("action") == "error").alias("errors"))
    first = errors.orderBy("row").limit(n_errors_shown)
    return counts, first


# ------------------------------------------------------------------------------ stock

def apply_stock_deltas(products: DataFrame, deltas: DataFrame, key: str = "product_id",
                       delta: str = "delta") -> DataFrame:
    """DML-9: quantity + sum(delta) per product (deltas reduced before the join)."""
    s = deltas.groupBy(F.col(key).alias("_pid")).agg(F.sum(delta).alias("_d"))
    j = products.join(s, products["id"] == F.col("_pid"), "left")
    return j.select(*[F.col(c) for c in products.columns if c != "quantity"],
                    (F.col("quantity") + F.coalesce(F.col("_d"), F.lit(0))).cast(products.schema["quantity"].dataType)
                    .alias("quantity")).select(*products.columns)


def delete_orders(orders: DataFrame, items: DataFrame, to_delete: DataFrame):
    """DML-8: remove orders and their items (cascade); restock unless Cancelled.
    Returns (orders, items, stock deltas)."""
    d = to_delete.select(F.col("order_id").alias("_oid")).distinct()
    gone = orders.join(d, orders["id"] == F.col("_oid"), "left_semi")
    restock = items.join(gone.where(F.col("status") != "Cancelled").select(F.col("id").alias("_oid")),
                         items["order_id"] == F.col("_oid"), "left_semi") \
                   .select("product_id", F.col("quantity").alias("delta"))
    new_orders = orders.join(d, orders["id"] == F.col("_oid"), "left_anti")
    new_items = items.join(d, items["order_id"] == F.col("_oid"), "left_anti")
    return new_orders, new_items, restock


def delete_products(products: DataFrame, items: DataFrame, to_delete: DataFrame):
    """DML-10/JN-14: products referenced by any order line cannot be deleted.
    Returns (products, refused ids)."""
    d = to_delete.select(F.col("id").alias("_pid")).distinct()
    referenced = d.join(items.select(F.col("product_id").alias("_pid")), "_pid", "left_semi")
    deletable = d.join(referenced, "_pid", "left_anti")
    return products.join(deletable, products["id"] == F.col("_pid"), "left_anti"), referenced


def delete_suppliers(suppliers: DataFrame, products: DataFrame, to_delete: DataFrame):
    """DML-10: supplier delete sets product.supplier_id to null (ON DELETE SET NULL)."""
    d = to_delete.select(F.col("id").alias("_sid")).distinct()
    new_s = suppliers.join(d, suppliers["id"] == F.col("_sid"), "left_anti")
    p = products.join(d, products["supplier_id"] == F.col("_sid"), "left")
    new_p = p.select(*[F.when(F.col("_sid").isNotNull(), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if c == "supplier_id" else F.col(c) for c in products.columns])
    return new_s, new_p


def patch_stock(products: DataFrame, patches: DataFrame, order_col: str = "_ord"):
    """DML-12: stock patches by sku, each judged on its own: unknown sku and negative or
    missing stock are rejected, the last valid patch of a sku counts.
    Returns (products, rejects: the order column, sku, reason)."""
    # reduced per sku first: the last valid value, and every reject stays a row of its own
    negative = F.coalesce(F.col("stock") < 0, F.lit(True))
    skus = products.select(F.col("sku").alias("_k"))
    known = patches.join(skus, patches["sku"] == F.col("_k"), "left")
    rejects = known.where(F.col("_k").isNull() | negative).select(
        order_col, "sku", F.when(F.col("_k").isNull(), "Product not found").otherwise("Stock must be >= 0").alias("reason"))
    ok = patches.where(~negative).groupBy(F.col("sku").alias("_ps")).agg(F.max_by("stock", order_col).alias("_stock"))
    j = products.join(ok, products["sku"] == F.col("_ps"), "left")
    qcol = "stock" if "stock" in products.columns else "quantity"
    new = j.select(*[F.coalesce(F.col("_stock").cast(products.schema[c].dataType), F.col(c)).alias(c)
                     if c == qcol else F.col(c) for c in products.columns])
    return new, rejects


def seed_defaults(existing: DataFrame, defaults: DataFrame, key: str = "key") -> DataFrame:
    """SRC-13: insert-or-ignore defaults (left anti join) union the existing rows."""
    return defaults.join(existing.select(key), key, "left_anti").unionByName(existing.select(*defaults.columns))


def add_missing_columns(df: DataFrame, columns: dict) -> DataFrame:
    """DML-13: additive migration - add absent columns as typed nulls."""
    out = df
    for name, dtype in columns.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(dtype))
    return out


def reject_known(existing: DataFrame, batch: DataFrame, key: str, order_col: str = "_ord"):
    """JN-15: rows whose key already exists, or repeats an earlier row of the batch,
    are rejected (409); returns (accepted first rows, rejects)."""
    first = batch.groupBy(key).agg(F.min(order_col).alias("_first"))
    b = batch.join(first, key)
    dup_in_batch = F.col(order_col) != F.col("_first")
    ex = existing.select(F.col(key).alias("_ek")).distinct()
    j = b.join(ex, b[key] == F.col("_ek"), "left")
    rej = j.where(F.col("_ek").isNotNull() | dup_in_batch).select(
        *batch.columns, F.when(F.col("_ek").isNotNull(), "exists").otherwise("duplicate in batch").alias("reason"))
    acc = j.where(F.col("_ek").isNull() & ~dup_in_batch).select(*batch.columns)
    return acc, rej
