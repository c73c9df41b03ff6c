"""Declared constraints of a set of tables: violations, and deletes with their consequences (SRC-10, JN-14, DML-8, DML-10).

A ``Constraints`` value declares required columns, unique columns, checks and foreign
keys. ``violations`` finds every breach by one pass a table, one aggregate a unique
column and one anti join a foreign key. ``delete_rows`` follows the foreign keys from
the rows that are to go: CASCADE takes the referring rows along, SET NULL clears the
reference, RESTRICT refuses the request. Each request is judged on its own: a refused
one changes nothing, the others go through.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.config import ORDER_STATUSES, PACK_SIZES
from stockspark.session import checkpoint_dir, materialize

CASCADE, SET_NULL, RESTRICT = "cascade", "set null", "restrict"


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    on_delete: str = RESTRICT


@dataclass(frozen=True)
class Constraints:
    """``checks``: per table, rule name -> SQL condition that a row must not make false."""
    required: Mapping[str, Sequence[str]] = field(default_factory=dict)
    unique: Mapping[str, Sequence[str]] = field(default_factory=dict)
    checks: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    foreign: Sequence[ForeignKey] = ()


#: The order book: names, skus and references as its tables declare them, values as its commands allow them.
BOOK = Constraints(
    required={"suppliers": ["name"], "products": ["sku", "name", "quantity", "price"],
              "orders": ["customer_name", "order_date", "status"],
              "order_items": ["order_id", "product_id", "quantity", "price_at_order"]},
    unique={"suppliers": ["name"], "products": ["sku"]},
    checks={"products": {"quantity >= 0": "quantity >= 0", "price > 0": "price > 0",
                         "pack size": "pack_size IN (" + ", ".join(f"'{p}'" for p in PACK_SIZES) + ")"},
            "orders": {"status": "status IN (" + ", ".join(f"'{s}'" for s in ORDER_STATUSES) + ")"},
            "order_items": {"quantity > 0": "quantity > 0"}},
    foreign=(ForeignKey("products", "supplier_id", "suppliers", SET_NULL),
             ForeignKey("order_items", "order_id", "orders", CASCADE),
             ForeignKey("order_items", "product_id", "products", RESTRICT)))


def violations(tables: Mapping[str, DataFrame], rules: Constraints) -> DataFrame:
    """(table, rule, value, n): breaches by rule and offending value; null values of required columns, the
    values of failed checks' rows by id, repeated unique values, references to no row."""
    parts = []
    for name, df in tables.items():
        broken = [F.when(F.col(c).isNull(), F.lit(f"{c} required")) for c in rules.required.get(name, ())]
        broken += [F.when(~F.expr(sql), F.lit(rule)) for rule, sql in rules.checks.get(name, {}).items()]
        if broken:
            value = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
            rows = df.select(value.alias("value"), F.explode(F.array_compact(F.array(*broken))).alias("rule"))
            parts.append(rows.groupBy("rule", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(name)))
        for c in rules.unique.get(name, ()):
            same = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
            parts.append(same.where("n > 1").withColumn("rule", F.lit(f"{c} unique")).withColumn("table", F.lit(name)))
    for fk in rules.foreign:
        if fk.table not in tables or fk.parent not in tables:
            continue
        refs = tables[fk.table].where(F.col(fk.column).isNotNull()).groupBy(F.col(fk.column).alias("_ref")).agg(F.count(F.lit(1)).alias("n"))
        lost = refs.join(tables[fk.parent].select(F.col("id").alias("_ref")), "_ref", "left_anti")
        parts.append(lost.select(F.col("_ref").cast("string").alias("value"), "n", F.lit(f"{fk.column} refers to {fk.parent}").alias("rule"),
                                 F.lit(fk.table).alias("table")))
    if not parts:
        raise ValueError("no rule concerns these tables")
    out = parts[0].select("table", "rule", "value", "n")
    for p in parts[1:]:
        out = out.unionByName(p.select("table", "rule", "value", "n"))
    return out


def _closure(tables: Mapping[str, DataFrame], rules: Constraints, requested: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Per table that others refer to: (root, root_id, id) of the rows that go with each request."""
    parents = {fk.parent for fk in rules.foreign} | set(requested)
    going: dict[str, DataFrame] = {}
    for name, ids in requested.items():
        there = tables[name].select("id").join(ids.select("id").distinct(), "id", "left_semi")
        going[name] = materialize(there.select(F.lit(name).alias("root"), F.col("id").cast("long").alias("root_id"), F.col("id").cast("long").alias("id")))
    fresh = dict(going)
    while fresh:  # one step along the foreign keys; tables that refer to themselves go as deep as their rows
        found: dict[str, DataFrame] = {}
        for fk in rules.foreign:
            if fk.on_delete != CASCADE or fk.parent not in fresh or fk.table not in parents or fk.table not in tables:
                continue
            child = tables[fk.table].select(F.col("id").cast("long").alias("_child"), F.col(fk.column).alias("_ref"))
            more = child.join(fresh[fk.parent], F.col("_ref") == F.col("id")).select("root", "root_id", F.col("_child").alias("id"))
            found[fk.table] = found[fk.table].unionByName(more) if fk.table in found else more
        fresh = {}
        for name, more in found.items():
            more = more.distinct()
            if name in going:
                more = more.join(going[name], ["root", "root_id", "id"], "left_anti")
            more = materialize(more)
            if more.limit(1).count():
                fresh[name] = more
                going[name] = going[name].unionByName(more) if name in going else more
    return going


def delete_rows(tables: Mapping[str, DataFrame], rules: Constraints, requested: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete ``requested`` (table -> frame with ``id``) and what goes with it. Returns (tables, refused (table, id)).

    A request is refused if a row refers by RESTRICT to it or to a row that would go
    with it. Unknown ids are no requests. Tables without ``id`` may refer to others."""
    any_frame = next(iter(tables.values()))
    checkpoint_dir(any_frame.sparkSession)
    going = _closure(tables, rules, requested)
    refused = any_frame.sparkSession.createDataFrame([], "root string, root_id long")
    for fk in rules.foreign:
        if fk.on_delete == RESTRICT and fk.parent in going and fk.table in tables:
            refs = tables[fk.table].select(F.col(fk.column).cast("long").alias("id"))
            refused = refused.unionByName(going[fk.parent].join(refs, "id", "left_semi").select("root", "root_id"))
    refused = materialize(refused.distinct())
    gone = {name: materialize(rows.join(refused, ["root", "root_id"], "left_anti").select("id").distinct()) for name, rows in going.items()}
    out = {}
    for name, df in tables.items():
        new = df
        if name in gone:
            new = new.join(gone[name], "id", "left_anti")
        for fk in rules.foreign:
            if fk.table != name or fk.parent not in gone:
                continue
            ids = gone[fk.parent].select(F.col("id").alias("_gone"))
            if fk.on_delete == CASCADE and name not in gone:
                new = new.join(ids, F.col(fk.column) == F.col("_gone"), "left_anti")
            elif fk.on_delete == SET_NULL:
                new = new.join(ids, F.col(fk.column) == F.col("_gone"), "left").withColumn(
                    fk.column, F.when(F.col("_gone").isNull(), F.col(fk.column))).drop("_gone")
        out[name] = new.select(*df.columns)
    return out, refused.select(F.col("root").alias("table"), F.col("root_id").alias("id"))
