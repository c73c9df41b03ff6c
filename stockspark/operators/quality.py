"""Mapping-quality metrics and distinct-row export (AGG-14, AGG-17, AGG-18)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.functions.keys import upper_strip
from stockspark.functions.numeric import parse_number


def mapping_quality(df: DataFrame, sku: str, account: str, qty: str, side: str,
                    upper_keys: bool = True, strip_keys: bool = True) -> DataFrame:
    """AGG-14 in one shuffle: per normalised key the row count and the row-level
    flags are reduced (partial aggregate), then the groups are summarised.
    Null keys are counted as true nulls (the dashboard's check never fires
    because it looks after null became "NAN")."""
    q = parse_number(F.col(qty))
    g = df.groupBy(upper_strip(F.col(sku), upper_keys, strip_keys).alias("_sk"),
                   upper_strip(F.col(account), upper_keys, strip_keys).alias("_ak")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col(sku).isNull()).alias("_ns"),
        F.count_if(F.col(account).isNull()).alias("_na"),
        F.count_if(q.isNull()).alias("_bad"),
        F.count_if(q < 0).alias("_neg"))
    return g.agg(
        F.coalesce(F.sum("_ns"), F.lit(0)).cast("bigint").alias("null_sku"),
        F.coalesce(F.sum("_na"), F.lit(0)).cast("bigint").alias("null_account"),
        F.coalesce(F.sum("_bad"), F.lit(0)).cast("bigint").alias("non_numeric_qty"),
        F.coalesce(F.sum("_neg"), F.lit(0)).cast("bigint").alias("negative_qty"),
        F.count_if(F.col("_n") > 1).alias("duplicate_key_groups"),
    ).select(F.lit(side).alias("side"), "*")


def side_counts(**sides: DataFrame) -> DataFrame:
    """AGG-17: row count per named side in one job (union of counts)."""
    out = None
    for name, df in sides.items():
        c = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("side"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG-18: distinct rows over the selected columns; null is treated as ''."""
    sel = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])
    return sel.distinct()


def first_occurrence(df: DataFrame, cols: Sequence[str], order_col: str = "_ord") -> DataFrame:
    """AGG-18/WIN-2 with payload: the first row (file order) of every distinct key."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols]
    rest = [c for c in df.columns if c not in cols and c != order_col]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), F.col(order_col)).alias("_r"))
    return g.select(*cols, *[F.col("_r")[c].alias(c) for c in rest])
