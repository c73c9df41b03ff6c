"""Table schemas of the order book and small constant dimensions (SRC-9..11, SRC-13, DML-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockspark.config import CARRIERS, SETTINGS_DEFAULTS

SUPPLIERS = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType(), False),
    T.StructField("email", T.StringType()), T.StructField("phone", T.StringType())])
PRODUCTS = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("sku", T.StringType(), False),
    T.StructField("name", T.StringType(), False), T.StructField("quantity", T.LongType(), False),
    T.StructField("price", T.DoubleType(), False), T.StructField("supplier_id", T.LongType()),
    T.StructField("pack_size", T.StringType())])
ORDERS = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("customer_name", T.StringType(), False),
    T.StructField("order_date", T.TimestampType(), False), T.StructField("status", T.StringType(), False)])
ORDER_ITEMS = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("order_id", T.LongType(), False),
    T.StructField("product_id", T.LongType(), False), T.StructField("quantity", T.IntegerType(), False),
    T.StructField("price_at_order", T.DoubleType(), False)])
SETTINGS = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), False)])

ADDRESS = T.StructType([T.StructField(n, T.StringType()) for n in
                        ("country", "line_1", "line_2", "city", "postal_code", "state", "phone", "full_name", "email")])
ORDER_DOC_ITEM = T.StructType([
    T.StructField("part_number", T.StringType()), T.StructField("retailer_sku_reference", T.StringType()),
    T.StructField("supplier_sku_reference", T.StringType()), T.StructField("line_reference", T.StringType()),
    T.StructField("quantity", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("unit_cost_price", T.StringType()),
    T.StructField("subtotal", T.StringType()), T.StructField("tax", T.StringType()),
    T.StructField("tax_rate", T.StringType()), T.StructField("total", T.StringType()),
    T.StructField("promised_date", T.TimestampType()), T.StructField("retailer_additional_reference", T.StringType())])
ORDER_DOC = T.StructType([
    T.StructField("order_reference", T.StringType(), False), T.StructField("order_date", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("retailer", T.StringType()), T.StructField("comment", T.StringType()),
    T.StructField("currency_code", T.StringType()), T.StructField("subtotal", T.StringType()),
    T.StructField("tax", T.StringType()), T.StructField("total", T.StringType()),
    T.StructField("shipping_address", ADDRESS),
    T.StructField("retailer_data", T.StructType([T.StructField("uuid", T.StringType()),
                                                 T.StructField("name", T.StringType()),
                                                 T.StructField("email", T.StringType()),
                                                 T.StructField("phone", T.StringType()),
                                                 T.StructField("tax_code", T.StringType()),
                                                 T.StructField("address", ADDRESS)])),
    T.StructField("items", T.ArrayType(ORDER_DOC_ITEM))])


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-10: a book table stored as parquet, read with its declared schema
    (older snapshots without newer columns are widened, DML-13)."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    for f in schema.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


_WIDER = {("int", "bigint"), ("int", "double"), ("smallint", "int"), ("smallint", "bigint"), ("float", "double"), ("date", "timestamp")}


def read_generations(spark: SparkSession, paths: list, schema: T.StructType, renamed: dict | None = None,
                     defaults: dict | None = None) -> DataFrame:
    """DML-13: the files of several generations of a table as one, in today's ``schema``.

    Each generation is read by its own schema. ``renamed`` (old name -> today's name)
    is the column history; a column that a generation lacks holds its ``defaults`` value
    or null; its type may only have been widened since (or become text), else the
    generation is refused."""
    out = None
    for path in paths:
        df = spark.read.parquet(path)
        for old, new in (renamed or {}).items():
            if old in df.columns and new not in df.columns:
                df = df.withColumnRenamed(old, new)
        cols = []
        for f in schema.fields:
            if f.name not in df.columns:
                cols.append(F.lit((defaults or {}).get(f.name)).cast(f.dataType).alias(f.name))
                continue
            was, now = df.schema[f.name].dataType.simpleString(), f.dataType.simpleString()
            if was != now and now != "string" and (was, now) not in _WIDER:
                raise ValueError(f"{path}: column {f.name} is {was}, not a narrower {now}")
            cols.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
        df = df.select(*cols)
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no generation given")
    return out


def carriers(spark: SparkSession) -> DataFrame:
    """SRC-11: the 3-row carrier dimension (code, name, services)."""
    return spark.createDataFrame([(c, n, list(s)) for c, n, s in CARRIERS],
                                 "code string, name string, services array<string>")


def settings_defaults(spark: SparkSession) -> DataFrame:
    """SRC-13 input: default settings as (key, value) text rows."""
    return spark.createDataFrame([(k, str(v)) for k, v in SETTINGS_DEFAULTS.items()], SETTINGS)


def parse_json_list(c, element: str = "string"):
    """SRC-9/JSN-1: a JSON list held in a text column; null unless it is a list."""
    col = F.col(c) if isinstance(c, str) else c
    t = F.trim(col)
    return F.when(t.startswith("["), F.from_json(t, f"array<{element}>"))
