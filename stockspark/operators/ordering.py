"""Order-dependent building blocks (WIN-1..6, SRT-*), all skew-safe.

* keep last/first per key: ``max_by``/``min_by`` aggregates (partial
  aggregation before the shuffle, so a hot key costs one row per map task).
* global row numbers: range-partition + per-partition offsets, never a
  single-partition window.
* running sums / last-value scans per key: two-level scan over
  (key, sequence bucket) with quantile buckets, so one key holding a third
  of all rows is still split over many tasks.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockspark.functions.numeric import parse_number
from stockspark.session import materialize as materialize_df



def _cols(cs) -> list:
    if isinstance(cs, (str, Column)):
        cs = [cs]
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def order_struct(*cols) -> Column:
    """A single comparable ordering value from several columns."""
    cs = _cols(list(cols))
    return F.struct(*cs) if len(cs) > 1 else cs[0]


def keep_last(df: DataFrame, keys: Sequence[str], order_col: str, keep: str = "last") -> DataFrame:
    """WIN-1/WIN-2: one row per key, the last (or first) by ``order_col``.

    One ``max_by``/``min_by`` per payload column (the order value is unique
    per key, so all pick the same row; null payload values are kept). These
    are partial aggregates: each map task reduces its rows per key before
    the shuffle, so a hot key costs one row per task. Measured faster than
    ``max(struct(order, row))`` or ``max_by(struct(row), order)``.
    """
    payload = [c for c in df.columns if c not in keys and c != order_col]
    pick = F.max_by if keep == "last" else F.min_by
    ext = F.max if keep == "last" else F.min
    o = F.col(order_col)
    aggs = [pick(F.col(c), o).alias(c) for c in payload] + [ext(o).alias(order_col)]
    return df.groupBy(*keys).agg(*aggs)


def _leaf_columns(df: DataFrame, order_cols: Sequence) -> list:
    """Order columns flattened to leaf (non-struct) columns, in order."""
    from pyspark.sql import types as T
    out = []

    def walk(expr: Column, dtype) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(expr[f.name], f.dataType)
        else:
            out.append((expr, dtype))

    for c in order_cols:
        if isinstance(c, str):
            walk(F.col(c), df.schema[c].dataType)
        else:
            walk(c, df.select(c).schema.fields[0].dataType)
    return out


def global_row_number(df: DataFrame, order_cols: Sequence, out: str = "row_num",
                      num_partitions: int | None = None) -> DataFrame:
    """WIN-3/WIN-4: dense 1-based row number over a total order, without a
    single-partition window.

    Rows are range-partitioned on the (flattened) order key into
    ``spark.sql.shuffle.partitions`` partitions (sized for the data, as for
    any shuffle), sorted inside each, and tagged with their partition and
    position. That tagged frame is materialised once (Parquet in the shared
    checkpoint folder): Spark's range partitioner samples with a seed tied to
    the RDD, so re-running it could move boundaries - the written tags make the
    counts and the numbering agree, also after executor loss. Offsets are one
    row per partition (broadcast).
    """
    spark = df.sparkSession
    n = num_partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    leaves = _leaf_columns(df, order_cols)
    names = [f"_o{i}" for i in range(len(leaves))]
    d = df.select("*", *[e.alias(nm) for (e, _), nm in zip(leaves, names)])
    oc = [F.col(nm) for nm in names]
    ranged = (d.repartitionByRange(n, *oc).sortWithinPartitions(*oc)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
              .drop(*names))
    ranged = materialize_df(ranged)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    res = ranged.join(F.broadcast(offsets), "_pid")
    return res.withColumn(out, (F.col("_off") + F.col("_local") + 1).cast("bigint")) \
              .drop("_pid", "_local", "_off")


ROWS_PER_BUCKET = 500_000
MOST_BUCKETS = 4096  # boundaries are literals of the plan


def row_tasks(df: DataFrame) -> int:
    """Tasks of about ROWS_PER_BUCKET rows that ``df`` makes; 1 if it fits one."""
    return max(1, -(-df.count() // ROWS_PER_BUCKET))


def spread(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to ``tasks`` tasks, if those are more than run at a time: an
    aggregate over ``keys`` then holds a bounded number of rows a task, however many there are."""
    if tasks <= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(tasks, *keys)


def sequence_buckets(df: DataFrame, seq_col: str, n_buckets: int | None = None) -> Column:
    """Quantile bucket of ``seq_col``: buckets of about ROWS_PER_BUCKET rows (their
    number follows the row count), so any (key, bucket) group is bounded whatever
    the key skew. Only the boundaries reach the driver."""
    if n_buckets is None:
        n_buckets = min(MOST_BUCKETS, -(-df.count() // ROWS_PER_BUCKET))
    if n_buckets <= 1:
        return F.lit(0)
    rel_err = 0.1 / n_buckets
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = df.select(F.col(seq_col).cast("double").alias("_s")).approxQuantile("_s", probs, rel_err)
    bounds = sorted(set(b for b in bounds if b is not None))
    v = F.col(seq_col).cast("double")

    def tree(lo: int, hi: int) -> Column:
        # bucket index = number of boundaries <= v, as a balanced CASE tree
        # (log2(n) comparisons per row, plain codegen'd expressions)
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v < F.lit(float(bounds[mid])), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds)) if bounds else F.lit(0)


def segmented_scan(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], value_col: str,
                   out: str, how: str = "sum", inclusive: bool = True, bucket_col: str | None = None,
                   n_buckets: int | None = None) -> DataFrame:
    """Per-key running aggregate in ``order_cols`` order (WIN-5 sum, WIN-6 last non-null).

    Level 1: a window inside (key, bucket); level 2: per-(key, bucket) totals - at
    most one row per key and bucket - scanned per key to give the carry-in of each
    bucket. ``bucket_col`` (default: the first order column)
    must be numeric and non-decreasing along ``order_cols``; its quantiles
    define the buckets, so each bucket holds ~1/n of all rows whatever the
    key skew. ``order_cols`` must be unique within a key.
    """
    keys = list(keys)
    order_cols = list(order_cols)
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    bcol = bucket_col or order_cols[0]
    d = df.withColumn("_bkt", sequence_buckets(df, bcol, n_buckets))
    wl = Window.partitionBy(*keys, "_bkt").orderBy(*order_cols).rowsBetween(*frame)
    wc = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    v = F.col(value_col)
    if how == "sum":
        d = d.withColumn("_loc", F.sum(v).over(wl))
        tot = d.groupBy(*keys, "_bkt").agg(F.sum(v).alias("_bt"))
        carry = tot.select(*keys, "_bkt", F.sum("_bt").over(wc).alias("_carry"))
        d = d.join(carry, keys + ["_bkt"], "left")
        zero = F.lit(0).cast(d.schema[value_col].dataType)
        res = F.coalesce(F.col("_carry"), zero) + F.coalesce(F.col("_loc"), zero)
    elif how == "last":
        d = d.withColumn("_loc", F.last(v, ignorenulls=True).over(wl))
        tot = d.groupBy(*keys, "_bkt").agg(
            F.max_by(v, F.when(v.isNotNull(), order_struct(*order_cols))).alias("_bt"))
        carry = tot.select(*keys, "_bkt", F.last("_bt", ignorenulls=True).over(wc).alias("_carry"))
        d = d.join(carry, keys + ["_bkt"], "left")
        res = F.coalesce(F.col("_loc"), F.col("_carry"))
    else:
        raise ValueError(f"unknown scan {how!r}")
    return d.withColumn(out, res).drop("_bkt", "_loc", "_carry")


def add_buckets(df: DataFrame, seq_col: str, n_buckets: int | None = None, out: str = "_bkt",
                keys: Sequence[str] = ()) -> DataFrame:
    """Attach the quantile bucket of ``seq_col`` once, for repeated scans. With ``keys``, only those of
    more than ROWS_PER_BUCKET rows are cut into buckets; others have none (null), or the column is
    absent if no key is that large, and a scan takes them whole."""
    if not keys or n_buckets is not None:
        return df.withColumn(out, sequence_buckets(df, seq_col, n_buckets))
    large = materialize_df(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ROWS_PER_BUCKET)
                           .select(*[F.col(k).alias(f"_large_{k}") for k in keys]))
    if large.isEmpty():
        return df
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(F.col(f"_large_{k}"))
    bucket = sequence_buckets(df.join(large, same, "left_semi"), seq_col)
    held = df.join(large.withColumn("_large", F.lit(True)), same, "left")
    return held.withColumn(out, F.when(F.col("_large"), bucket)).drop("_large", *[f"_large_{k}" for k in keys])


def segmented_sums(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], values: dict,
                   inclusive: bool = False, bucket_col: str = "_bkt") -> DataFrame:
    """Several running sums per key as the two-level scan over ``bucket_col``, a bucket
    index that is non-decreasing along ``order_cols`` (see ``add_buckets``); keys without
    buckets are scanned whole."""
    keys = list(keys)
    if bucket_col not in df.columns:
        along = (Window.partitionBy(*keys).orderBy(*order_cols)
                 .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
        return df.select("*", *[F.coalesce(F.sum(col).over(along), F.lit(0)).alias(name) for name, col in values.items()])
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    d = df
    for name, col in values.items():
        d = d.withColumn(f"_v_{name}", col)
    wl = Window.partitionBy(*keys, bucket_col).orderBy(*order_cols).rowsBetween(*frame)
    wc = Window.partitionBy(*keys).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", *[F.sum(f"_v_{n}").over(wl).alias(f"_l_{n}") for n in values])
    tot = (d.where(F.col(bucket_col).isNotNull()).groupBy(*keys, bucket_col)
           .agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values]))
    carry = tot.select(*keys, bucket_col, *[F.sum(f"_t_{n}").over(wc).alias(f"_c_{n}") for n in values])
    d = d.join(carry, keys + [bucket_col], "left")
    outs = [(F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.coalesce(F.col(f"_l_{n}"), F.lit(0))).alias(n)
            for n in values]
    drop = [c for n in values for c in (f"_v_{n}", f"_l_{n}", f"_c_{n}")]
    return d.select(*[c for c in d.columns if c not in drop], *outs)


def segmented_last(df: DataFrame, keys: Sequence[str], order_cols: Sequence, values: dict, bucket_col: str = "_bkt") -> DataFrame:
    """The last non-null value before each row (exclusive), for several ``values`` per key, as the
    two-level scan over ``bucket_col`` (a bucket index that is non-decreasing along ``order_cols``);
    keys without buckets (null) are scanned whole."""
    keys, order = list(keys), _cols(order_cols)
    named = df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    wl = Window.partitionBy(*keys, bucket_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    wc = Window.partitionBy(*keys).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    d = named.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(wl).alias(f"_l_{n}") for n in values])
    at = order_struct(*order)
    tot = named.where(F.col(bucket_col).isNotNull()).groupBy(*keys, bucket_col).agg(*[
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_t_{n}") for n in values])
    carry = tot.select(*keys, bucket_col, *[F.last(f"_t_{n}", ignorenulls=True).over(wc).alias(f"_c_{n}") for n in values])
    d = d.join(carry, keys + [bucket_col], "left")
    return d.select(*df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values])


def typed_sort_key(df: DataFrame, col: str) -> tuple:
    """SRT-1: numeric order when every value parses (commas removed), else
    case-insensitive text with blanks last; a blank is no number. One aggregate decides."""
    num = parse_number(F.regexp_replace(F.col(col).cast("string"), ",", ""))
    if df.agg(F.bool_and(num.isNotNull()).alias("ok")).first()["ok"]:
        return (num,)
    text = F.coalesce(F.col(col).cast("string"), F.lit(""))
    return (text == "", F.lower(text))


def numeric_first_sort_key(col: str) -> tuple:
    """SRT-2: numeric value, unparsable = +inf, then text as tie-break."""
    num = parse_number(F.regexp_replace(F.col(col).cast("string"), ",", ""))
    return (F.coalesce(F.nanvl(num, F.lit(float("inf"))), F.lit(float("inf"))), F.col(col).cast("string"))


def page(df: DataFrame, order_cols: Sequence, offset: int = 0, limit: int = 50,
         max_limit: int = 200) -> DataFrame:
    """SRT-5: ORDER BY unique key, OFFSET/LIMIT; a limit outside 1..max_limit or a
    negative offset is refused."""
    _check_page(offset, limit, max_limit)
    return df.orderBy(*_cols(order_cols)).offset(int(offset)).limit(int(limit))


def _check_page(offset: int, limit: int, max_limit: int) -> None:
    if not 1 <= int(limit) <= int(max_limit):
        raise ValueError(f"limit must be between 1 and {max_limit}")
    if int(offset) < 0:
        raise ValueError("offset must be >= 0")


def keyset_page(df: DataFrame, key: str, after, limit: int = 50, max_limit: int = 200) -> DataFrame:
    """SRT-5, keyset variant: rows with key > after (pushed to the scan)."""
    _check_page(0, limit, max_limit)
    d = df if after is None else df.where(F.col(key) > F.lit(after))
    return d.orderBy(key).limit(int(limit))
