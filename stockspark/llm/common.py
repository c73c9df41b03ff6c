"""Helpers shared by the operators: session set-up and whole-batch word hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.session import checkpoint_dir, ship_package

# Fixed by the word definition used everywhere: [^\x20\x09-\x0D]+
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"

ROWS_PER_BATCH = 256


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python workers and keep Arrow batches
    small enough (rows of whole texts) for bounded worker memory."""
    checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{what}-{uuid.uuid4().hex}"


def save(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write once to the shared folder, read back."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text as an array; null text gives no words."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(flat, " "), "")


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once and bound as ``v``."""
    return F.transform(F.array(value), body)[0]


# ----------------------------------------------------------------- word hashing

_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = int(_rng.integers(1, 2**62)) | 1
_INV = pow(_BASE, -1, 2**64)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACE_BYTES)] = False
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, BLOCK), base, dtype=np.uint64)
        p[0] = 1
        have = _powers[base] = np.cumprod(p, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (every input bit reaches every output bit)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8_batch(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of an Arrow string column; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc
    arr = pc.fill_null(texts, "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type)
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1]
    offs = offs.astype(np.int64)
    if bufs[2] is None or len(offs) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[offs[0]:offs[-1]]
    return data, offs - offs[0]


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = False):
    """Hashes of all words of a batch of texts.

    Returns (hash uint64, start byte, end byte, word offset of each text). The
    hash is a polynomial over the word's bytes, taken from running sums, so
    the work is a few numpy passes over the bytes; blocks of about a megabyte
    keep the temporaries small however long a text is.
    """
    table = _LOWER if lower else _BYTE
    n = len(data)
    hashes, starts, ends = [], [], []
    lo = 0
    is_bound = np.zeros(n + 1, dtype=bool)
    is_bound[offs] = True
    while lo < n:
        hi = min(n, lo + BLOCK)
        while hi < n and _IS_WORD[data[hi - 1]] and _IS_WORD[data[hi]] and not is_bound[hi]:
            step = np.flatnonzero(~_IS_WORD[data[hi:hi + 4096]] | is_bound[hi:hi + 4096][:len(data[hi:hi + 4096])])
            hi = hi + int(step[0]) if len(step) else min(n, hi + 4096)
            if len(step):
                break
        b = data[lo:hi]
        w = _IS_WORD[b]
        brk = is_bound[lo:hi + 1]
        first = w.copy()
        first[1:] &= ~w[:-1] | brk[1:-1]
        last = w.copy()
        last[:-1] &= ~w[1:] | brk[1:-1]
        s = np.flatnonzero(first)
        e = np.flatnonzero(last) + 1
        run = np.empty(len(b) + 1, dtype=np.uint64)
        run[0] = 0
        np.cumsum(table[b] * _power(_BASE, len(b))[:len(b)], out=run[1:])
        h = (run[e] - run[s]) * _power(_INV, len(b))[s]
        hashes.append(mix(h + (e - s).astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    if not hashes:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offs), np.int64)
    s = np.concatenate(starts)
    return np.concatenate(hashes), s, np.concatenate(ends), np.searchsorted(s, offs).astype(np.int64)


_STEP = _U(0xD6E8FEB86659FD93)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive entries (length len(h) - k + 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = _power(int(_STEP), len(h))
    inv = _power(pow(int(_STEP), -1, 2**64), len(h))
    run = np.empty(len(h) + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum(h * p[:len(h)], out=run[1:])
    return mix((run[k:] - run[:-k]) * inv[:n] + _U(k))


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5):
    """Per text: the sorted distinct hashes of its k-word shingles (A-Z
    lower-cased); a shorter text with words is one shingle, none is empty."""
    h, _, _, woff = word_hashes(data, offs, lower=True)
    for a, b in zip(woff[:-1], woff[1:]):
        if b == a:
            yield np.zeros(0, np.uint64)
        else:
            yield np.unique(gram_hashes(h[a:b], min(k, int(b - a))))


# ----------------------------------------------------------------- small tables

BROADCAST_BYTES = 8 << 20
HOT_ROWS = 100_000
HOT_KEYS = 1000


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], salt: list[str], how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``table``, whose ``keys`` are unique; null keys match null.

    Both should be written tables: the bytes of ``table`` are summed first. Up to
    BROADCAST_BYTES it is broadcast. Otherwise keys of over HOT_ROWS rows (at most
    HOT_KEYS keys) are dealt by ``salt`` to as many tasks as they need, and their
    row of ``table`` is repeated for each; other keys are joined as they are.
    """
    named = [f"_key{i}" for i in range(len(keys))]
    table = table.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], *[c for c in table.columns if c not in keys])

    def same(left: list[str], right: list[str]) -> list[Column]:
        return [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)]

    small = (table.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0) <= BROADCAST_BYTES
    if small:
        return rows.join(F.broadcast(table), same(keys, named), how).drop(*named)
    bound = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot_key = [f"_hot{i}" for i in range(len(keys))]
    hot = save(rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, hot_key)]).agg(F.ceil(F.count("*") / bound).alias("_deals"))
               .where("_deals > 1"), "hot-keys")
    rows = rows.join(F.broadcast(hot), same(keys, hot_key), "left").withColumn(
        "_deal", F.coalesce(F.pmod(F.xxhash64(*salt), F.col("_deals")), F.lit(0).cast("long"))).drop(*hot_key, "_deals")
    table = table.join(F.broadcast(hot), same(named, hot_key), "left").withColumn(
        "_dealt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_deals", F.lit(1).cast("long")) - 1))).drop(*hot_key, "_deals")
    return rows.join(table, [*same(keys, named), F.col("_deal") == F.col("_dealt")], how).drop(*named, "_deal", "_dealt")
