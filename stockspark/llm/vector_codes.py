"""Product codes of vectors, assigned by equal-average search.

A vector becomes integers floor(scale * x) and is cut into equal consecutive parts.
Each part position has a codebook; a part is replaced by the index of its nearest
entry (squared Euclidean distance, ties to the lower index). Codebooks start as the
parts of the vectors with the smallest ids, and each round replaces an entry by the
floor of the mean of its parts.

Search: entries are sorted by component sum. For a part of ``dim`` components whose
sum differs by g from that of an entry, the squared distance is at least g * g / dim.
So a search starts at the part's own sum and goes outward, to the side of the smaller
gap first, until g * g / dim exceeds the best distance; entries further out cannot win,
nor tie. All parts of a batch take a step at once; those that are done leave the batch.

A round is one pass over the written integer vectors: each task sums its parts by
entry, Spark adds the sums, and the driver gets one row per entry and component.

Rows whose vector is null or holds null or non-finite components are dropped, as the
contract says. Vectors shorter than the longest one are extended by zeros, also to a
multiple of ``parts``. Components beyond the range in which 64-bit distances stay
exact (over 20,000 for 64 dimensions) count as the end of that range. Rows with a
null vec_id are coded but start no entry; of rows that share a vec_id the smallest
vector starts one; each of them is coded. With fewer ids than entries the codebooks
are smaller; a table without vectors gives no rows. Null labels are a group of their
own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm.common import look_up, save
from stockspark.session import checkpoint_dir, ship_package

PARTS = 8
ENTRIES = 16  # at most 256: a code is two hex digits a part
ROUNDS = 6
SCALE = 4096
BATCH_NUMBERS = 1 << 20
_INT_END = 2**31 - 1
_FAR = np.int64(2**31)  # its square stays in 64 bits, no gap reaches it


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v array<int>) of the rows whose vector is whole and finite."""
    x = F.col("embedding")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))

    def number(c):
        wide = F.lit(float(scale)) * c.cast("double")
        return F.floor(F.least(F.greatest(wide, F.lit(-float(_INT_END))), F.lit(float(_INT_END)))).cast("int")

    return rows.select("vec_id", "label", "embedding").where(whole).select("vec_id", "label", F.transform(x, number).alias("v"))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest of ``entries`` (k, dim) for each row of ``x`` (n, dim)."""
    k, dim = entries.shape
    total = entries.sum(axis=1)
    order = np.argsort(total, kind="stable")
    sums = total[order]
    mine = x.sum(axis=1)
    right = np.searchsorted(sums, mine)
    left = right - 1
    best = np.full(len(x), np.iinfo(np.int64).max // max(dim, 1), dtype=np.int64)
    index = np.full(len(x), k, dtype=np.int64)
    rows = np.arange(len(x))
    while len(rows):
        lo, hi, s = left[rows], right[rows], mine[rows]
        down = np.where(lo >= 0, s - sums[np.maximum(lo, 0)], _FAR)
        up = np.where(hi < k, sums[np.minimum(hi, k - 1)] - s, _FAR)
        gap = np.minimum(down, up)
        go = (gap < _FAR) & (gap * gap <= best[rows] * dim)
        rows, lo, hi, below = rows[go], lo[go], hi[go], (down <= up)[go]
        entry = order[np.where(below, lo, hi)]
        d = ((x[rows] - entries[entry]) ** 2).sum(axis=1)
        better = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
        won = rows[better]
        best[won], index[won] = d[better], entry[better]
        left[rows] -= below
        right[rows] += ~below
    return index, best


def _limit(dim: int, parts: int) -> int:
    """Components up to this give exact distances, gaps and sums over parts in 64 bits."""
    return math.isqrt(2**61 // max(dim * dim, dim * parts, 1)) // 2


def _blocks(batches, width: int, parts: int):
    """(other columns, parts (n, parts, dim)) of Arrow batches, gathered to blocks of about BATCH_NUMBERS components."""
    import pyarrow as pa
    import pyarrow.compute as pc
    most = max(1, BATCH_NUMBERS // max(width, 1))

    def block(held):
        t = pa.Table.from_batches(held).combine_chunks()
        v = t.column("v").chunk(0)
        sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False)
        flat = v.flatten().to_numpy(zero_copy_only=False)
        x = np.zeros((len(v), width), dtype=np.int64)
        row = np.repeat(np.arange(len(v)), sizes)
        x[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        end = _limit(width // parts, parts)
        return t.drop_columns(["v"]), np.clip(x, -end, end).reshape(len(v), parts, width // parts)

    held, n = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            piece = batch.slice(lo, most)
            if n + piece.num_rows > most:
                yield block(held)
                held, n = [], 0
            held.append(piece)
            n += piece.num_rows
    if n:
        yield block(held)


class Codebooks:
    """``books``: one int64 array (entries, dim) a part position."""

    def __init__(self, books: np.ndarray):
        self.books = books

    @property
    def sha256(self) -> str:
        """Of all integer components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.books.shape

    def encode(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, label, code, error) of every row of ``integer_vectors``."""
        books = self.books
        parts, k, dim = books.shape

        def run(batches):
            import pyarrow as pa
            for rest, x in _blocks(batches, parts * dim, parts):
                code = np.empty((len(x), parts), dtype=np.uint8)
                error = np.zeros(len(x), dtype=np.int64)
                for p in range(parts):
                    at, d = nearest(x[:, p], books[p])
                    code[:, p] = at
                    error += d
                made = rest.append_column("code", pa.array([c.tobytes().hex() for c in code], pa.string()))
                yield from made.append_column("error", pa.array(error)).to_batches()

        types = {f.name: f.dataType.simpleString() for f in vectors.schema}
        return vectors.select("vec_id", "label", "v").mapInArrow(
            run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")

    def decode(self, code: str) -> np.ndarray:
        """The integer vector that a code stands for."""
        return np.concatenate([self.books[p, i] for p, i in enumerate(bytes.fromhex(code))])

    def improved(self, vectors: DataFrame) -> "Codebooks":
        """Entries replaced by the floored means of the parts that they are nearest to."""
        books = self.books
        parts, k, dim = books.shape

        def run(batches):
            import pyarrow as pa
            total, count = np.zeros((parts, k, dim), dtype=np.int64), np.zeros((parts, k), dtype=np.int64)
            for _, x in _blocks(batches, parts * dim, parts):
                for p in range(parts):
                    at, _ = nearest(x[:, p], books[p])
                    np.add.at(total[p], at, x[:, p])
                    count[p] += np.bincount(at, minlength=k)
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]),
                                              pa.array(list(total[p, e]), pa.list_(pa.int64()))],
                                             names=["p", "e", "n", "total"])

        sums = (vectors.select("v").mapInArrow(run, "p int, e int, n long, total array<long>")
                .select("p", "e", "n", F.posexplode("total").alias("j", "x"))
                .groupBy("p", "e", "j").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")))
        new = books.copy()
        for r in sums.collect():  # one row per part, entry and component
            new[r["p"], r["e"], r["j"]] = int(r["x"]) // r["n"]
        return Codebooks(new)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``integer_vectors`` (a written table: every round reads it)."""
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-width // parts) * parts
    ids = [r[0] for r in vectors.select("vec_id").where("vec_id IS NOT NULL").distinct().orderBy("vec_id").limit(entries).collect()]
    first = vectors.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    start = np.zeros((parts, len(ids), width // parts), dtype=np.int64)
    end = _limit(width // parts, parts)
    for e, r in enumerate(first):
        whole = np.array(r["v"] + [0] * (width - len(r["v"])), dtype=np.int64).clip(-end, end)
        start[:, e] = whole.reshape(parts, -1)
    books = Codebooks(start)
    for _ in range(rounds if ids else 0):
        books = books.improved(vectors)
    return books


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every whole and finite vector of ``rows``."""
    spark = rows.sparkSession
    checkpoint_dir(spark)
    ship_package(spark)
    if not 0 < entries <= 256:
        raise ValueError("a code holds 1 to 256 entries")
    vectors = save(integer_vectors(rows, scale), "vectors")
    books = train(vectors, parts, entries, rounds)
    if not books.shape[1]:
        # no vector has an id: nothing to start from, so the whole table is one entry of zeros
        books = Codebooks(np.zeros((parts, 1, books.shape[2]), dtype=np.int64))
    coded = save(books.encode(vectors), "codes")
    by_label = save(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    return (look_up(coded, by_label, ["label"], ["vec_id", "code"])
            .select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256")))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors and codebooks of all embeddings."""
    return compress(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


def _sql() -> str:
    floor = "((s - ((s % n) + n) % n) // n)"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
d{r} AS (SELECT x.row, x.p, c.e, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM parts x JOIN c{r} c ON x.p = c.p AND x.j = c.j GROUP BY ALL),
a{r} AS (SELECT row, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM d{r} GROUP BY row, p)""")
        if r < ROUNDS:
            steps.append(f"""
s{r} AS (SELECT p, a.e, x.j, sum(x.x)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN parts x USING (row, p) GROUP BY ALL),
c{r + 1} AS (SELECT c.p, c.e, c.j, CASE WHEN s.n IS NULL THEN c.x ELSE {floor} END AS x FROM c{r} c LEFT JOIN s{r} s USING (p, e, j))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
               list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v, len(embedding) // {PARTS} AS dim
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, (i - 1) // dim AS p, (i - 1) % dim AS j, v[i] AS x FROM (SELECT row, v, dim, unnest(range(1, len(v) + 1)) AS i FROM kept)),
c0 AS (SELECT p, row - 1 AS e, j, x FROM parts WHERE row <= {ENTRIES}),{",".join(steps)},
coded AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY row)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (row)
"""


OP13_SQL = _sql()
