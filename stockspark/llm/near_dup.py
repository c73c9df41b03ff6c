"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

A text's set holds its distinct 5-word shingles (A-Z lower-cased, 64-bit
hashes); a shorter text with words is one shingle; a text without words has an
empty set and is linked with nothing. Two documents are linked if
100 * intersection >= 75 * union; a component is what links connect.

* Documents with equal sets form a class first; only its smallest doc_id goes
  on, so a group of copies costs one row whatever its size.
* Sketch: in round r every element is hashed to one of ``COORDS`` bins with a
  value; a bin keeps r plus the smallest value of the first round that reaches
  it. Rounds COORDS .. 2*COORDS-1 put every element into bin r - COORDS, so every
  coordinate is filled for sure. Two sets agree in a coordinate with
  probability equal to their similarity, with Chernoff-like concentration.
* ``BANDS`` bands of ``BAND_ROWS`` coordinates: two sets of similarity 0.75 share
  none with probability (1 - 0.75^5)^48 = 2.3e-6, less for any closer ones.
* In every bucket each document is compared with the smallest one. Where that
  leaves a bucket in several components, those outside its largest one are compared
  with all documents around that one, so every two documents of a bucket are either
  connected or compared: links are lost only where sketches share no band.
  Comparison is on full sets, streamed past one text or one bounded block at a time.

Null text counts as empty. Rows with a null doc_id cannot be linked; they get a
null component and are kept. Rows with the same doc_id each get the result of
their own text. An empty table gives an empty result; other columns are ignored
by ``components`` and pass through ``keep_one``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm.common import documents, mix, prepare, save, shingle_sets, utf8_batch

SHINGLE = 5
PERCENT = 75
BANDS = 48
BAND_ROWS = 5
COORDS = BANDS * BAND_ROWS
PARTNERS_PER_TASK = 128
BLOCK_SHINGLES = 1_000_000

_U = np.uint64
_SEEDS = np.random.default_rng(77).integers(1, 2**63, 2 * COORDS, dtype=np.uint64)


def sketch(elements: np.ndarray) -> np.ndarray:
    """COORDS coordinates (uint64) of a non-empty set of 64-bit elements."""
    out = np.zeros(COORDS, dtype=np.uint64)
    empty = np.ones(COORDS, dtype=bool)
    full = _U(2**64 - 1)
    for r in range(COORDS):
        h = mix(elements ^ _SEEDS[r])
        bins = ((h >> _U(32)) * _U(COORDS) >> _U(32)).astype(np.int64)
        best = np.full(COORDS, full, dtype=np.uint64)
        np.minimum.at(best, bins, mix(h))
        new = empty & (best != full)
        out[new] = best[new]
        empty &= ~new
        if not empty.any():
            return out
    for r in np.flatnonzero(empty):
        out[r] = mix(elements ^ _SEEDS[COORDS + r]).min()
    return out


def sketch_all(sets: list[np.ndarray]) -> np.ndarray:
    """Sketches of many non-empty sets: the same rounds over flat arrays, each
    round only over the sets that still have an empty bin."""
    n = len(sets)
    out = np.zeros(n * COORDS, dtype=np.uint64)
    if not n:
        return out.reshape(0, COORDS)
    empty = np.ones(n * COORDS, dtype=bool)
    full = _U(2**64 - 1)
    live = np.arange(n)
    elements = np.concatenate(sets)
    owner = np.repeat(live, [len(s) for s in sets])
    for r in range(COORDS):
        h = mix(elements ^ _SEEDS[r])
        bins = ((h >> _U(32)) * _U(COORDS) >> _U(32)).astype(np.int64)
        at = owner * COORDS + bins
        want = empty[at]
        best = np.full(n * COORDS, full, dtype=np.uint64) if r == 0 else best_buffer
        best_buffer = best
        np.minimum.at(best, at[want], mix(h[want]))
        hit = np.unique(at[want])
        out[hit] = best[hit]
        empty[hit] = False
        best[hit] = full
        still = empty.reshape(n, COORDS).any(axis=1)
        if not still.any():
            break
        keep = still[owner]
        if not keep.all():
            elements, owner = elements[keep], owner[keep]
    out = out.reshape(n, COORDS)
    empty = empty.reshape(n, COORDS)
    for i in np.flatnonzero(empty.any(axis=1)):
        for r in np.flatnonzero(empty[i]):
            out[i, r] = mix(sets[i] ^ _SEEDS[COORDS + r]).min()
    return out


def band_hashes(sketches: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys; the band's number is part of the key."""
    rows = sketches.reshape(-1, BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + _U(1), rows.shape[:2]).copy()
    for j in range(BAND_ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + rows[:, :, j])
    return key


def sketches_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, bands): the set's size, 128 bits that name
    the set, and its band keys (empty for an empty set)."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            sets = list(shingle_sets(*utf8_batch(b.column("text")), SHINGLE))
            some = [i for i, s in enumerate(sets) if len(s)]
            keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
            for lo in range(0, len(some), 64):  # bounded numpy arrays
                part = some[lo:lo + 64]
                keys[part] = band_hashes(sketch_all([sets[i] for i in part]))
            counts = np.array([BANDS if len(s) else 0 for s in sets])
            offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            flat = keys[counts > 0].reshape(-1).view(np.int64)
            fp = [np.array([_add(s, seed) for s in sets], dtype=np.uint64).view(np.int64) for seed in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp[0]), pa.array(fp[1]),
                 pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))],
                names=["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<bigint>")


def _add(s: np.ndarray, seed: int) -> int:
    return int(mix(s + _U(seed)).sum(dtype=np.uint64)) if len(s) else 0


# ----------------------------------------------------------------- verification

def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows (a, b) of distinct ``pairs`` whose full sets are similar enough.

    Each text goes to the tasks of its partners ``a`` and is compared while
    streaming: rows are sorted by (a, deal), the text of ``a`` first, so a task holds
    one set and one batch. ``deal`` spreads the partners of one ``a``.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS_PER_TASK).alias("_deals"))
    members = (pairs.join(many, "a")
               .select("a", F.pmod(F.xxhash64("b"), F.col("_deals")).alias("deal"), F.col("b").alias("doc_id"),
                       F.lit(1).alias("role")))
    heads = many.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_deals") - 1)).alias("deal"),
                        F.col("a").alias("doc_id"), F.lit(0).alias("role"))
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    rows = (members.unionByName(heads).join(texts, "doc_id")
            .repartition("a", "deal").sortWithinPartitions("a", "deal", "role", "doc_id"))

    def run(batches):
        import pyarrow as pa
        now, head = None, None
        for batch in batches:
            a, deal = batch.column("a").to_pylist(), batch.column("deal").to_pylist()
            role, doc = batch.column("role").to_pylist(), batch.column("doc_id").to_pylist()
            out = []
            for i, mine in enumerate(shingle_sets(*utf8_batch(batch.column("text")), SHINGLE)):
                if role[i] == 0:
                    if now != (a[i], deal[i]):
                        now, head = (a[i], deal[i]), []
                    head.append(mine)
                    continue
                for other in head if now == (a[i], deal[i]) else []:
                    small, large = (mine, other) if len(mine) < len(other) else (other, mine)
                    both = len(small) and int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                    if both and 100 * both >= PERCENT * (len(mine) + len(other) - both):
                        out.append((a[i], doc[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                              pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return rows.select("a", "deal", "role", "doc_id", "text").mapInArrow(run, "a long, b long").distinct()


def crossing_links(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between documents of different ``root`` in one group.

    ``groups`` (main, doc_id, n, root): in each group the documents whose root is
    not ``main`` are compared with all. Both sides are dealt to blocks of about
    BLOCK_SHINGLES shingles, and each pair of blocks is one key. A task indexes the
    shingles of one block of members, then streams the other documents past it:
    all intersections of one text come from one look-up, so no pair of documents
    becomes a row unless it is a link.
    """
    size = groups.groupBy("main").agg(
        F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("_ms"),
        F.ceil(F.sum(F.when(F.col("root") != F.col("main"), F.col("n")).otherwise(0)) / BLOCK_SHINGLES).alias("_os"))
    dealt = groups.join(size, "main")

    def deal(blocks: str) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.col(blocks))

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))

    members = dealt.where("_os > 0").select("main", deal("_ms").alias("m"), every("_os").alias("o"), F.lit(0).alias("role"), "doc_id", "root")
    others = dealt.where(F.col("root") != F.col("main")).select(
        "main", every("_ms").alias("m"), deal("_os").alias("o"), F.lit(1).alias("role"), "doc_id", "root")
    rows = (members.unionByName(others).join(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), "doc_id")
            .repartition("main", "m", "o").sortWithinPartitions("main", "m", "o", "role", "doc_id"))

    def run(batches):
        import pyarrow as pa
        now, ids, roots, sets, index = None, [], [], [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("main", "m", "o"))))
            role, doc, root = (batch.column(c).to_pylist() for c in ("role", "doc_id", "root"))
            out = []
            for i, mine in enumerate(shingle_sets(*utf8_batch(batch.column("text")), SHINGLE)):
                if now != keys[i]:
                    now, ids, roots, sets, index = keys[i], [], [], [], None
                if role[i] == 0:
                    ids.append(doc[i])
                    roots.append(root[i])
                    sets.append(mine)
                    continue
                if index is None:
                    sizes = np.array([len(s) for s in sets], dtype=np.int64)
                    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
                    order = np.argsort(flat, kind="stable")
                    index = flat[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes, np.array(ids), np.array(roots)
                    sets = []
                hashes, owner, sizes, member, member_root = index
                lo, hi = np.searchsorted(hashes, mine, "left"), np.searchsorted(hashes, mine, "right")
                count = hi - lo
                at = np.arange(count.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
                both = np.bincount(owner[at], minlength=len(sizes))
                hit = (both > 0) & (100 * both >= PERCENT * (sizes + len(mine) - both)) & (member_root != root[i])
                out += [(min(doc[i], d), max(doc[i], d)) for d in member[hit].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                              pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return rows.select("main", "m", "o", "role", "doc_id", "root", "text").mapInArrow(run, "a long, b long").distinct()


# ----------------------------------------------------------------- components

def connect(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``links`` (a, b).

    Alternating large-star and small-star steps: every step replaces a node's
    links by links to its smallest neighbour, until all links point to roots.
    Each round is one written table; their number grows with the logarithm of
    the longest chain.
    """
    spark = links.sparkSession
    edges = save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)).first())

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u <> v").distinct())
        edges = save(small, "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    prepare(docs.sparkSession)
    made = save(sketches_of(docs), "sketches")
    named = made.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = named.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = save(classes, "classes")
    members = made.select("doc_id", "n_shingles", "fp1", "fp2").join(classes, ["fp1", "fp2", "n_shingles"], "left")
    reps = named.join(classes.select("fp1", "fp2", "n_shingles", F.col("rep").alias("doc_id")),
                      ["fp1", "fp2", "n_shingles", "doc_id"], "left_semi")
    filed = (reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band")).distinct())
    firsts = filed.groupBy("band").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    buckets = save(filed.join(firsts, "band").select("band", "doc_id", "n", "first"), "buckets")
    near = (buckets.alias("x").join(buckets.where("doc_id = first").select("band", F.col("n").alias("n0")), "band")
            .where("doc_id <> first").where(_sizes_fit("n", "n0"))
            .select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct())
    # the only texts that are compared
    texts = save(docs.select("doc_id", "text").join(buckets.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")
    links = save(verified(save(near, "pairs"), texts), "links")
    roots = connect(links)

    # what the first comparison left unconnected: documents outside their bucket's
    # largest component, against all that share a bucket with that component
    placed = buckets.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "band", "doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
    shares = placed.groupBy("band", "root").agg(F.count("*").alias("c"))
    split = (shares.groupBy("band").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("parts"))
             .where("parts > 1").select("band", "main"))
    mixed = save(placed.join(split, "band").select("main", "doc_id", "n", "root").distinct(), "mixed")
    more = save(crossing_links(mixed, texts), "links")
    roots = save(connect(links.unionByName(more)), "roots")
    return (members.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _sizes_fit(x: str, y: str):
    """Sets of such sizes can be similar enough: intersection <= smaller, union >= larger."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * PERCENT


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the first of their component.
    Of rows with the same doc_id and component all stay or go together."""
    gone = components(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return components(documents(spark, sf_dir))
