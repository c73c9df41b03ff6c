"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A window is ``WINDOW`` consecutive words of one document; a word goes if a window
over it has a word sequence that also starts in a document with a smaller
doc_id. All windows are judged on the input.

* Index. Every window is filed under its minimizer: the smallest hash among the
  ``GRAM``-word grams inside it. Equal windows have equal minimizers, so whatever
  equals a window is filed under the same key; consecutive windows mostly share
  one. The windows that all documents have under one key form its reference
  block (a key with very many documents is dealt to several blocks).
* Parse. Only keys of two documents or more are looked at again. A block is read
  in ascending doc_id; each document's stretch of windows is factored greedily
  against the block's windows so far: a factor starts at the first window found
  in the index and is extended as long as the next one, a word further, is found
  too, so it holds 50 words or more and ends where a check at its boundary fails.
  What is not found becomes part of the index.
* Blocks of a dealt key are settled against each other by the smallest doc_id
  of every window that is new in its block, one row per block and window.
* The factors of a document, joined, are its duplicate spans; the words in them go.

Windows are equal if their 64-bit hashes and those of their minimizers are.

Words are [^\\x20\\x09-\\x0D]+, unchanged. Null text has no words. Texts of fewer than
50 words, and rows with a null doc_id, neither lose words nor cost others any.
A doc_id names one document: rows that repeat it (with its text) do not affect
each other and each loses what smaller ids hold; of different texts under one
doc_id every row would lose the spans of all of them. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm.common import documents, gram_hashes, prepare, save, utf8_batch, word_hashes

WINDOW = 50
GRAM = 20
DOCS_PER_BLOCK = 512


def minimizers(h: np.ndarray) -> np.ndarray:
    """The smallest GRAM-gram hash of each window of word hashes ``h``."""
    m = gram_hashes(h, GRAM)
    width, have = WINDOW - GRAM + 1, 1
    while have < width:  # minimum of ever longer stretches
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return m


def stretches(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, end) of the runs of windows with one minimizer."""
    m = minimizers(h)
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    return m[first], first, np.append(first[1:], len(m))


def _long_docs(batch):
    """(row, word hashes) of the texts that have a window."""
    h, _, _, woff = word_hashes(*utf8_batch(batch.column("text")))
    for i, (a, b) in enumerate(zip(woff[:-1], woff[1:])):
        if b - a >= WINDOW:
            yield i, h[a:b]


def keys_of(docs: DataFrame) -> DataFrame:
    """(key, doc_id), once per row and key."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, h in _long_docs(b):
                k = np.unique(stretches(h)[0])
                keys.append(k)
                rows.append(np.full(len(k), ids[i], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)),
                                              pa.array(np.concatenate(rows))], names=["key", "doc_id"])

    return docs.mapInArrow(run, "key long, doc_id long")


def stretches_of(docs: DataFrame) -> DataFrame:
    """(key, blocks, doc_id, first, windows): for each document row with an array
    ``shared`` of (key, blocks), its stretches under these keys with all window hashes."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            shared = b.column("shared").to_pylist()
            key, blocks, doc, first, sizes, windows = [], [], [], [], [], [np.zeros(0, np.uint64)]
            for i, h in _long_docs(b):
                wanted = {x["key"] & (2**64 - 1): x["blocks"] for x in shared[i]}
                k, lo, hi = stretches(h)
                hit = np.isin(k, np.fromiter(wanted, dtype=np.uint64, count=len(wanted)))
                if not hit.any():
                    continue
                w = gram_hashes(h, WINDOW)
                for g, p, q in zip(k[hit].tolist(), lo[hit].tolist(), hi[hit].tolist()):
                    key.append(g)
                    blocks.append(wanted[g])
                    doc.append(ids[i])
                    first.append(p)
                    sizes.append(q - p)
                    windows.append(w[p:q])
            offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate(windows).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(key, dtype=np.uint64).view(np.int64)), pa.array(blocks, pa.int64()),
                 pa.array(doc, pa.int64()), pa.array(first, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))],
                names=["key", "blocks", "doc_id", "first", "windows"])

    return docs.select("doc_id", "text", "shared").mapInArrow(
        run, "key long, blocks long, doc_id long, first int, windows array<bigint>")


def parse(rows: DataFrame) -> DataFrame:
    """Factor the stretches of every block, in ascending doc_id.

    Gives (doc_id, lo, hi, window): factors as ranges lo..hi of window starts
    (window null), and, for keys of several blocks only, each window that was
    new in its block (hi null) to be settled with the other blocks.
    """
    def run(batches):
        import pyarrow as pa
        now, doc = None, None
        index: dict[int, None] = {}
        fresh: set[int] = set()
        for b in batches:
            out_doc, out_lo, out_hi, out_win, out_key = [], [], [], [], []
            cols = [b.column(c).to_pylist() for c in ("key", "block", "blocks", "doc_id", "first", "windows")]
            for key, block, blocks, d, first, windows in zip(*cols):
                if now != (key, block):
                    now, doc, index, fresh = (key, block), d, {}, set()
                if doc != d:  # what a document adds counts for larger ids only
                    index.update(dict.fromkeys(fresh))
                    doc, fresh = d, set()
                start = None
                for j, w in enumerate(windows):
                    if w in index:
                        start = j if start is None else start
                        continue
                    if start is not None:
                        out_doc.append(d)
                        out_lo.append(first + start)
                        out_hi.append(first + j)
                        out_win.append(None)
                        out_key.append(None)
                        start = None
                    fresh.add(w)
                    if blocks > 1:
                        out_doc.append(d)
                        out_lo.append(first + j)
                        out_hi.append(None)
                        out_win.append(w)
                        out_key.append(key)
                if start is not None:
                    out_doc.append(d)
                    out_lo.append(first + start)
                    out_hi.append(first + len(windows))
                    out_win.append(None)
                    out_key.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_doc, pa.int64()), pa.array(out_lo, pa.int32()), pa.array(out_hi, pa.int32()),
                 pa.array(out_win, pa.int64()), pa.array(out_key, pa.int64())],
                names=["doc_id", "lo", "hi", "window", "key"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    return (dealt.repartition("key", "block").sortWithinPartitions("key", "block", "doc_id", "first")
            .select("key", "block", "blocks", "doc_id", "first", "windows")
            .mapInArrow(run, "doc_id long, lo int, hi int, window long, key long"))


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<lo,hi>>): ranges of starts of the windows that
    smaller documents hold, for every document that has one."""
    prepare(docs.sparkSession)
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    keys = save(keys_of(texts), "keys")
    shared = (keys.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("c"))
              .where("lo < hi").select("key", F.ceil(F.col("c") / DOCS_PER_BLOCK).alias("blocks")))
    per_doc = (keys.join(shared, "key").groupBy("doc_id")
               .agg(F.collect_list(F.struct("key", "blocks")).alias("shared")))  # as many as the document has stretches
    found = save(parse(stretches_of(texts.join(per_doc, "doc_id"))), "factors")
    open_ = found.where("hi IS NULL").select("key", "window", "doc_id", "lo")
    first = open_.groupBy("key", "window").agg(F.min("doc_id").alias("least"))
    later = (open_.join(first, ["key", "window"]).where("doc_id > least")
             .select("doc_id", "lo", (F.col("lo") + 1).alias("hi")))
    factors = found.where("hi IS NOT NULL").select("doc_id", "lo", "hi").unionByName(later)
    return factors.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def kept_words(n: int, spans) -> np.ndarray:
    """Which of a document's n words stay, from its ranges of removed windows."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for s in spans or []:
        edge[s["lo"]] += 1
        edge[min(n, s["hi"] - 1 + WINDOW)] -= 1
    return np.cumsum(edge[:-1]) == 0


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of every row; text holds the kept words joined by one space."""
    spans = duplicate_spans(docs)
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(spans, "doc_id", "left")
    nameless = docs.where("doc_id IS NULL").select("doc_id", "text").withColumn(
        "spans", F.lit(None).cast("array<struct<lo:int,hi:int>>"))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            words = [(t or "").encode().split() for t in b.column("text").to_pylist()]
            kept = [kept_words(len(w), s) for w, s in zip(words, b.column("spans").to_pylist())]
            left = [b" ".join([x for x, k in zip(w, keep) if k]).decode() for w, keep in zip(words, kept)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([int((~k).sum()) for k in kept], pa.int64()), pa.array(left, pa.string())],
                names=["doc_id", "n_words", "n_removed", "text"])

    return texts.unionByName(nameless).mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that smaller documents hold."""
    left = dedup(documents(spark, sf_dir))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
