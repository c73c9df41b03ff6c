"""Hashed maximum-entropy language model with a class-factored softmax.

Tokens: words [^\\x20\\x09-\\x0D]+ of the text (A-Z lower-cased), then one end. Classes
form a tree of ``WAYS`` children a node, built from the training counts, frequent
leaves near the root. Its leaves are the frequent training tokens and buckets of
all rarer words (by bits of the word's hash); both grow with the vocabulary. The
model is

    P(token | context) = product over the steps from the root to the token's leaf
                         of P(child | node, context)

where each step is a softmax over the node's children: an offset from the training
counts plus hashed features of the context (previous word, previous two words, the
word before the last, the one before that), each hashed with the node. A word of a
bucket has the smoothed share (c + 1) / (N' + V' + 1) of that bucket (N' tokens of
V' words), which leaves one share for unseen words.

* Counts of all training tokens come from one shuffle with map-side sums.
* Training is distributed: every partition runs Adagrad over its share of the
  training texts; the updated rows of all partitions are averaged, weighted by how
  often each was used, in two shuffles by block of rows, and sent out again.
  ``ROUNDS`` rounds each take another part of the texts, so every training text is
  used once.
* Scoring works on flat numpy batches. Words with at least 1 / ``LOCAL_SHARE`` of all
  tokens - by that no more than ``LOCAL_SHARE`` words - are known in every task; all
  others are joined with the counts, one row per text and word.

Words are named by 64-bit hashes. Null text is empty (one end token). A null doc_id
counts as the empty text in the fold's crc32. Repeated rows are texts of
their own; an empty table gives an empty result, and without training texts every
token is unseen. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm.common import documents, mix, prepare, save, utf8_batch, word_hashes

WAYS = 16                          # children of a node of the class tree
TABLES = 3                         # weight tables: root, second level, all others
ROW_BITS = (8, 14)                 # hashed rows of a table follow the leaves, within these powers of two
BLOCK_ROWS = 128
ROUNDS = 2
RATE = 0.12
CHUNK = 16384
LOCAL_SHARE = 1 << 18
BUCKET_SHIFT = 40                  # buckets of rarer words: bits of the hash from here on
FOLDS, HELD_OUT = 7, 2

_U = np.uint64
START = _U(0x5BD1E995A1B2C3D4)
END = _U(0x27D4EB2F165667C5)
_SPREAD = _U(0x9E3779B97F4A7C15)
_ONES = np.ones(WAYS, dtype=np.float32)
_SEED = np.random.default_rng(5).integers(1, 2**63, 8, dtype=np.uint64)


def held_out(doc_id: Column) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % FOLDS == HELD_OUT


# ----------------------------------------------------------------- texts as arrays

def token_arrays(column):
    """(tokens, row of each token, place in its row) of an Arrow string column."""
    h, _, _, woff = word_hashes(*utf8_batch(column), lower=True)
    sizes = np.diff(woff) + 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(row)) - begins[row]
    tokens = np.full(len(row), END, dtype=np.uint64)
    tokens[place < (sizes - 1)[row]] = h
    return tokens, row, place


def features(tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(4, n) hashes of n-gram and skip features of each token's context."""
    def back(k):
        out = np.full(len(tokens), START, dtype=np.uint64)
        out[k:] = tokens[:-k] if k < len(tokens) else tokens[:0]
        out[place < k] = START
        return out
    p1, p2, p3 = back(1), back(2), back(3)
    return np.stack([mix(p1 ^ _SEED[0]), mix(p1 * _SEED[1] + mix(p2)), mix(p2 ^ _SEED[2]), mix(p3 ^ _SEED[3])])


def n_buckets(words: int) -> int:
    """Buckets of the rarer words: a sixteenth of the root of their number, 4,096 at most."""
    return 1 << min(12, max(0, (max(words, 1).bit_length() - 1) // 2 - 4))


def code_tree(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class tree of ``WAYS`` children a node, frequent leaves near the root: (depth of
    each leaf, node and child by leaf and level, weight by node and child). Node 0 is the root."""
    n = len(weights)
    pad = -(n - 1) % (WAYS - 1) if n > 1 else WAYS - 1
    order = np.argsort(weights, kind="stable")
    leaves = np.concatenate([np.zeros(pad), weights[order]]).tolist()
    n_nodes = (len(leaves) - 1) // (WAYS - 1)
    up, made, at_leaf, at_node = np.zeros(len(leaves) + n_nodes, dtype=np.int64), [], 0, 0
    child = np.zeros(len(up), dtype=np.int64)
    shares = np.zeros((n_nodes, WAYS))
    for node in range(n_nodes):  # the lightest WAYS of leaves and nodes become one node
        for k in range(WAYS):
            if at_leaf < len(leaves) and (at_node >= len(made) or leaves[at_leaf] <= made[at_node]):
                what, weight, at_leaf = at_leaf, leaves[at_leaf], at_leaf + 1
            else:
                what, weight, at_node = len(leaves) + at_node, made[at_node], at_node + 1
            up[what], child[what], shares[node, k] = node, k, weight
        made.append(shares[node].sum())
    root = len(leaves) + n_nodes - 1
    here, depth = np.arange(pad, len(leaves)), np.zeros(n, dtype=np.int64)
    steps = []
    while (here != root).any():
        on = here != root
        depth += on
        steps.append((np.where(on, n_nodes - 1 - up[here], 0), np.where(on, child[here], 0)))
        here = np.where(on, len(leaves) + up[here], root)
    nodes = np.zeros((n, len(steps)), dtype=np.int32)
    children = np.zeros((n, len(steps)), dtype=np.int8)
    for back, (node, k) in enumerate(steps):
        on = np.flatnonzero(depth > back)
        nodes[on, depth[on] - 1 - back] = node[on]
        children[on, depth[on] - 1 - back] = k[on]
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    return depth[place], nodes[place], children[place], shares[::-1]


class Model:
    """The class tree with its offsets from counts, the weight rows, and the known words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int,
                 tail_counts: np.ndarray, tail_words: np.ndarray):
        """``words``/``counts``: the frequent training tokens, the end token among
        them; ``total``/``distinct``: all training tokens; ``tail_counts``/``tail_words``:
        tokens and words of each bucket of the others."""
        by_hash = np.argsort(words)
        self.words, self.counts = words[by_hash], counts[by_hash]
        self.total, self.distinct, self.buckets = total, distinct, len(tail_counts)
        self.tail_norm = (tail_counts + tail_words + 1).astype(np.float64)
        weights = np.concatenate([self.counts, tail_counts + 1]).astype(np.float64)
        self.depth, self.nodes, self.children, shares = code_tree(weights)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.offset = np.log(shares / shares.sum(axis=1, keepdims=True)).astype(np.float32)
        self.offset[~np.isfinite(self.offset)] = -1e9  # an unused place has no mass
        self.salt = mix(np.arange(len(shares), dtype=np.uint64) * _SEED[4] + _SEED[5])
        self.bits = int(np.clip(np.ceil(np.log2(len(weights) + 1)), *ROW_BITS))
        self.rows = 1 << self.bits
        self.weights = np.zeros((TABLES, self.rows, WAYS), dtype=np.float32)

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Place of each token among the known words, -1 for others."""
        if not len(self.words):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return np.where(self.words[at] == tokens, at, -1)

    def bucket(self, tokens: np.ndarray) -> np.ndarray:
        return (tokens >> _U(BUCKET_SHIFT)).astype(np.int64) % self.buckets

    def leaves(self, tokens: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Leaf of each token: its own or that of its bucket."""
        return np.where(index >= 0, index, len(self.words) + self.bucket(tokens))

    def steps(self, feats: np.ndarray, leaf: np.ndarray):
        """For each weight table (table, token, node, child, rows of its four features)
        of all steps from the root to the tokens' leaves that the table serves."""
        depth = self.depth[leaf]
        for table in range(TABLES):
            if table < TABLES - 1:
                token = np.flatnonzero(depth > table)
                level = table
            else:
                more = np.maximum(depth - table, 0)
                token = np.repeat(np.arange(len(leaf)), more)
                level = table + np.arange(len(token)) - np.repeat(np.cumsum(more) - more, more)
            if len(token):
                node = self.nodes[leaf[token], level]
                rows = ((feats[:, token] ^ self.salt[node]) * _SPREAD) >> _U(64 - self.bits)
                yield table, token, node, self.children[leaf[token], level], rows.astype(np.uint16)

    def softmax(self, table: int, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
        z = self.offset.take(node, axis=0)
        for r in rows:
            z += self.weights[table].take(r, axis=0)
        np.minimum(z, 60, out=z)
        np.exp(z, out=z)
        z /= (z @ _ONES)[:, None]
        return z

    def log10(self, feats: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """log10 probability of the leaves."""
        out = np.zeros(len(leaf))
        for lo in range(0, len(leaf), CHUNK):
            here = leaf[lo:lo + CHUNK]
            for table, token, node, child, rows in self.steps(feats[:, lo:lo + CHUNK], here):
                p = self.softmax(table, node, rows)[np.arange(len(token)), child]
                out[lo:lo + CHUNK] += np.bincount(token, np.log10(np.maximum(p, 1e-30)), len(here))
        return out


class Trainer:
    """Adagrad with one step size a row; counts how often each row was used."""

    def __init__(self, model: Model):
        self.model = model
        model.weights = model.weights.copy()
        self.squares = np.zeros(model.weights.shape[:2], dtype=np.float32)
        self.used = np.zeros(model.weights.shape[:2])

    def learn(self, feats: np.ndarray, leaf: np.ndarray) -> None:
        for lo in range(0, len(leaf), CHUNK):
            for table, token, node, child, rows in self.model.steps(feats[:, lo:lo + CHUNK], leaf[lo:lo + CHUNK]):
                n = len(token)
                z = self.model.softmax(table, node, rows)
                z[np.arange(n), child] -= 1.0
                flat = rows.reshape(-1)
                order = np.argsort(flat, kind="stable")
                flat = flat[order]
                starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
                grad = np.add.reduceat(z.take(order % n, axis=0), starts, axis=0)
                at = flat[starts]
                squares = self.squares[table][at] + np.einsum("ij,ij->i", grad, grad) / WAYS
                self.squares[table][at] = squares
                grad *= (RATE / np.sqrt(squares + 1.0))[:, None]
                self.model.weights[table][at] -= grad
                self.used[table][at] += np.diff(np.append(starts, len(flat)))


# ----------------------------------------------------------------- Spark jobs

def token_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts: words counted per batch, then summed."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            words, c = np.unique(word_hashes(*utf8_batch(b.column("text")), lower=True)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(c, pa.int64())], names=["word", "c"])

    return texts.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def new_model(counts: DataFrame, n_texts: int) -> Model:
    """The untrained model; takes the words of at least 1 / LOCAL_SHARE of all
    tokens to the driver, which are LOCAL_SHARE rows of 16 bytes at most."""
    size = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = int(size[0] or 0) + n_texts, int(size[1]) + (n_texts > 0)
    is_often = F.col("c") * LOCAL_SHARE >= total
    often = counts.where(is_often).toArrow()
    words = often.column("word").to_numpy().view(np.uint64)
    c = often.column("c").to_numpy().astype(np.int64)
    buckets = n_buckets(int(size[1]) - len(words))
    tail = np.zeros((2, buckets), dtype=np.int64)
    key = (F.shiftrightunsigned("word", BUCKET_SHIFT) % buckets).alias("bucket")
    for r in counts.where(~is_often).groupBy(key).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        tail[:, r["bucket"]] = r["c"], r["v"]
    if n_texts:
        words, c = np.append(words, END), np.append(c, n_texts)
    return Model(words, c, total, distinct, *tail)


def train_round(model: Model, texts: DataFrame) -> None:
    """One distributed pass; the model then holds the weighted average of the partitions' rows."""
    sc = texts.sparkSession.sparkContext
    sent = sc.broadcast(model)
    fields = "block int, deal int, task int, used binary, weights binary"

    def learn(batches):
        import copy

        import pyarrow as pa
        from pyspark import TaskContext
        mine = copy.copy(sent.value)
        trainer, task, seen = Trainer(mine), TaskContext.get().partitionId(), 0
        for b in batches:
            tokens, _, place = token_arrays(b.column("text"))
            trainer.learn(features(tokens, place), mine.leaves(tokens, mine.find(tokens)))
            seen += len(tokens)
        if not seen:
            return
        all_used, all_rows = trainer.used.reshape(-1), mine.weights.reshape(-1, WAYS)
        for block in range(len(all_used) // BLOCK_ROWS):
            at = slice(block * BLOCK_ROWS, (block + 1) * BLOCK_ROWS)
            used, rows = all_used[at], all_rows[at] * all_used[at][:, None]
            if not used.any():
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([task % 64], pa.int32()), pa.array([task], pa.int32()),
                 pa.array([used.astype("<f8").tobytes()], pa.binary()), pa.array([rows.astype("<f4").tobytes()], pa.binary())],
                names=["block", "deal", "task", "used", "weights"])

    def add(batches):
        import pyarrow as pa
        now, used, rows = None, None, None

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([0], pa.int32()),
                 pa.array([used.tobytes()], pa.binary()), pa.array([rows.astype("<f4").tobytes()], pa.binary())],
                names=["block", "deal", "task", "used", "weights"])

        for b in batches:
            for r in b.to_pylist():
                if now != (r["block"], r["deal"]):
                    if now is not None:
                        yield out()
                    now, used, rows = (r["block"], r["deal"]), 0.0, 0.0
                used = used + np.frombuffer(r["used"], "<f8")
                rows = rows + np.frombuffer(r["weights"], "<f4").astype(np.float64)
        if now is not None:
            yield out()

    parts = texts.select("text").mapInArrow(learn, fields)
    for keys in (["block", "deal"], ["block"]):
        parts = (parts.withColumn("deal", F.col("deal") if "deal" in keys else F.lit(0))
                 .repartition(*keys).sortWithinPartitions("block", "deal", "task").mapInArrow(add, fields))
    table = model.weights.reshape(-1, WAYS)
    for r in parts.collect():  # a row a block: the model itself
        at = slice(r["block"] * BLOCK_ROWS, (r["block"] + 1) * BLOCK_ROWS)
        used = np.frombuffer(bytes(r["used"]), "<f8")
        rows = np.frombuffer(bytes(r["weights"]), "<f4").reshape(-1, WAYS)
        some = used > 0
        table[at][some] = rows[some] / used[some, None]
    sent.unpersist()


def fit(texts: DataFrame) -> tuple[Model, DataFrame]:
    """A model trained on all ``texts`` (column text), and their (word, c) counts."""
    prepare(texts.sparkSession)
    counts = save(token_counts(texts), "counts")
    model = new_model(counts, texts.count())
    part = F.pmod(F.xxhash64("text"), F.lit(ROUNDS))
    for r in range(ROUNDS):
        train_round(model, texts.where(part == r) if r else texts.where(part.isNull() | (part == 0)))
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = "row long, doc_id long, word long, n long, n_tokens long, n_known long, base double, score double"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        m, row0 = sent.value, TaskContext.get().partitionId() << 40
        for b in batches:
            n = b.num_rows
            tokens, row, place = token_arrays(b.column("text"))
            index = m.find(tokens)
            known = index >= 0
            c = np.where(known, m.counts[index], 0) if len(m.words) else np.zeros(len(tokens), np.int64)
            base = np.log10(c + 1.0) - np.log10(m.total + m.distinct + 1.0)
            leaf = m.leaves(tokens, index)
            mine = m.log10(features(tokens, place), leaf)
            mine[~known] -= np.log10(m.tail_norm[leaf[~known] - len(m.words)])
            ids = row0 + np.arange(n)
            row0 += n
            empty = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            sums = [np.bincount(row, weights=w, minlength=n) for w in (known, base, mine)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), b.column("doc_id"), *empty, pa.array(np.bincount(row, minlength=n), pa.int64()),
                 pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                names=[x.split()[0] for x in fields.split(", ")])
            # the words that no task knows: one row per text and word
            rare = np.flatnonzero(~known)
            if len(rare):
                order = rare[np.lexsort((tokens[rare], row[rare]))]
                new = np.concatenate([[True], (tokens[order[1:]] != tokens[order[:-1]]) | (row[order[1:]] != row[order[:-1]])])
                first = np.flatnonzero(new)
                k = len(first)
                nothing = [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row[order[first]]]), pa.nulls(k, pa.int64()), pa.array(tokens[order[first]].view(np.int64)),
                     pa.array(np.diff(np.append(first, len(order)))), *nothing],
                    names=[x.split()[0] for x in fields.split(", ")])

    made = save(docs.select("doc_id", "text").mapInArrow(run, fields), "scores")
    rare = (made.where("word IS NOT NULL").select("row", "word", "n").join(counts, "word")
            .groupBy("row").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("g")))
    zero = F.lit(0)
    return (made.where("word IS NULL").drop("word", "n").join(rare, "row", "left")
            .select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("k", zero)).alias("n_known"),
                    (F.col("base") + F.coalesce("g", zero)).alias("base_score"),
                    (F.col("score") + F.coalesce("g", zero)).alias("score")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under a model of the training folds, and under unigram counts."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model, counts = fit(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model, counts).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
