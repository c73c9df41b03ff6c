"""Spelling variants by a dictionary of trie-node pairs.

All words go into two tries, read forward and backward, whose nodes are numbered.
A prefix node and a suffix node then stand for all characters before and after a
place, and two integers for a word with a place in it. Words that differ by one
replaced code point share the pair (prefix before it, suffix after it). A word with
one code point more shares that pair of its own with the pair (prefix before the
place, suffix from the place on) of the shorter word. So an exact join on integer
pairs gives all words at one edit, and nothing else. A pair is shared by one
shorter word and at most as many others as there are letters (90 code points), so
no group is large, however many words there are. A code point that could be left
out at several places of a repeat (``aa``) counts at its first place only, so each
near word is met once.

Numbering: words are range-partitioned into blocks of about BLOCK_CHARS code points
and sorted. A block makes the nodes that its words add to the path of the word before.
Nodes that lie on the path of words of two blocks are numbered on the driver, from the
first and last word of each block (one row a block).

A word's form is its near word of largest count (ties: smallest), if that is found at
least twice as often; forms are followed to the last one by pointer doubling.

Null and empty texts hold no words. A null doc_id counts as an empty text in the hash
that picks the runs with an omission. Repeated rows count like others. An empty table,
or one without frequent words, gives no rows. Texts of any length are read in pieces
that end outside of runs. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm.common import documents, look_up, save
from stockspark.session import checkpoint_dir, ship_package

# Fixed by the contract
RUN = "[A-Za-zÀ-ÿ]+"
OMIT_EVERY = 97
LEAST_CHARS = 5
LEAST_COUNT = 3
FORM_TIMES = 2

BLOCK_CHARS = 1 << 20
HELD_WORDS = 100_000
PIECE = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# A-Z are gone by then; shorter runs give no words
_LONG_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_CHARS)
_NO_RUN = re.compile("[^a-zÀ-ÿ]")


def _pieces(text: str):
    """``text`` in pieces of about PIECE code points; no run is cut."""
    lo = 0
    while len(text) - lo > PIECE:
        stop = _NO_RUN.search(text, lo + PIECE)
        if stop is None:
            break
        yield text[lo:stop.start()]
        lo = stop.start()
    yield text[lo:]


def words_of_text(doc_id: int | None, text: str | None) -> Counter:
    """Words of a document with their counts; runs picked by the hash have lost a code point."""
    found: Counter = Counter()
    lowered = (text or "").encode().translate(_LOWER).decode()
    for piece in _pieces(lowered):
        found.update(_LONG_RUN.findall(piece))
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), head)
        if h % OMIT_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LEAST_CHARS:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least LEAST_CHARS code points found LEAST_COUNT times."""
    def run(batches):
        import pyarrow as pa

        def flush(held):
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                              names=["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                held.update(words_of_text(doc_id, text.as_py()))
                if len(held) > HELD_WORDS:
                    yield flush(held)
                    held = Counter()
        yield flush(held)

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ----------------------------------------------------------------- trie nodes

def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def shared_nodes(ends: list[tuple[str, str]]) -> list[tuple[list[int], list[int]]]:
    """Per block the numbers (below 0) of the nodes that its first word shares with the block
    before, and that its last word shares with the block after, by depth from 1. ``ends``: first and last words."""
    out, left, made = [], [], 0
    for i, (first, last) in enumerate(ends):
        n = _common(last, ends[i + 1][0]) if i + 1 < len(ends) else 0
        kept = min(_common(first, last), len(left), n)
        right = left[:kept] + list(range(-made - 1, -made - 1 - (n - kept), -1))
        made += n - kept
        out.append((left, right))
        left = right
    return out


def block_paths(block: int, words: list[str], left: list[int], right: list[int]) -> list[list[int]]:
    """Node numbers of all prefixes (the empty one, 0, first) of the sorted ``words`` of a block."""
    paths, made, base = [], 0, (block + 1) << 40
    path, before = [0, *left], words[0][:len(left)]
    for word in words:
        depth = _common(before, word)
        path = path[:depth + 1]
        onward = min(_common(word, words[-1]), len(right))
        path += right[depth:onward]
        new = len(word) + 1 - len(path)
        path += range(base + made, base + made + new)
        made += new
        paths.append(path)
        before = word
    return paths


def number_nodes(words: DataFrame, column: str, path: str, no: str) -> DataFrame:
    """``words`` with the ``path`` of node numbers of the distinct strings in ``column``,
    and ``no``, an integer in their order. ``words`` should be a written table."""
    spark = words.sparkSession
    chars = words.agg(F.sum(F.length(column))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    ranged = save(words.repartitionByRange(blocks, column).withColumn("block", F.spark_partition_id()), "trie-words")
    ends = ranged.groupBy("block").agg(F.min(column), F.max(column)).orderBy("block").collect()
    nodes = shared_nodes([(first, last) for _, first, last in ends])
    shared = spark.createDataFrame([(e[0], *n) for e, n in zip(ends, nodes)], "block int, left array<long>, right array<long>")

    def run(_, rows, ends_of_block):
        rows = rows.sort_values(column)
        block = int(rows["block"].iloc[0])
        rows[path] = block_paths(block, rows[column].tolist(), *(ends_of_block[c].iloc[0].tolist() for c in ("left", "right")))
        rows[no] = range(block << 32, (block << 32) + len(rows))
        return rows.drop(columns=["block"])

    # groups are blocks: bounded by BLOCK_CHARS
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return ranged.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(run, f"{schema}, {path} array<long>, {no} long")


# ----------------------------------------------------------------- near words

_PLAIN, _FRESH, _WHOLE = 0, 1, 2  # a place left out (again, first of a repeat), nothing left out


def pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a written table (word, n): (word, no, n), and the node pairs (p, s, no, n, kind) of every word."""
    forward = number_nodes(words, "word", "p", "no")
    backward = number_nodes(words.select(F.reverse("word").alias("drow")), "drow", "s", "_").select(F.reverse("drow").alias("word"), "s")
    length = F.size("p") - 1
    # s by place: the suffix from there on
    nodes = save(forward.join(backward, "word").select(
        "word", "no", "n", "p", F.reverse("s").alias("s"), F.split("word", "").alias("c")), "trie-nodes")
    # an entry differs from the one before it where no repeat goes on
    fresh = F.transform(F.arrays_zip(F.slice("c", 1, length).alias("now"), F.concat(F.array(F.lit("")), F.slice("c", 1, length - 1)).alias("prior")),
                        lambda x: F.when(x["now"] == x["prior"], _PLAIN).otherwise(_FRESH))
    out = (nodes.select("no", "n", F.slice("p", 1, length).alias("p"), F.slice("s", 2, length).alias("s"), fresh.alias("kind"))
           .select("no", "n", F.inline(F.arrays_zip("p", "s", "kind"))))
    whole = nodes.select("no", "n", F.inline(F.arrays_zip("p", "s"))).withColumn("kind", F.lit(_WHOLE))
    return nodes.select("word", "no", "n"), out.unionByName(whole)


def near_words(rows: DataFrame) -> DataFrame:
    """(no, n_near, best_n, best) of ``pairs``: the number of near words and the most frequent one."""
    groups = (rows.groupBy("p", "s").agg(F.collect_list(F.struct((-F.col("n")).alias("m"), "no", "kind")).alias("g"))
              .where(F.size("g") > 1).select(F.array_sort("g").alias("g")))

    def linked(x, y):
        left_out = (x["kind"] != _WHOLE) & (y["kind"] != _WHOLE)
        one_longer = ((x["kind"] == _FRESH) & (y["kind"] == _WHOLE)) | ((x["kind"] == _WHOLE) & (y["kind"] == _FRESH))
        return (x["no"] != y["no"]) & (left_out | one_longer)

    # g is sorted by falling count and holds at most a letter's choice of words
    seen = groups.select(F.explode(F.transform("g", lambda x: F.struct(
        x["no"].alias("no"), F.filter("g", lambda y: linked(x, y)).alias("near")))).alias("x")).select("x.no", "x.near")
    best = F.min(F.get("near", F.lit(0))).alias("b")
    return (seen.where(F.size("near") > 0).groupBy("no").agg(F.sum(F.size("near")).cast("long").alias("n_near"), best)
            .select("no", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.no").alias("best")))


def follow(links: DataFrame) -> DataFrame:
    """(no, root) of links (no, form): the end of every chain of forms. Counts at least
    double along a chain, so it is short; every round doubles the steps taken."""
    now = save(links.select("no", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("no").alias("root"), F.col("root").alias("next"))
        moved = save(look_up(now, step, ["root"], ["no"]), "spelling-roots")
        if not moved.where("next IS NOT NULL").limit(1).count():
            return now
        now = moved.select("no", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a written table of distinct words (word, n)."""
    named, rows = pairs(words)
    near = save(near_words(rows), "spelling-near")
    named = named.join(near, "no", "left").withColumn("form", F.when(F.col("best_n") >= FORM_TIMES * F.col("n"), F.col("best")))
    named = save(named.select("no", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form",
                              F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")), "spelling-words")
    links = named.where("form IS NOT NULL").select("no", "form")
    roots = follow(links)
    # spellings of the words that are a form
    spelt = save(named.select(F.col("no").alias("form"), "word").join(links.select("form").distinct(), "form", "left_semi"), "spelling-forms")
    chains = look_up(links, spelt.withColumnRenamed("word", "form_word"), ["form"], ["no"]).drop("form").join(roots, "no")
    chains = look_up(chains, spelt.select(F.col("form").alias("root"), F.col("word").alias("root_word")), ["root"], ["no"])
    return (named.drop("form").join(chains.select("no", "form_word", "root_word"), "no", "left")
            .select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"))


def group_spellings(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts."""
    checkpoint_dir(docs.sparkSession)
    ship_package(docs.sparkSession)
    return variants(save(vocabulary(docs), "spelling-vocabulary"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return group_spellings(documents(spark, sf_dir))
