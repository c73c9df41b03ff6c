"""Token ids as directly addressable codes (DAC).

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of
every token, level l the chunk l of those tokens that go on. A bitmap per level
tells whether a token continues in the next level, and a rank directory (set
bits before each block of 512) turns its position there into one addition and
one popcount. Any token is thus read by following its own chunks; no block is
decoded.

File format: a Parquet table of segments in ascending doc_id order; each row is
one self-contained segment of whole documents with

    part, seq            range partition and place in it
    n_tokens             tokens in the segment
    doc_ids, doc_ends    its documents and where their tokens end
    levels[l]            chunk bytes of level l
    bitmaps[l]           continuation bits, lowest bit first (absent at the last level)
    ranks[l]             uint32 little endian, set bits before each block of 512

Documents with a null doc_id come first (Spark's ascending order); a null text
is empty; equal ids keep all their rows, ordered by text. An empty table gives
an empty store. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockspark.llm.common import prepare, scratch_path, shuffle_width

SEGMENT_TOKENS = 1 << 18
RANK_BITS = 512
CACHE_ENTRIES = 400_000  # in each of two generations: about 160 MB in a worker

_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)

SEGMENT_SCHEMA = ("part int, seq int, n_tokens long, doc_ids array<bigint>, doc_ends array<bigint>, "
                  "levels array<binary>, bitmaps array<binary>, ranks array<binary>")


# ----------------------------------------------------------------- the codes

def dac_encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of uint32 ids."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32, copy=False)
    while True:
        levels.append((rest & np.uint32(255)).astype(np.uint8).tobytes())
        rest = rest >> np.uint32(8)
        go_on = rest > 0
        if not go_on.any():
            return levels, bitmaps, ranks
        bits = np.packbits(go_on, bitorder="little")
        bitmaps.append(bits.tobytes())
        ranks.append(_directory(bits).tobytes())
        rest = rest[go_on]


def _directory(bits: np.ndarray) -> np.ndarray:
    step = RANK_BITS // 8
    pad = np.zeros(-len(bits) % step, np.uint8)
    per = _POP[np.concatenate([bits, pad])].reshape(-1, step).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.uint32)


def dac_get(levels, bitmaps, ranks, i: int) -> int:
    """Token ``i`` by its own chunks: one byte, one bit and one rank per level."""
    value = 0
    for level in range(len(levels)):
        value |= levels[level][i] << (8 * level)
        if level == len(bitmaps) or not bitmaps[level][i >> 3] >> (i & 7) & 1:
            return value
        block = i // RANK_BITS
        before = int.from_bytes(ranks[level][4 * block:4 * block + 4], "little")
        part = bitmaps[level][block * RANK_BITS // 8:i >> 3]
        last = bitmaps[level][i >> 3] & ((1 << (i & 7)) - 1)
        i = before + sum(b.bit_count() for b in part) + last.bit_count()
    raise ValueError("continuation beyond the last level")


def dac_slice(levels, bitmaps, ranks, lo: int, hi: int) -> np.ndarray:
    """Tokens lo..hi: a byte range of each level; its place in the next level
    comes from the rank directory."""
    out = np.zeros(hi - lo, dtype=np.uint32)
    where = np.arange(hi - lo)
    for level in range(len(levels)):
        out[where] |= np.frombuffer(levels[level], np.uint8, hi - lo, lo).astype(np.uint32) << np.uint32(8 * level)
        if level == len(bitmaps) or hi == lo:
            return out
        bits = np.frombuffer(bitmaps[level], np.uint8)
        on = np.unpackbits(bits[lo >> 3:(hi + 7) >> 3], bitorder="little")[lo & 7:(lo & 7) + hi - lo].astype(bool)
        block = lo // RANK_BITS
        directory = np.frombuffer(ranks[level], np.uint32)
        before = int(directory[block]) + int(_POP[bits[block * RANK_BITS // 8:lo >> 3]].sum(dtype=np.int64))
        if lo & 7:
            before += int(bits[lo >> 3] & ((1 << (lo & 7)) - 1)).bit_count()
        where = where[on]
        lo, hi = before, before + len(where)
    return out


# ----------------------------------------------------------------- tokenizing

class CachedEncoder:
    """ids of whole texts by the ``tokenizers`` library, words cached.

    The byte-level splitter never joins a character to a white-space character
    after it, and a single space or line feed between two other characters
    always starts a new piece, so a text may be cut there and its parts encoded
    on their own with the same ids. Parts that recur are looked up. Runs of
    several white-space characters stay whole with their neighbours.

    Recently seen parts are kept in two generations, so that rare ones leave
    and frequent ones stay. A part that is one run of letters, with or without
    punctuation after it, is cut by the splitter in the obvious places and goes
    straight to the library's merge model; other parts take its whole path.
    Tokenizers of another kind encode whole texts. Added tokens written out in
    a text ("<|endoftext|>") get their own id, as the library gives it.
    """

    # White space as the library has it; Python's \s also holds U+001C to U+001F
    _SPACE = re.compile(r"[^\S\x1c-\x1f]")
    _TWO = re.compile(r"[^\S\x1c-\x1f]{2,}")
    _TAIL = ".,;:!?&$%#*|()[]\"-"

    def __init__(self, tokenizer_path: str):
        import json
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(tokenizer_path)
        self._model = self._tok.model
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self._byte_level = (spec["normalizer"] is None and pre.get("type") == "ByteLevel"
                            and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                            and all(map(self._apart, spec.get("added_tokens") or [])))
        # the splitter's printable stand-in of each byte: itself if printable, else from U+0100 up
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in set(shown))
        self._shown = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}
        self._space = chr(self._shown[32])
        self._tails: dict[str, bytes] = {}
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _apart(self, added: dict) -> bool:
        """Whether an added token always lies inside one part, and never in a plain word or its tail."""
        content = added["content"]
        return (not (added["lstrip"] or added["rstrip"] or added["single_word"] or re.search(r"[\s\0]", content))
                and any(not c.isalpha() and c not in self._TAIL for c in content))

    def _parts(self, text: str) -> list[str]:
        if "\0" in text or not self._byte_level:
            return [text]
        out: list[str] = []
        at = 0
        for run in self._TWO.finditer(text):
            lo = self._word_start(text, at, run.start())
            if lo > at and text[lo - 1] == " ":
                lo -= 1
            after = self._SPACE.search(text, run.end())
            hi = after.start() if after else len(text)
            out += [*self._cut(text[at:lo]), text[lo:hi]]
            at = hi
        return out + self._cut(text[at:])

    @classmethod
    def _word_start(cls, text: str, lo: int, hi: int) -> int:
        """Where the word that ends at ``hi`` starts, not before ``lo``."""
        lo = max(lo, text.rfind(" ", lo, hi) + 1, text.rfind("\n", lo, hi) + 1)
        for rare in cls._SPACE.finditer(text, lo, hi):
            lo = rare.end()
        return lo

    @staticmethod
    def _cut(piece: str) -> list[str]:
        return piece.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def _merge(self, piece: str) -> bytes:
        if piece.isascii():
            shown = piece.replace(" ", self._space)
        else:
            shown = piece.encode().decode("latin-1").translate(self._shown)
        return array("I", [t.id for t in self._model.tokenize(shown)]).tobytes()

    def _encode_part(self, part: str) -> bytes:
        word = part.rstrip(self._TAIL)
        body = word[1:] if word[:1] == " " else word
        if self._byte_level and body.isalpha():
            ids = self._young.get(word) or self._old.get(word)
            if ids is None:
                ids = self._young[word] = self._merge(word)
            tail = part[len(word):]
            if tail:
                more = self._tails.get(tail)
                if more is None:
                    more = self._tails[tail] = self._merge(tail)
                ids += more
                if len(self._tails) > 10_000:
                    self._tails.clear()
            return ids
        return array("I", self._tok.encode(part, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        young, old = self._young, self._old
        if len(young) > CACHE_ENTRIES:
            young, old = self._young, self._old = {}, young
        split = [self._parts(t) for t in texts]
        new: set[str] = set()
        for parts in split:
            new.update(parts)
        for part in new.difference(young):
            young[part] = old.get(part) or self._encode_part(part)
        return [b"".join([young[p] for p in parts]) for parts in split]


_ENCODERS: dict[str, CachedEncoder] = {}  # a Python worker keeps them from task to task


def cached_encoder(tokenizer_path: str) -> CachedEncoder:
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = CachedEncoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


# ----------------------------------------------------------------- writing

def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None) -> None:
    """Encode every text and write the store: one shuffle of (doc_id, text) by
    range, then each range partition encodes and writes its own segments."""
    spark = docs.sparkSession
    prepare(spark)
    ordered = (docs.select("doc_id", "text")
               .repartitionByRange(shuffle_width(spark), F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()))

    def segments(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        encoder = cached_encoder(tokenizer_path)
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        ids: list[bytes] = []
        doc_ids: list = []
        doc_ends: list[int] = []
        total = 0

        def flush():
            nonlocal seq, ids, doc_ids, doc_ends, total
            levels, bitmaps, ranks = dac_encode(np.frombuffer(b"".join(ids), dtype="<u4"))
            cols = [[part], [seq], [total], [doc_ids], [doc_ends], [levels], [bitmaps], [ranks]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                     *[pa.list_(pa.binary())] * 3]
            names = [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
            seq, ids, doc_ids, doc_ends, total = seq + 1, [], [], [], 0
            return out

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, got in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                ids += [got, end]
                total += (len(got) + len(end)) // 4
                doc_ids.append(doc)
                doc_ends.append(total)
                if total >= SEGMENT_TOKENS:
                    yield flush()
        if doc_ids:
            yield flush()

    ordered.mapInArrow(segments, SEGMENT_SCHEMA).write.option("compression", "uncompressed").parquet(path)


# ----------------------------------------------------------------- reading

def segment_starts(store: DataFrame) -> DataFrame:
    """(part, seq, start): tokens of the store before each segment. Only the
    last step sees one row per range partition in one task; the running sums
    inside the partitions are spread by partition."""
    size = store.select("part", "seq", "n_tokens")
    parts = size.groupBy("part").agg(F.sum("n_tokens").alias("_part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_part_tokens").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (size.withColumn("_before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .join(parts, "part").select("part", "seq", (F.col("_base") + F.col("_before")).alias("start")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files."""
    store = spark.read.schema(SEGMENT_SCHEMA).parquet(path)

    def unpack(batches):
        import pyarrow as pa
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.array(row["doc_ends"], dtype=np.int64)
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                ids = dac_slice(row["levels"], row["bitmaps"], row["ranks"], 0, row["n_tokens"])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins, ends)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(begins), pa.array(ends - begins),
                     pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "_begin", "n_tokens", "ids_crc32"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # rows are whole segments here
    docs = store.mapInArrow(unpack, "part int, seq int, doc_id long, _begin long, n_tokens long, ids_crc32 long")
    return (docs.join(segment_starts(store), ["part", "seq"])
            .select("doc_id", (F.col("start") + F.col("_begin")).alias("start"), "n_tokens", "ids_crc32"))


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, id) for global token positions (column ``position``); a null
    position or one outside the store gives no row, repeated ones repeat.

    Segments and positions meet on the position's block of SEGMENT_TOKENS, an
    equality join; each row then follows only its own token's chunks.
    """
    store = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    size = F.lit(SEGMENT_TOKENS)
    where = (segment_starts(store).join(store.select("part", "seq", "n_tokens"), ["part", "seq"])
             .where("n_tokens > 0")
             .select("part", "seq", "start", (F.col("start") + F.col("n_tokens")).alias("stop"),
                     F.explode(F.sequence(F.floor(F.col("start") / size),
                                          F.floor((F.col("start") + F.col("n_tokens") - 1) / size))).alias("_block")))
    asked = positions.select("position", F.floor(F.col("position") / size).alias("_block"))
    found = (asked.join(where, "_block").where("position >= start and position < stop")
             .select("part", "seq", (F.col("position") - F.col("start")).alias("_i"), "position"))
    # positions of one segment are gathered in lists, so a segment is sent once for many of them
    grouped = found.groupBy("part", "seq", F.floor(F.rand(7) * 16).alias("_salt")).agg(
        F.collect_list(F.struct("_i", "position")).alias("_asked"))
    rows = grouped.join(store.select("part", "seq", "levels", "bitmaps", "ranks"), ["part", "seq"])

    def get(batches):
        import pyarrow as pa
        for batch in batches:
            for r in batch.to_pylist():
                got = [(x["position"], dac_get(r["levels"], r["bitmaps"], r["ranks"], x["_i"])) for x in r["_asked"]]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()),
                                                  pa.array([g[1] for g in got], pa.int64())], names=["position", "id"])

    return rows.select("_asked", "levels", "bitmaps", "ranks").mapInArrow(get, "position long, id long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document written as directly addressable codes and read back."""
    import public_tokenizers

    from stockspark.llm.common import documents
    path = scratch_path(spark, "dac")
    write_store(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_documents(spark, path)
