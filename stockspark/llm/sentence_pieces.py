"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All new words of a batch are merged together in flat numpy arrays: one array of
symbols, one of word starts. A round looks up the merged piece of every
adjacent pair, takes the best (minimum) pair rank of each word by a segmented
minimum, merges, compacts the arrays and retires words without a pair. The
library merges the best pair of a text, leftmost first, one at a time. A round
merges all leftmost occurrences of a word's best pair at once where that is
provably the same (no piece that the merged one can become part of ranks before
it), and otherwise only the first. Rounds that merge little of a long word would
make its cost quadratic; such a word is finished from where it stands by a queue of
its pairs, in the library's order.

No piece joins a character to a space after it, so a text falls into words
(spaces, then other characters) that can be merged apart; recurring words are
looked up in a bounded table that a Python worker keeps.

Null text is empty and has no ids; a null array of ids decodes to the empty
text, null ids in it are skipped, and ids outside the vocabulary decode as the
unknown piece. Rows are independent: repeated rows give repeated results, an
empty table an empty one; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm.common import documents, prepare

SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "  # what the library prints for the unknown piece
NO_PAIR = np.int64(1) << 40
TABLE_BYTES = 200_000_000  # recurring words in a worker, ENTRY_BYTES an entry beside characters and ids
ENTRY_BYTES = 160
LONG, SLOW = 256, 64       # a word of over LONG symbols leaves the rounds when one merges under 1 / SLOW of it
CHARS = 0x110000


class PieceModel:
    """The vocabulary of a BPE model with byte fallback as numpy tables."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if (norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or not train.byte_fallback or train.model_type != train.BPE
                or any(p.type in (p.USER_DEFINED, p.UNUSED) for p in proto.pieces)):
            raise ValueError("only BPE models with byte fallback and no normalisation are supported")
        self.prefix = bool(norm.add_dummy_prefix)
        self.size = n
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if proto.pieces[i].type == proto.pieces[i].NORMAL]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)

        # symbols: piece ids, and size + code point for characters that are no piece
        of = {pieces[i]: i for i in normal}
        self.char_symbol = np.arange(CHARS, dtype=np.int64) + n
        for text, i in of.items():
            if len(text) == 1:
                self.char_symbol[ord(text)] = i
        self.char_symbol[ord(" ")] = self.char_symbol[ord(SPACE)]
        self.span = n + CHARS

        def symbol(text: str):
            return of.get(text, n + ord(text) if len(text) == 1 else None)

        scores = sorted({-sp.get_score(i) for i in normal})
        order = {s: r for r, s in enumerate(scores)}
        self.rank = np.full(n, NO_PAIR, dtype=np.int64)
        keys, values = [], []
        best_beside = np.full(n, NO_PAIR, dtype=np.int64)
        for text, i in of.items():
            self.rank[i] = order[-sp.get_score(i)]
        for text, i in of.items():
            for cut in range(1, len(text)):
                left, right = symbol(text[:cut]), symbol(text[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.span + right)
                    values.append(i)
                    for part in (left, right):
                        if part < n:
                            best_beside[part] = min(best_beside[part], self.rank[i])
        #: merging all leftmost occurrences of such a piece at once equals merging them one by one
        self.quiet = best_beside > self.rank
        self._build(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64))
        self.pairs = dict(zip(keys, values))

        in_pieces = set("".join(of))
        self.cut_lines = "\n" not in in_pieces
        # decoding: the bytes of every piece
        texts = [p.replace(SPACE, " ").encode() for p in pieces]
        for i, p in enumerate(proto.pieces):
            if p.type == p.CONTROL:
                texts[i] = b""
            elif p.type == p.UNKNOWN:
                texts[i] = UNKNOWN_SURFACE.encode()
        for b, i in enumerate(self.byte_ids):
            texts[i] = bytes([b])
        self.is_byte = np.zeros(n, dtype=bool)
        self.is_byte[self.byte_ids] = True
        self.unknown = sp.unk_id()
        self.silent = np.array([len(t) == 0 for t in texts])
        self.leads = np.array([p.startswith(SPACE) for p in pieces])
        self.lens = np.array([len(t) for t in texts], dtype=np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        self.bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.known: dict[str, bytes] = {}
        self.held = 0

    # ------------------------------------------------------------- pair table

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, as arrays."""
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        size = 1 << self.bits
        self.slot_key = np.full(size, -1, dtype=np.int64)
        self.slot_value = np.full(size, -1, dtype=np.int64)
        at, left, self.probes = self._home(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.slot_key[at[left]] < 0
            here = left[free]
            slots, first = np.unique(at[here], return_index=True)
            placed = here[first]
            self.slot_key[slots], self.slot_value[slots] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed)
            at[left] = (at[left] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, -1 for none."""
        keys = left * self.span + right
        at = self._home(keys)
        got = self.slot_key[at]
        out = np.where(got == keys, self.slot_value[at], -1)
        open_ = np.flatnonzero((got != keys) & (got >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.slot_key) - 1)
            got = self.slot_key[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.slot_value[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    # ------------------------------------------------------------- encoding

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Little-endian int32 ids of each (non-empty) word, by merge rounds."""
        if not words:
            return []
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        sym = self.char_symbol[chars]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        while len(sym):
            same = word[1:] == word[:-1]
            piece = np.full(len(sym), -1, dtype=np.int64)
            piece[:-1][same] = self.merged(sym[:-1][same], sym[1:][same])
            rank = np.where(piece >= 0, self.rank[piece], NO_PAIR)
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            best_here = np.repeat(best, sizes)
            cand = np.flatnonzero((rank == best_here) & (rank < NO_PAIR))
            if len(cand):
                fresh = np.concatenate([[True], word[cand[1:]] != word[cand[:-1]]])  # first of its word
                run = np.concatenate([[True], np.diff(cand) > 1]) | fresh
                since = np.arange(len(cand)) - np.flatnonzero(run)[np.cumsum(run) - 1]
                take = cand[fresh | (self.quiet[piece[cand]] & (since % 2 == 0))]
                sym[take] = piece[take]
                gone = np.zeros(len(sym), dtype=bool)
                gone[take + 1] = True
            else:
                gone = np.zeros(len(sym), dtype=bool)
            over = np.repeat(best >= NO_PAIR, sizes)
            slow = np.flatnonzero((sizes > LONG) & (best < NO_PAIR))
            if len(slow):
                merges = np.add.reduceat(gone.astype(np.int64), starts)
                for i in slow[merges[slow] * SLOW < sizes[slow]].tolist():
                    at = np.arange(starts[i], starts[i] + sizes[i])
                    left = self._queue(sym[at[~gone[at]]])
                    done_sym.append(left)
                    done_word.append(np.full(len(left), word[starts[i]]))
                    gone[at] = True
            done_sym.append(sym[over])
            done_word.append(word[over])
            keep = ~(gone | over)
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        if (sym >= self.size).any():
            sym, word = self._fall_back(sym, word)
        flat = sym.astype("<i4").tobytes()
        ends = np.searchsorted(word, np.arange(len(words)), side="right") * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _queue(self, sym: np.ndarray) -> np.ndarray:
        """The symbols of one word merged pair by pair: lowest rank first, then leftmost."""
        piece = self.merged(sym[:-1], sym[1:])
        at = np.flatnonzero(piece >= 0)
        heap = list(zip(self.rank[piece[at]].tolist(), at.tolist(), sym[at].tolist(), sym[at + 1].tolist()))
        heapq.heapify(heap)
        syms, n = sym.tolist(), len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if syms[i] != left or j == n or syms[j] != right:
                continue  # one of the two has been merged since
            syms[i], syms[j] = self.pairs[left * self.span + right], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n:
                    new = self.pairs.get(syms[a] * self.span + syms[b])
                    if new is not None:
                        heapq.heappush(heap, (int(self.rank[new]), a, syms[a], syms[b]))
        left = np.array(syms, dtype=np.int64)
        return left[left >= 0]

    def _fall_back(self, sym, word):
        """Characters that are no piece become the pieces of their UTF-8 bytes."""
        out, owner, last = [], [], 0
        for i in np.flatnonzero(sym >= self.size).tolist():
            out.append(sym[last:i])
            owner.append(word[last:i])
            raw = np.frombuffer(chr(int(sym[i]) - self.size).encode(), dtype=np.uint8)
            out.append(self.byte_ids[raw])
            owner.append(np.full(len(raw), word[i]))
            last = i + 1
        return np.concatenate([*out, sym[last:]]), np.concatenate([*owner, word[last:]])

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if self.prefix:
            text = " " + text
        if "  " in text or "\0" in text:
            return re.findall(r" +[^ ]*|[^ ]+", text)
        if self.cut_lines:
            text = text.replace("\n", "\0\n\0")
        return [w for w in text.replace(" ", "\0 ").split("\0") if w]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.held > TABLE_BYTES:
            self.known.clear()
            self.held = 0
        known = self.known
        split = [self.words(t) for t in texts]
        new: set[str] = set()
        for ws in split:
            new.update(w for w in ws if w not in known)
        fresh = list(new)
        made = self.merge_words(fresh)
        known.update(zip(fresh, made))
        self.held += sum(map(len, made)) + 2 * sum(map(len, fresh)) + ENTRY_BYTES * len(fresh)
        return [np.frombuffer(b"".join([known[w] for w in ws]), dtype="<i4") for ws in split]

    # ------------------------------------------------------------- decoding

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        ids = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        ids = np.where((ids < 0) | (ids >= self.size), self.unknown, ids)
        lens, begins = self.lens[ids], self.begins[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        # one leading space goes with the first piece that has a text
        if self.prefix and len(ids):
            loud = np.flatnonzero(~self.silent[ids])
            at = np.searchsorted(loud, ends[:-1])
            ok = at < len(loud)
            firsts = loud[at[ok]]
            firsts = firsts[firsts < ends[1:][ok]]
            firsts = firsts[self.leads[ids[firsts]]]
            lens[firsts] -= 1
            begins[firsts] += 1
        total = np.concatenate([[0], np.cumsum(lens)])
        take = np.arange(total[-1]) + np.repeat(begins - total[:-1], lens)
        raw = self.bytes[take].tobytes()
        out = []
        for a, b in zip(ends[:-1], ends[1:]):
            part = raw[total[a]:total[b]]
            if self.silent[ids[a:b]].any():  # a control piece ends a run of byte pieces
                out.append(self._repair(ids[a:b], part, lens[a:b]))
                continue
            try:
                out.append(part.decode())
            except UnicodeDecodeError:
                out.append(self._repair(ids[a:b], part, lens[a:b]))
        return out

    def _repair(self, ids, raw: bytes, lens) -> str:
        """A run of byte pieces that is no UTF-8: each byte outside a whole character becomes U+FFFD."""
        out, at, run = [], 0, b""
        for i, size in zip(ids.tolist() + [self.unknown], lens.tolist() + [0]):
            if self.is_byte[i] and size:
                run += raw[at:at + size]
            else:
                while run:
                    for n in (1, 2, 3, 4):
                        try:
                            out.append(run[:n].decode())
                            run = run[n:]
                            break
                        except UnicodeDecodeError:
                            continue
                    else:
                        out.append("�")
                        run = run[1:]
                out.append(raw[at:at + size].decode())
            at += size
        return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


# ----------------------------------------------------------------- Spark jobs

def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every text."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        m = model(model_path)
        for b in batches:
            ids = m.encode([t or "" for t in b.column("text").to_pylist()])
            flat = np.concatenate([np.zeros(0, "<i4"), *ids]).astype(np.int32)
            offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of every array of ids."""
    prepare(tokens.sparkSession)

    def run(batches):
        import pyarrow as pa
        m = model(model_path)
        for b in batches:
            rows = [np.array([i for i in x or [] if i is not None], dtype=np.int64) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(m.decode(rows), pa.string())],
                                             names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def with_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """All columns of ``docs`` plus n_tokens, ids (array<int>) and decoded_chars (code
    points of the text that the ids decode to); these replace columns of such names."""
    prepare(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids array<int>, decoded_chars long")
    def run(texts):
        import pandas as pd
        m = model(model_path)
        ids = m.encode([t or "" for t in texts])
        return pd.DataFrame({"n_tokens": [len(x) for x in ids], "ids": ids, "decoded_chars": [len(t) for t in m.decode(ids)]})

    made = docs.withColumn("_pieces", run(docs["text"]))
    return made.withColumns({c: F.col(f"_pieces.{c}") for c in ("n_tokens", "ids", "decoded_chars")}).drop("_pieces")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and decoded again in one pass."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        m = model(model_path)
        for b in batches:
            ids = m.encode([t or "" for t in b.column("text").to_pylist()])
            texts = m.decode(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in ids], pa.string()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence-piece ids of every document and the text decoded from them, as digests."""
    import public_tokenizers
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
