"""Token store, sentence pieces, near and substring duplicates, rollups, language model: against brute force."""
import collections
import functools
import hashlib
import math
import os
import random
import time
import tempfile
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from stockspark.llm import maxent_lm, near_dup, sentence_pieces, substring_dup, token_rollup, token_store

from .helpers import LOWER, SCHEMA, empty, near_components, prose, rows, table, words

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# ----------------------------------------------------------------- token store

@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=2000))
def test_codes_give_every_token_back(ids):
    arr = np.array(ids, dtype=np.uint32)
    code = token_store.dac_encode(arr)
    assert (token_store.dac_slice(*code, 0, len(arr)) == arr).all()
    for i in random.Random(1).sample(range(len(ids)), min(len(ids), 20)):
        assert token_store.dac_get(*code, i) == ids[i]
        assert (token_store.dac_slice(*code, i, len(arr)) == arr[i:]).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", " ", "\n", "'s", "'", "1", "²", "½", "_", "-", ".", "!", "\t", " ", "漢", "😀", "\0", "\x1c",
                                  "<|endoftext|>"]), max_size=20).map("".join))
def test_cached_encoder_equals_library(text):
    enc = token_store.cached_encoder(BPE)
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == enc._tok.encode(text, add_special_tokens=False).ids


@functools.cache
def fresh_tokenizer():
    return Tokenizer.from_file(BPE)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "é", " ", "\n", "\t", "'s", "<", "|>", "\0", "<|endoftext|>", " <|endoftext|> "]),
                max_size=16).map("".join))
def test_encoder_equals_a_freshly_loaded_library(text):
    fresh = fresh_tokenizer()
    enc = token_store.cached_encoder(BPE)
    for t in (text, "a <|endoftext|> b"):
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids


def test_encoder_on_control_characters_and_long_words():
    """U+001C to U+001F are no white space to the library; a long word beside a run costs no rescans."""
    fresh, enc, r = fresh_tokenizer(), token_store.cached_encoder(BPE), random.Random(6)
    parts = ["a", "b.", " ", "  ", "\n", "\t", "'s", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u2003", "\u3000", "\u2028", "\u180e", "\u200b", "é", "1"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(20000)]
    texts += ["\x1c's  \u3000", "a" * 30000 + " b  c", "x " * 20000 + "\n\n" + "y" * 30000 + "  ", "\t\t".join(["w" * 50] * 2000)]
    got = enc.encode(texts)
    want = [e.ids for e in fresh.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


@pytest.mark.parametrize("added", [{"content": "foo"}, {"content": "&&"}, {"content": "<a b>"}, {"content": "<x>", "lstrip": True},
                                   {"content": "<x>", "rstrip": True}, {"content": "<x>", "single_word": True}])
def test_added_tokens_of_any_kind(added, tmp_path):
    tok = Tokenizer.from_file(BPE)
    tok.add_special_tokens([AddedToken(**added)])
    path = str(tmp_path / "tokenizer.json")
    tok.save(path)
    text = "a foo foo. foobar a&& && b <a b> c <x> d<x>e\n<x>\n <x> foo\nfoo"
    got = token_store.CachedEncoder(path).encode([text, "foo", "b&&"])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in (text, "foo", "b&&")]


def test_store_round_trip_and_random_access(spark):
    path = os.path.join(tempfile.mkdtemp(), "dac")
    token_store.write_store(table(spark), path, BPE, end_id=2)
    got = token_store.read_documents(spark, path).collect()
    assert len(got) == len(rows())
    tok = token_store.cached_encoder(BPE)._tok
    ordered = sorted(((d, t) for d, t, *_ in rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    flat, expected = [], []
    for d, t in ordered:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((d, len(flat), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        flat += ids
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    asked = [0, 5, 5, len(flat) - 1, 700, len(flat), -1, None]
    found = token_store.tokens_at(spark, path, spark.createDataFrame([(a,) for a in asked], "position long")).collect()
    assert sorted(map(tuple, found)) == sorted((p, flat[p]) for p in (0, 5, 5, len(flat) - 1, 700))


def test_empty_store(spark):
    path = os.path.join(tempfile.mkdtemp(), "dac")
    token_store.write_store(empty(spark), path, BPE, end_id=2)
    assert token_store.read_documents(spark, path).count() == 0


# ----------------------------------------------------------------- sentence pieces

@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_library(library):
    m, r = sentence_pieces.model(PIECES), random.Random(4)
    parts = ["the", "er", "in", "a", "t", "h", "e", " ", "  ", "\n", "on", "ing", "é", "漢", "😀", "\0", "▁", "ab", "<s>", "0x41"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 300, "▁" * 77, "", "the " * 500, "aaaaab" * 999, "xyzzy" * 4000]
    ids = m.encode(texts)
    assert [x.tolist() for x in ids] == library.encode(texts)
    assert m.decode(ids) == [library.decode(x.tolist()) for x in ids]


def test_decode_of_any_ids_equals_library(library):
    m, r = sentence_pieces.model(PIECES), random.Random(5)
    made = [[r.choice([0, 1, 2, 259, 261, r.randint(3, 258), r.randint(3, 258), r.randint(0, 31999)])
             for _ in range(r.randint(0, 9))] for _ in range(5000)]
    assert m.decode([np.array(x) for x in made]) == [library.decode(x) for x in made]


def test_pieces_on_awkward_rows(spark, library):
    got = sentence_pieces.round_trip(table(spark), PIECES).collect()
    want = []
    for d, t, *_ in rows():
        ids = library.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    ids = sentence_pieces.encode(table(spark), PIECES)
    assert ids.count() == sentence_pieces.decode(ids, PIECES).count() == len(rows())
    odd = spark.createDataFrame([(1, None), (2, [None, 261, 99999, -5]), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sentence_pieces.decode(odd, PIECES).collect()} == {1: "", 2: "t ⁇  ⁇ ", 3: ""}
    full = sentence_pieces.with_ids(table(spark), PIECES)
    assert full.where("size(ids) <> n_tokens").count() == 0
    assert sentence_pieces.round_trip(empty(spark), PIECES).count() == 0


# ----------------------------------------------------------------- near duplicates

def check_components(spark, docs, df):
    want = near_components([(d, t) for d, t in docs if d is not None])
    for r in near_dup.components(df).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


def test_near_dup_on_awkward_rows(spark):
    check_components(spark, [(d, t) for d, t, *_ in rows()], table(spark))
    assert near_dup.components(empty(spark)).count() == 0
    kept = near_dup.keep_one(table(spark))
    assert kept.columns == table(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 2 not in ids and 3 not in ids and ids.count(9) == 2 and ids.count(None) == 2


def test_near_dup_chains_and_threshold(spark):
    """Chains of ever more edits, sets at the threshold, and a group of copies."""
    r, docs = random.Random(9), []
    for g in range(6):
        w = prose(100 + g, 160).split()
        for k in range(15):
            docs.append((len(docs), " ".join(w)))
            for _ in range(3):
                w[r.randrange(len(w))] = f"new{g}_{k}_{r.randrange(99)}"
    docs += [(len(docs) + i, prose(500, 90)) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    check_components(spark, docs, df)


def test_sketch_estimates_similarity_and_fills_every_coordinate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    for j in (0.5, 0.75, 0.9):
        both = int(2000 * j / (1 + j))
        b = np.concatenate([a[:both], rng.integers(0, 2**63, 1000 - both, dtype=np.uint64)])
        assert abs((near_dup.sketch(a) == near_dup.sketch(b)).mean() - j) < 0.1
    few = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 40, 700)]
    many = near_dup.sketch_all(few)
    assert (many > 0).all()
    for got, s in zip(many, few):
        assert (got == near_dup.sketch(s)).all()


# ----------------------------------------------------------------- substring dedup

def brute_substrings(docs):
    seen, out = {}, {}
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - 49):
            g = tuple(w[k:k + 50])
            if d is not None:
                seen[g] = min(seen.get(g, d), d)
    for d, t in docs:
        w, gone = words(t), [False] * len(words(t))
        for k in range(len(w) - 49):
            if d is not None and seen[tuple(w[k:k + 50])] < d:
                gone[k:k + 50] = [True] * 50
        out[(d, t)] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("per_block", [4096, 2])
def test_substring_dedup(spark, monkeypatch, per_block):
    monkeypatch.setattr(substring_dup, "DOCS_PER_BLOCK", per_block)
    r = random.Random(3)
    docs = [(d, t) for d, t, *_ in rows()]
    hot = prose(900, 70)
    docs += [(100 + i, f"a{i} " * r.randint(0, 9) + hot + f" b{i}" * r.randint(0, 60)) for i in range(20)]
    docs += [(200 + i, prose(300, 49 + i)) for i in range(4)]
    made = [(d, t, "en", "s", 0, *[None] * 13) for d, t in docs]
    got = substring_dup.dedup(table(spark, made)).collect()
    assert sorted(map(str, ((x.doc_id, x.n_words, x.n_removed, x.text) for x in got))) == sorted(
        str((d, *brute_substrings(docs)[(d, t)])) for d, t in docs)
    assert substring_dup.dedup(empty(spark)).count() == 0


# ----------------------------------------------------------------- token rollups

def test_ledger_inserts_revisions_deletes_and_replays(spark):
    ledger = token_rollup.TokenLedger(spark, os.path.join(tempfile.mkdtemp(), "ledger"))
    schema = "op string, doc_id long, seq int, source string, lang string, text string, n_tokens string, tokenizer int"

    def send(n, *changes):
        return ledger.apply(n, spark.createDataFrame([(*c, None, None) for c in changes], schema))

    def now(name="words-1"):
        return {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in ledger.totals().where(F.col("tokenizer") == name).collect()}

    assert send(1, ("put", 1, 0, "s", "en", "a b c"), ("put", 2, 0, "s", "en", "d e"), ("put", 3, 0, None, None, None),
                ("put", None, 0, "s", "en", "x"), ("odd", 9, 0, "s", "en", "x"), ("put", 1, 0, "s", "en", "a b c"))
    assert now() == {("s", "en"): (2, 5), (None, None): (1, 0)}
    assert not send(1, ("put", 8, 0, "s", "en", "ignored, sent twice"))
    assert send(2, ("put", 1, 1, "t", "en", "a b"), ("put", 1, 2, "t", "de", "a b c d"), ("delete", 2, 0, None, None, None),
                ("delete", 77, 0, None, None, None))
    assert now() == {("t", "de"): (1, 4), (None, None): (1, 0)}
    assert send(3, ("put", 2, 0, "s", "en", "back again"), ("delete", 1, 0, None, None, None))
    assert now() == {("s", "en"): (1, 2), (None, None): (1, 0)}
    assert send(4) and now() == {("s", "en"): (1, 2), (None, None): (1, 0)}
    assert now("units-1")[("s", "en")] == (1, 2)
    # a batch that broke off before its commit leaves nothing that counts, and runs again
    spark.createDataFrame([("s", "en", "words-1", 5, 500)], "source string, lang string, tokenizer string, d_docs long, d_tokens long").write.parquet(
        f"{ledger.root}/deltas/batch=5")
    assert now()[("s", "en")] == (1, 2)
    assert send(5, ("put", 5, 0, "s", "en", "x y z")) and now()[("s", "en")] == (2, 5)
    assert ledger.committed() == [1, 2, 3, 4, 5]


# ----------------------------------------------------------------- language model

def test_language_model_counts_mass_and_held_out_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if os.path.isdir(SF) else table(spark)
    extra = table(spark).select("doc_id", "text")
    docs = docs.select("doc_id", "text").where("doc_id >= 20").unionByName(extra)
    train = docs.where(~maxent_lm.held_out(F.col("doc_id")))
    model, counts = maxent_lm.fit(train)
    got = maxent_lm.score(docs, model, counts).collect()
    c, seen = collections.Counter(), collections.defaultdict(list)
    for r in docs.collect():
        w = words((r.text or "").translate(LOWER)) + [None]
        held = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 2
        seen[r.doc_id].append(w)
        if not held:
            c.update(w)
    n, v = sum(c.values()), len(c)
    assert (model.total, model.distinct) == (n, v)
    assert len(got) == sum(map(len, seen.values()))
    gain = 0.0
    for r in got:
        fits = [w for w in seen[r.doc_id] if len(w) == r.n_tokens and r.n_known == sum(c[x] > 0 for x in w)
                and math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)]
        assert fits and math.isfinite(r.score) and r.score < 0
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2:
            gain += r.score - r.base_score
    assert gain > 0
    # every score equals a direct walk down the class tree, token by token
    def walk(tokens):
        feats = [maxent_lm.features(np.array(tokens, dtype=np.uint64), np.arange(len(tokens)))[:, i] for i in range(len(tokens))]
        total = 0.0
        for token, f in zip(tokens, feats):
            at = np.flatnonzero(model.words == token)
            if len(at):
                leaf = at[0]
            else:
                bucket = int(token >> np.uint64(maxent_lm.BUCKET_SHIFT)) % model.buckets
                leaf = len(model.words) + bucket
                total += math.log10((seen_words.get(int(token), 0) + 1) / model.tail_norm[bucket])
            for level in range(model.depth[leaf]):
                node, child = model.nodes[leaf, level], model.children[leaf, level]
                z = model.offset[node].astype(float)
                for x in f:
                    row = (((int(x) ^ int(model.salt[node])) * int(maxent_lm._SPREAD)) % 2**64) >> (64 - model.bits)
                    z = z + model.weights[min(level, maxent_lm.TABLES - 1)][row]
                total += (z[child] - np.logaddexp.reduce(z)) / math.log(10)
        return total
    import pyarrow as pa
    seen_words = {r.word & (2**64 - 1): r.c for r in counts.collect()}
    want = collections.defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(walk(maxent_lm.token_arrays(pa.array([r.text], pa.string()))[0][:400]))
    for r in got:
        if r.n_tokens <= 400:
            assert any(math.isclose(r.score, x, rel_tol=1e-4) for x in want[r.doc_id])


@pytest.mark.parametrize("known, buckets", [(0, 1), (1, 1), (5, 1), (40, 4), (3000, 16)])
def test_language_model_masses_sum_to_one(known, buckets):
    rng = np.random.default_rng(known)
    tail = rng.integers(0, 50, buckets)
    counts = rng.integers(1, 1 + 10 ** rng.integers(1, 6, known)) if known else np.zeros(0, np.int64)
    model = maxent_lm.Model(np.arange(known, dtype=np.uint64), counts, int(counts.sum() + tail.sum()), known + buckets, tail, tail)
    n = known + buckets
    for context in range(3):
        model.weights[:] = rng.normal(0, 0.5, model.weights.shape)
        feats = np.full((4, n), context * 12345, dtype=np.uint64)
        assert math.isclose((10 ** model.log10(feats, np.arange(n))).sum(), 1.0, rel_tol=1e-4)


def test_language_model_grows_with_the_vocabulary():
    sizes = [maxent_lm.n_buckets(n) for n in (0, 1, 10**4, 10**6, 10**8, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] == 1 and len(set(sizes)) >= 4


def test_language_model_without_texts(spark):
    none = empty(spark).select("doc_id", "text")
    model, counts = maxent_lm.fit(none)
    assert maxent_lm.score(none, model, counts).count() == 0
    got = maxent_lm.score(table(spark), model, counts).collect()
    assert len(got) == len(rows()) and all(r.n_known == 0 and math.isfinite(r.score) for r in got)


# ----------------------------------------------------------------- long unspaced words

@functools.cache
def _both():
    import sentencepiece
    return sentence_pieces.PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize("letters", ["a", "=", "ab", "etaoinshrdlu", "0123456789", "esr", " ", "漢字東京", "aA+/9xQ"])
def test_long_words_equal_library_in_time(letters):
    mine, theirs = _both()
    rng = random.Random(len(letters))
    for n in (1, sentence_pieces.LONG, sentence_pieces.LONG + 1, 5000, 100_000):
        text = "".join(rng.choice(letters) for _ in range(n))
        began = time.monotonic()
        assert mine.encode([text])[0].tolist() == theirs.encode(text)
        assert time.monotonic() - began < 30  # two million merge steps and more if it were quadratic


def test_queue_equals_library_from_any_round(monkeypatch):
    mine, theirs = _both()
    rng = random.Random(9)
    for long_, slow in ((1, 1), (2, 64), (8, 2), (64, 8)):
        monkeypatch.setattr(sentence_pieces, "LONG", long_)
        monkeypatch.setattr(sentence_pieces, "SLOW", slow)
        for _ in range(200):
            letters = rng.choice(["etaoin", "aA=-_", "therising ", "esr", "é漢a"])
            texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 300))) for _ in range(3)]
            mine.known.clear()
            assert [x.tolist() for x in mine.encode(texts)] == theirs.encode(texts)


def test_word_table_is_bounded_by_bytes(monkeypatch):
    mine, theirs = _both()
    monkeypatch.setattr(sentence_pieces, "TABLE_BYTES", 10_000)
    rng = random.Random(4)
    for _ in range(20):
        text = " ".join("".join(rng.choice("etaoin") for _ in range(400)) for _ in range(10))
        assert mine.encode([text])[0].tolist() == theirs.encode(text)
    assert mine.held < 10_000 + 40_000 and len(mine.known) < 60


# ----------------------------------------------------------------- pipeline

@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_pipeline_equals_brute_force(spark, library):
    import corpus_pipeline
    from stockspark.llm import decontaminate, pii, quality
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.OP5_SQL}) WHERE kept").fetchall()}
    docs = [(d, t) for d, t in con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if d in good]
    first = near_components(docs)
    docs = [(d, t) for d, t in docs if first[d][1] == d]
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    leaked = {r[0] for r in con.execute(decontaminate.OP1_SQL).fetchall()}
    want = {d: library.encode(pii.redact_text(t)) for d, t in docs if d not in leaked}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want)


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for made in (table(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, made, str(tmp_path))
            if name != "tokens":
                assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
            assert out.count() <= made.count()
