"""Source mixing, spelling variants and vector codes: against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockspark.llm import common, queries, source_mix, spelling, vector_codes

from .helpers import LOWER, empty, prose, rows, table, words

SF = "/root/testdata/sf0.001"


# ----------------------------------------------------------------- source mixing

def brute_targets(sizes, weights=(5, 2, 1), most=3, total=None):
    """{source: target}; sources by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(sizes.values()) if total is None else total
    capped = set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and most * sizes[s] * free < w[s] * left}
        if not more:
            return {s: float(most * sizes[s]) if s in capped else w[s] * left / max(free, 1) for s in order}
        capped |= more


def brute_mix(made, **kw):
    """Sorted (doc_id, size, target, taken); identical rows in any order."""
    docs = [(d, s, t, len(words(t)), int(hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16)) for d, s, t in made]
    sizes = Counter()
    for _, s, _, n, _ in docs:
        sizes[s] += n
    goal = brute_targets(dict(sizes), **kw)
    most, out = kw.get("most", 3), []
    for s in sizes:
        whole = min(math.floor(goal[s] / sizes[s]), most) if sizes[s] else 0
        need = goal[s] - whole * sizes[s] if sizes[s] and whole < most else 0
        upto = 0
        for d, _, _, n, _ in sorted((x for x in docs if x[1] == s), key=lambda x: x[4]):
            upto += n
            again = need > 0 and (upto < need or (upto - n < need and 2 * (need - upto + n) >= n))
            out.append((d, n, goal[s], n * (whole + again)))
    return sorted(out, key=str)


def mixed_rows(df):
    return sorted(map(tuple, df.select("doc_id", "size", "target", "taken").collect()), key=str)


def made_docs(seed):
    r = random.Random(seed)
    return [(i, r.choice(["a", "b", "ä", "Z", None, "zz"] + ["hot"] * 4), prose(i, r.choice([0, 1, 3, 9, 40, 400]))) for i in range(r.randint(1, 160))]


@pytest.mark.parametrize("seed, kw", [(1, {}), (2, {"weights": (1, 9)}), (3, {"most": 1}), (4, {"total": 700}), (5, {"total": 10**6})])
def test_mix_equals_brute_force(spark, seed, kw):
    made = made_docs(seed)
    docs = spark.createDataFrame([(d, s, t) for d, s, t in made], "doc_id long, source string, text string").repartition(5)
    asked = {k: v for k, v in kw.items() if k != "total"} | ({"budgets": (kw["total"],)} if "total" in kw else {})
    got = source_mix.mix(docs, **asked)
    assert mixed_rows(got) == brute_mix(made, **kw)


def test_mix_of_awkward_rows(spark):
    got = source_mix.mix(table(spark))
    made = [(d, s, t) for d, t, _, s, *_ in rows()]
    assert mixed_rows(got) == brute_mix(made)
    assert mixed_rows(source_mix.mix(table(spark))) == mixed_rows(got)  # reruns agree
    assert source_mix.mix(empty(spark)).count() == 0
    none = spark.createDataFrame([(1, None, "s"), (2, " \n", None)], "doc_id long, text string, source string")
    assert {tuple(r) for r in source_mix.mix(none).select("doc_id", "size", "target", "taken").collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_identical_rows_at_the_threshold(spark):
    """One source of 900 equal rows and one that outweighs it: as many as fit are taken."""
    docs = spark.createDataFrame([(None, "same five words are here", "a")] * 900 + [(1, prose(1, 4500), "b")],
                                 "doc_id long, text string, source string").repartition(7)
    got = source_mix.mix(docs, weights=(1, 2)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert {r.source: (r.t, r.g) for r in got} == {"a": (3000, 3000.0), "b": (4500, 6000.0)}


def test_smaller_mixes_are_parts_of_larger_ones(spark):
    made = made_docs(9)
    docs = spark.createDataFrame([(d, s, t) for d, s, t in made], "doc_id long, source string, text string")
    got = source_mix.mix(docs, budgets=(100, 900, None, 20000)).collect()
    taken = defaultdict(dict)
    for r in got:
        taken[r.budget][r.doc_id] = r.copies
    assert sorted(taken) == [0, 1, 2, 3]
    for small, large in zip(range(3), range(1, 4)):
        assert all(n <= taken[large][d] for d, n in taken[small].items())


def test_mixed_documents_keep_all_columns(spark):
    docs = table(spark).withColumn("taken", F.lit("mine")).withColumn("size", F.lit(1))
    got = source_mix.mixed(docs)
    assert got.columns == docs.columns
    assert got.count() == source_mix.mix(table(spark)).agg(F.sum("copies")).first()[0]
    assert {r.taken for r in got.select("taken").collect()} == {"mine"}


def test_look_up_beyond_the_broadcast_bound(spark, monkeypatch):
    big = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5) for i in range(100)], "i long, k long")
    small = spark.createDataFrame([(None, "n"), (1, "one"), (2, "two")], "k long, word string")
    want = sorted((i, {None: "n", 1: "one", 2: "two"}.get(None if i % 3 == 0 else i % 5)) for i in range(100))
    for bound, hot in ((common.BROADCAST_BYTES, common.HOT_ROWS), (0, common.HOT_ROWS), (0, 4)):
        monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        got = common.look_up(big, small, ["k"], ["i"])
        assert sorted((r.i, r.word) for r in got.collect()) == want


# ----------------------------------------------------------------- spelling variants

def brute_words(made):
    count = Counter()
    for d, t in made:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(count):
    near = {w: [v for v in count if v != w and one_edit(v, w)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= 2 * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("block_chars", [1 << 20, 60])
def test_variants_equal_brute_force(spark, monkeypatch, block_chars):
    monkeypatch.setattr(spelling, "BLOCK_CHARS", block_chars)
    r = random.Random(3)
    made = {"".join(r.choice("abé") for _ in range(r.randint(5, 7))): r.choice([3, 4, 6, 9, 20, 50, 200]) for _ in range(150)}
    made |= {"x" * n: 3 * n for n in range(5, 12)} | {"y" * 400: 8, "y" * 401: 3, "ÿ" * 5: 7, "÷" * 5: 9}
    words_ = common.save(spark.createDataFrame(list(made.items()), "word string, n long"), "test-words")
    assert sorted(map(tuple, spelling.variants(words_).collect())) == brute_variants(made)


def test_chains_of_forms(spark):
    """wordsa -> wordsab -> wordsabc -> ...: the root is the end of the chain."""
    made = {"wordsabcdefghijk"[:n]: 3 * 2 ** n for n in range(5, 17)}
    words_ = common.save(spark.createDataFrame(list(made.items()), "word string, n long"), "test-words")
    got = spelling.variants(words_).collect()
    assert {r.root for r in got} == {"wordsabcdefghijk"} and sorted(map(tuple, got)) == brute_variants(made)


def test_spellings_of_documents(spark):
    extra = [(100 + i, f"Colour colour COLOUR color Straße straße Ärger ärger ärgers runs{i % 3}on ×÷abc naïve naive") for i in range(30)]
    extra += [(None, "colour colours"), (7, "colour")] * 3
    docs = table(spark).select("doc_id", "text", "word", "n", "a").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    made = [(d, t) for d, t, *_ in rows()] + extra
    got = spelling.group_spellings(docs)
    assert sorted(map(tuple, got.collect())) == brute_variants(brute_words(made))
    assert spelling.group_spellings(empty(spark)).count() == 0
    assert spelling.group_spellings(spark.createDataFrame([(1, "only rare words")], "doc_id long, text string")).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(f"Wörd{'x' * (i % 7)}q" for i in range(3000)) + " " + "z" * 50000
    whole = spelling.words_of_text(5, text)
    monkeypatch.setattr(spelling, "PIECE", 100)
    assert spelling.words_of_text(5, text) == whole and spelling.words_of_text(None, None) == Counter()


def test_a_megabyte_of_one_letter(spark):
    docs = spark.createDataFrame([(i, "A" * 1_000_000) for i in range(3)] + [(9, "a" * 6)] * 3, "doc_id long, text string")
    assert {(len(r.word), r.n) for r in spelling.group_spellings(docs).collect()} >= {(6, 3)}


# ----------------------------------------------------------------- vector codes

def brute_codes(made, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, lab, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, lab in made
            if v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    width = -(-max((len(v) for _, _, v in kept), default=0) // parts) * parts
    kept = [(i, lab, v + [0] * (width - len(v))) for i, lab, v in kept]
    dim = width // parts
    cut = [[v[p * dim:(p + 1) * dim] for p in range(parts)] for _, _, v in kept]
    first = {}
    for i, _, v in sorted((x for x in kept if x[0] is not None), key=lambda x: (x[0], x[2])):
        first.setdefault(i, v)
    start = list(first.values())[:entries]
    books = [[v[p * dim:(p + 1) * dim] for v in start] for p in range(parts)]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        at = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in a) for a in assigned()]
    by_label = Counter()
    for (_, lab, _), e in zip(kept, errors):
        by_label[lab] += e
    return sorted((str((i, "".join(f"{k:02x}" for _, k in a), e, by_label[lab], sha))) for (i, lab, _), a, e in zip(kept, assigned(), errors))


VECTORS = "vec_id long, embedding array<float>, label int, code string, v int, p int, error string"


def vectors(spark, made):
    return spark.createDataFrame([(*r, "c", 1, 2, "e") for r in made], VECTORS).repartition(3)


def made_vectors(seed, n, dim, values):
    r = random.Random(seed)
    return [(r.randint(0, n), [r.choice(values) if values else r.gauss(0, 1) for _ in range(dim)], r.choice([None, 1, 2])) for _ in range(n)]


@pytest.mark.parametrize("seed, n, dim, values", [(1, 90, 16, None), (2, 120, 8, [-0.5, 0.0, 0.25]), (3, 60, 64, None), (4, 7, 24, [1e-5, -1e-5])])
def test_codes_equal_brute_force(spark, seed, n, dim, values):
    made = made_vectors(seed, n, dim, values)
    nan, inf = float("nan"), float("inf")
    made += [(0, None, 1), (1, [nan] * dim, 1), (-5, [inf] + [0.0] * (dim - 1), 2), (-6, [None] + [0.0] * (dim - 1), 2), (None, [0.5] * dim, None),
             made[0], made[0]]
    assert sorted(str(tuple(r)) for r in vector_codes.compress(vectors(spark, made)).collect()) == brute_codes(made)


def test_codes_of_odd_tables(spark):
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).count() == 0
    uneven = [(1, [1.0, 2.0, 3.0], 1), (2, [], 1), (3, [0.5] * 11, None)]
    assert sorted(str(tuple(r)) for r in vector_codes.compress(vectors(spark, uneven)).collect()) == brute_codes(uneven)
    unnamed = vector_codes.compress(vectors(spark, [(None, [1.0] * 8, 1)] * 2)).collect()
    assert [(r.vec_id, r.code, r.error) for r in unnamed] == [(None, "00" * 8, 8 * 4096 ** 2)] * 2
    huge = vector_codes.compress(vectors(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)]), entries=2).collect()
    assert len(huge) == 3 and all(r.error >= 0 for r in huge)


@pytest.mark.parametrize("spread", [2, 30, 10**7])
def test_equal_average_search_finds_the_nearest(spread):
    r = np.random.default_rng(spread)
    for _ in range(30):
        k, dim, n = int(r.integers(1, 40)), int(r.integers(1, 9)), int(r.integers(0, 200))
        x, entries = r.integers(-spread, spread, (n, dim)), r.integers(-spread, spread, (k, dim))
        d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        index, best = vector_codes.nearest(x, entries)
        assert (best == d.min(axis=1)).all() and (index == d.argmin(axis=1)).all()


def test_codes_decode_to_entries(spark):
    made = [(i, [float(i % 4)] * 16, 0) for i in range(20)]
    ints = common.save(vector_codes.integer_vectors(vectors(spark, made)), "test-vectors")
    books = vector_codes.train(ints, parts=4, entries=4, rounds=2)
    for r in books.encode(ints).collect():
        assert r.error == 0 and books.decode(r.code).tolist() == [r.vec_id % 4 * 4096] * 16


def test_queries_are_registered():
    assert {"op11_source_mix", "op12_spelling_variants", "op13_vector_codes"} <= set(queries.QUERIES)
    assert {"op11_source_mix", "op13_vector_codes"} <= set(queries.ORACLE_SQL)
