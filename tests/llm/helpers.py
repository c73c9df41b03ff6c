"""Small documents that hold the awkward cases, and brute-force versions."""
import collections
import re

SPACE = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, word string, key string, root long, "
          "hash string, n_words string, band int, a long, deal int, _words string, spans string, ids string, n int")


def words(text):
    return SPACE.findall(text or "")


def prose(i, n):
    return " ".join(f"w{(i * 31 + j * 7) % 997}x{j % 13}" for j in range(n))


def rows():
    base = prose(1, 120)
    passage = prose(77, 60)
    out = [(1, base), (2, base), (3, base.replace("w38x1", "other", 1)), (4, prose(2, 80) + " " + passage + " end here"),
           (5, "start " + passage + " " + prose(3, 70)), (6, None), (7, ""), (8, " \t\n "), (9, "three small words"),
           (10, "Three small\twords"), (11, "same " * 300), (12, "same " * 300), (None, base), (None, None),
           (13, "mail a.b@c.de or 10.0.0.1, +1 (555) 123-4567 and 4111 1111 1111 1111"),
           (14, "été " * 20 + "\nline one is here\nline one is here\n漢字 😀\0 x"), (15, "x" * 3000), (16, prose(5, 20000)),
           (9, "three small words"), (17, "a  b \n\n c\t d " * 30), (18, passage), (19, "one two three four five")]
    return [(d, t, "en", None if d == 4 else "s", None if t is None else len(t), *[None] * 13) for d, t in out]


def table(spark, made=None):
    return spark.createDataFrame(rows() if made is None else made, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    w = words((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k:k + 5]) for k in range(len(w) - 4)])


def near_components(docs):
    """{doc_id: (set size, smallest reachable)} of (doc_id, text) pairs with ids."""
    sets = {i: shingle_set(t) for i, t in docs}
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, k in collections.Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}
