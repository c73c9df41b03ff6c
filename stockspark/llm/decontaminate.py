"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Every text becomes a list of canonical words: numbers, names and units of
measure turn into typed placeholders, the rest is lower-cased without outer
punctuation. Windows of ``WINDOW`` canonical words (the whole item where it is
shorter) are hash-joined with those of the benchmark, so a question with other
numbers or names still meets its template. A document and an item are then
aligned (window position minus item position). A window whose slots hold the
item's own values counts. One with other values counts if its alignment is
consistent: one value of the item always stands for one value of the document.
Windows of which fewer than ``MIN_LITERALS`` words are left beside placeholders
are joined with their real values instead, so numbers and names alone match only
as they are. An item leaks when at least ``LEAK_WINDOWS`` of its windows count,
or half of them for shorter items.

Words: [^\\x20\\x09-\\x0D]+, those without a letter or digit are left out.
number = digits with . or , between; unit = a word of UNITS after a number;
name = a capitalised word after a word that does not end a sentence.

Null or empty texts have no windows and never leak; benchmark items without a
word are ignored; repeated documents each get their rows, items with equal text
each count. An empty table on either side gives an empty result. Other columns
are ignored, or pass through ``clean``. A null doc_id cannot be reported: such
rows are not searched and ``clean`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm.common import documents, let, prepare, save, words_of

WINDOW = 8
MIN_LITERALS = 5       # of the words of a full window; with fewer, real values take the placeholders' place
LEAK_WINDOWS = 6       # 13 words in a row
BROADCAST_ROWS = 1_000_000  # of 16 bytes: the most that is sent to every executor

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Units of measure that may follow a number.
UNITS = ("mm cm m km in inch inches ft feet foot mi mile miles yard yards mg g kg t lb lbs oz gram grams kilogram kilograms "
         "ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month "
         "months year years kmh mph percent dollar dollars euro euros cent cents usd eur c f degrees").split()
_NUMBER = "^[0-9]+([.,][0-9]+)*$"
# The same for java.util.regex, possessive: it would recurse once per group of a long number.
_IS_NUMBER = "^[0-9]++(?:[.,][0-9]++)*+$"
_NAME = r"^\p{Lu}[\p{Ll}'-]+$"
_ENDS = r"[.!?:;]$"
_MID_NAME = r"[^.!?:;\x20\x09-\x0D][\x20\x09-\x0D]+[!-/:-@\[-`{-~]*\p{Lu}"


def _core(word: Column) -> Column:
    return F.btrim(word, F.lit(PUNCTUATION))


def canonical(text: Column) -> Column:
    """array<struct<w: canonical word, v: replaced value or null>> of a text."""
    plain = F.transform(
        F.filter(F.transform(words_of(text), lambda x: F.lower(_core(x))), lambda c: c != ""),
        lambda c: F.struct(c.alias("w"), F.lit(None).cast("string").alias("v")))

    def typed(ws: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(ws, i - 1)
            kind = (F.when(x.rlike(_IS_NUMBER), "<num>")
                    .when(F.lower(x).isin(UNITS) & F.coalesce(before["core"].rlike(_IS_NUMBER), F.lit(False)), "<unit>")
                    .when(x.rlike(_NAME) & F.coalesce(~before["word"].rlike(_ENDS), F.lit(False)), "<name>"))
            return F.struct(F.coalesce(kind, F.lower(x)).alias("w"), F.when(kind.isNotNull(), F.lower(x)).alias("v"))
        return F.transform(ws, lambda x, i: one(x["core"], i))

    worded = F.filter(F.transform(words_of(text), lambda x: F.struct(x.alias("word"), _core(x).alias("core"))), lambda c: c["core"] != "")
    # most texts hold no digit and no capital inside a sentence: nothing to replace there
    may_hold = F.coalesce(text, F.lit("")).rlike("[0-9]|" + _MID_NAME)
    return F.when(may_hold, let(worded, typed)).otherwise(plain)


def window_rows(frame: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """(key, size, pos, hash, slots) of the windows; slots holds a window's replaced values, null if it has none
    or is joined by its real values."""
    def of(c: Column) -> Column:
        hashes = F.transform(c, lambda x: F.xxhash64(x["w"]))
        some = F.exists(c, lambda x: x["v"].isNotNull())
        values = F.when(some, F.transform(c, lambda x: x["v"]))
        real = F.when(some, F.transform(c, lambda x: F.xxhash64(F.coalesce(x["v"], x["w"]), F.lit("real"))))
        return F.array(F.struct(hashes.alias("h"), values.alias("v"), real.alias("r")))

    def windows(hv: Column, k: int) -> Column:
        least = -(-k * MIN_LITERALS // WINDOW)

        def one(i: Column) -> Column:
            # null where the text holds no slot at all
            slots = F.slice(hv["v"], i, k)
            held = F.coalesce(F.size(F.filter(slots, lambda v: v.isNotNull())), F.lit(0))
            poor = held > k - least
            return F.struct(F.lit(k).alias("size"), (i - 1).alias("pos"),
                            F.xxhash64(F.when(poor, F.slice(hv["r"], i, k)).otherwise(F.slice(hv["h"], i, k))).alias("hash"),
                            F.when((held > 0) & ~poor, slots).alias("slots"))
        n = F.size(hv["h"])
        made = F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), one))
        return made.otherwise(F.array().cast(_WINDOWS))

    every = let(canonical(frame["text"]),
                lambda c: F.transform(of(c), lambda hv: F.concat(*[windows(hv, k) for k in sizes]))[0])
    return frame.where(F.col(key).isNotNull()).select(key, F.explode(every).alias("_w")).select(key, "_w.*")


_WINDOWS = "array<struct<size:int,pos:int,hash:bigint,slots:array<string>>>"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, n_changed): the items that a
    document holds, and how many of their slots have another value in it."""
    prepare(docs.sparkSession)
    items = benchmark.where("item_id IS NOT NULL").select("item_id", "text")
    size = F.least(F.size(canonical(F.col("text"))), F.lit(WINDOW))
    sizes = sorted(r[0] for r in items.select(size.alias("s")).distinct().collect() if r[0] > 0)  # at most WINDOW values
    if not sizes:
        sizes = [WINDOW]
    sized = items.withColumn("_size", size)
    theirs = save(window_rows(sized, "item_id", sizes)
                  .join(sized.select("item_id", F.col("_size").alias("size")).distinct(), ["item_id", "size"])
                  .select("item_id", F.col("pos").alias("ipos"), "hash", F.col("slots").alias("islots")), "items")
    keys = theirs.select("hash").distinct()
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    hits = window_rows(docs.select("doc_id", "text"), "doc_id", sizes).join(keys, "hash", "left_semi")
    pairs = hits.join(theirs, "hash").withColumn("shift", F.col("pos") - F.col("ipos"))
    per = ["doc_id", "item_id", "shift"]
    slots = (pairs.where("islots IS NOT NULL")
             .select(*per, F.explode(F.filter(F.arrays_zip("islots", "slots"), lambda z: z["islots"].isNotNull())).alias("z"))
             .select(*per, F.col("z.islots").alias("mine"), F.col("z.slots").alias("theirs")).distinct())
    bad = (slots.groupBy(*per, "mine").agg(F.count("*").alias("n"), F.max((F.col("mine") != F.col("theirs")).cast("int")).alias("c"))
           .groupBy(*per).agg(F.max("n").alias("_meanings"), F.sum("c").alias("_changed")))
    same = F.col("islots").eqNullSafe(F.col("slots"))
    held = (pairs.select(*per, "ipos", same.alias("_same")).distinct().join(bad, per, "left")
            .where(F.col("_same") | (F.coalesce("_meanings", F.lit(1)) == 1))
            .groupBy("doc_id", "item_id").agg(F.count_distinct("ipos").alias("n_windows"),
                                              F.max(F.coalesce("_changed", F.lit(0))).cast("long").alias("n_changed")))
    whole = theirs.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    need = F.least(F.lit(LEAK_WINDOWS), F.ceil(F.col("item_windows") / 2))
    return (held.join(whole, "item_id").where(F.col("n_windows") >= need)
            .select("doc_id", "item_id", "n_windows", "item_windows", "n_changed"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    found = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, also with other numbers, names or units."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return leaks(documents(spark, sf_dir), benchmark)


_P = r"[!-/:-@\[-`{-~]"
_UNIT = ", ".join(f"'{u}'" for u in UNITS)


def _canon_sql(table: str, key: str) -> str:
    return rf"""
  SELECT {key} AS id, i, w AS raw, core, lag(w) OVER p AS before, lag(core) OVER p AS core_before
  FROM (SELECT {key}, w, core, row_number() OVER (PARTITION BY {key} ORDER BY n) - 1 AS i
        FROM (SELECT {key}, n, w, regexp_replace(w, '^{_P}+|{_P}+$', '', 'g') AS core
              FROM (SELECT {key}, unnest(ws) AS w, unnest(range(len(ws))) AS n
                    FROM (SELECT {key}, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                                    lambda x: x <> '') AS ws FROM {table})))
        WHERE core <> '')
  WINDOW p AS (PARTITION BY {key} ORDER BY i)"""


OP1_SQL = rf"""
WITH c AS (SELECT 'd' AS side, * FROM ({_canon_sql('documents', 'doc_id')})
           UNION ALL SELECT 'b', * FROM ({_canon_sql('benchmark', 'item_id')})),
k AS (SELECT *, CASE WHEN regexp_matches(core, '{_NUMBER}') THEN '<num>'
                     WHEN lower(core) IN ({_UNIT}) AND coalesce(regexp_matches(core_before, '{_NUMBER}'), false) THEN '<unit>'
                     WHEN regexp_matches(core, '^\p{{Lu}}[\p{{Ll}}''-]+$') AND coalesce(NOT regexp_matches(before, '{_ENDS}'), false)
                     THEN '<name>' END AS kind FROM c),
a AS (SELECT side, id, list(coalesce(kind, lower(core)) ORDER BY i) AS ws,
             list(CASE WHEN kind IS NOT NULL THEN lower(core) END ORDER BY i) AS vs FROM k GROUP BY side, id),
sizes AS (SELECT DISTINCT least(len(ws), {WINDOW}) AS size FROM a WHERE side = 'b'),
win AS (SELECT side, id, size, pos, ws[pos + 1:pos + size] AS win, vs[pos + 1:pos + size] AS vals
        FROM (SELECT *, unnest(range(0, len(ws) - size + 1)) AS pos FROM a, sizes
              WHERE len(ws) >= size AND (side = 'd' OR size = least(len(ws), {WINDOW})))),
ok AS (SELECT side, id, size, pos, CASE WHEN poor THEN list_concat(['<real>'], list_transform(range(1, size + 1), lambda j: coalesce(vals[j], win[j]))) ELSE win END AS win,
              CASE WHEN NOT poor THEN vals END AS vals
       FROM (SELECT *, len(list_filter(vals, lambda v: v IS NOT NULL)) > 0
                       AND (size - len(list_filter(vals, lambda v: v IS NOT NULL))) * {WINDOW} < size * {MIN_LITERALS} AS poor FROM win)),
theirs AS (SELECT * FROM ok WHERE side = 'b'),
pairs AS (SELECT d.id AS doc_id, b.id AS item_id, d.pos - b.pos AS shift, b.pos AS ipos, b.vals AS ivals, d.vals AS dvals
          FROM ok d JOIN theirs b ON d.side = 'd' AND d.win = b.win),
slots AS (SELECT DISTINCT doc_id, item_id, shift, mine, his
          FROM (SELECT doc_id, item_id, shift, unnest(ivals) AS mine, unnest(dvals) AS his FROM pairs) WHERE mine IS NOT NULL),
bad AS (SELECT doc_id, item_id, shift, max(n) AS meanings, sum(c) AS changed
        FROM (SELECT doc_id, item_id, shift, mine, count(*) AS n, max((mine <> his)::INT) AS c FROM slots GROUP BY ALL)
        GROUP BY ALL),
held AS (SELECT doc_id, item_id, count(DISTINCT ipos) AS n_windows, max(coalesce(changed, 0)) AS n_changed
         FROM pairs LEFT JOIN bad USING (doc_id, item_id, shift) WHERE coalesce(meanings, 1) = 1 OR ivals IS NOT DISTINCT FROM dvals GROUP BY ALL),
whole AS (SELECT id AS item_id, count(*) AS item_windows FROM theirs GROUP BY ALL)
SELECT doc_id, item_id, n_windows::BIGINT AS n_windows, item_windows::BIGINT AS item_windows, n_changed::BIGINT AS n_changed
FROM held JOIN whole USING (item_id) WHERE n_windows >= least({LEAK_WINDOWS}, ceil(item_windows / 2))
"""
