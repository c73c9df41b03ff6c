"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a predicate that rejects a document. ``estimate`` measures on a
bounded sample (``SAMPLE_ROWS``, drawn from all rows) what share of documents a
rule rejects and what its evaluation costs; ``cascade`` tries the rules in the
order of rejections per cost and stops at the first that rejects. The order
changes the cost, never the verdict.

A null text has no words; texts are judged whole. A document without words or
with a null in any other column is judged like any other (too short). Repeated
rows get equal verdicts, an empty table an empty result. All columns of the
input pass through ``cascade``; its own are ``kept`` and ``rejected_by`` and
replace columns of these names.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm.common import documents, let, prepare, save, words_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SAMPLE_ROWS = 2000
RUNS = 3
MIN_WORDS = 50

# Frequent words of the languages in the corpus.
STOP_WORDS = ("the be to of and that have with is in it was "
              "der die das und ist ein eine nicht von zu mit den "
              "le la les de des et est un une que pour dans "
              "el los las del y en es por con una para se").split()


# ----------------------------------------------------------------- measures

def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes inside one text. Equal ones become
    neighbours by sorting (hash, position); the positions found, in order,
    then cover min(3, distance to the one before) words each.
    """
    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), p - F.get(at, j - 1))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, b: a + b)

    def of_sorted(s: Column) -> Column:
        twin = F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False))
                        | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
        return let(F.sort_array(F.transform(twin, lambda e: e["i"])), covered)

    def of_hashes(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(pairs, of_sorted))

    def of_words(ws: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 3),
                              lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
        return F.when(F.size(ws) < 3, F.lit(0).cast("long")).otherwise(let(windows, of_hashes))

    return let(words, of_words)


def with_parts(docs: DataFrame) -> DataFrame:
    """``docs`` plus the measures and what they are taken from: ``_words`` and ``_lines`` (arrays)."""
    text = text_of(docs["text"])
    return (docs
            .withColumn("_words", words_of(docs["text"]))
            .withColumn("_lines", lines_with_words(text))
            .withColumn("n_words", F.size("_words").cast("long"))
            .withColumn("word_chars", F.length(F.translate(text, SPACES, "")).cast("long"))
            .withColumn("n_symbols", count_chars(text, SYMBOLS))
            .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
            .withColumn("n_repeat_words", repeat_words(F.col("_words"))))


def with_measures(docs: DataFrame) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    return with_parts(docs).drop("_words", "_lines")


# ----------------------------------------------------------------- rules

@dataclass(frozen=True)
class Rule:
    """``rejects(text, words)``: a boolean column; ``text`` is never null."""
    name: str
    rejects: Callable[[Column, Column], Column]


def _share_over(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 > whole * percent


def _letters(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _letterless(text: Column, words: Column) -> Column:
    """Over 20 % of the words have no letter. Every such word holds a character that is
    no letter, so the words are looked at only where there are enough of these."""
    others = F.length(F.translate(text, SPACES, "")) - _letters(text, r"\p{L}+")
    return _share_over(others, F.size(words), 20) & _share_over(
        F.size(F.filter(words, lambda x: ~x.rlike(r"\p{L}"))), F.size(words), 20)


def _stop_words(words: Column) -> Column:
    """Distinct stop words among ``words``."""
    return F.size(F.array_intersect(F.transform(words, lambda x: F.lower(F.rtrim(x, F.lit(".,;:")))),
                                    F.array(*map(F.lit, STOP_WORDS))))


def _few_stop_words(words: Column) -> Column:
    """Under two stop words; two among the first hundred words settle it, else all words are read."""
    return (_stop_words(F.slice(words, 1, 100)) < 2) & (_stop_words(words) < 2)


RULES = [
    Rule("word_length", lambda t, w: (F.length(F.translate(t, SPACES, "")) < F.size(w) * 2)
         | (F.length(F.translate(t, SPACES, "")) > F.size(w) * 14)),
    Rule("symbols", lambda t, w: _share_over(count_chars(t, SYMBOLS), F.size(w), 10)),
    Rule("exclamations", lambda t, w: _share_over(count_chars(t, "!?"), F.size(w), 30)),
    Rule("upper_case", lambda t, w: _share_over(_letters(t, r"\p{Lu}+"), _letters(t, r"\p{L}+"), 40)),
    # a line that comes back once or twice is no pattern
    Rule("dup_lines", lambda t, w: let(lines_with_words(t), lambda ls: _share_over(
        F.size(ls) - F.size(F.array_distinct(ls)), F.size(ls), 30) & (F.size(ls) - F.size(F.array_distinct(ls)) > 2))),
    Rule("letterless_words", _letterless),
    Rule("stop_words", lambda t, w: _few_stop_words(w)),
    Rule("few_different_words", lambda t, w: F.size(F.array_distinct(w)) * 100 < F.least(F.size(w), F.lit(1000)) * 10),
    Rule("repeated_windows", lambda t, w: _share_over(repeat_words(w), F.size(w), 50)),
    Rule("too_short", lambda t, w: F.size(w) < MIN_WORDS),
]


#: The rules on measures that ``with_parts`` has made already.
MEASURED = {
    "word_length": lambda t, w: (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 14),
    "symbols": lambda t, w: _share_over(F.col("n_symbols"), F.col("n_words"), 10),
    "dup_lines": lambda t, w: _share_over(F.col("n_dup_lines"), F.size("_lines"), 30) & (F.col("n_dup_lines") > 2),
}


def chain(text: Column, words: Column, rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated.
    ``words`` is named once or more by every rule: a column that is already made."""
    out = F.when(F.coalesce(rules[0].rejects(text_of(text), words), F.lit(False)), rules[0].name)
    for r in rules[1:]:
        out = out.when(F.coalesce(r.rejects(text_of(text), words), F.lit(False)), r.name)
    return out


def first_rejecting(text: Column, words: Column, rules: list[Rule]) -> Column:
    """``chain`` with ``words`` made once."""
    return let(words, lambda w: chain(text, w, rules))


def with_words(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a new column of the words, named apart from all others. It comes from a
    one-row explode: no filter or projection above it is rewritten to split the text again."""
    name = "_words"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.select("*", F.explode(F.array(words_of(docs["text"]))).alias(name)), name


def estimate(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(name, rejected share, seconds) of each rule over a sample of about ``sample_rows``
    documents, drawn at random from all of them.

    The sample is one task, so the time is that of the rule and not of scheduling; the least
    of ``RUNS`` runs counts, less that of a rule that does nothing. Words, and measures for
    the rules that take them, are in the sample beforehand."""
    rows = docs.count()
    part = docs.select("text")
    if rows > sample_rows:
        part = part.sample(sample_rows / rows, seed=11)
    sample = save(with_parts(part), "quality-sample").coalesce(1)

    def run(rejects: Callable[[Column, Column], Column]) -> tuple[float, float]:
        verdict = rejects(text_of(F.col("text")), F.col("_words"))
        frame = sample.agg(F.avg(F.coalesce(verdict, F.lit(False)).cast("int")).alias("share"))
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            share = frame.first()["share"]
            times.append(time.perf_counter() - began)
        return share or 0.0, min(times)

    # the words and the text are read here too
    floor = run(lambda t, w: (F.size(w) < 0) | (F.octet_length(t) < 0))[1]
    out = []
    for r in rules:
        share, seconds = run(r.rejects)
        out.append((r.name, share, max(seconds - floor, 1e-3)))
    return out


def ordered(rules: list[Rule], estimates: list[tuple[str, float, float]]) -> list[Rule]:
    """Rules by rejections per second, best first; ties keep their order."""
    gain = {name: share / seconds for name, share, seconds in estimates}
    return sorted(rules, key=lambda r: -gain[r.name])


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``kept`` and ``rejected_by`` (the first rejecting rule in
    the order chosen from the sample)."""
    prepare(docs.sparkSession)
    rules = RULES if rules is None else rules
    rules = ordered(rules, estimate(docs, rules, sample_rows))
    split, words = with_words(docs)
    by = chain(F.col("text"), F.col(words), rules)
    return split.withColumn("rejected_by", by).withColumn("kept", F.col("rejected_by").isNull()).drop(words)


def clean(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns only, whatever they are called."""
    prepare(docs.sparkSession)
    rules = RULES if rules is None else rules
    rules = ordered(rules, estimate(docs, rules, sample_rows))
    split, words = with_words(docs)
    return split.where(chain(F.col("text"), F.col(words), rules).isNull()).drop(words)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document and the cascade's verdict on those that pass the base rules."""
    prepare(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    done = {"repeated_windows", "too_short"}  # the base rules have judged these
    rules = [replace(r, rejects=MEASURED.get(r.name, r.rejects)) for r in RULES if r.name not in done]
    rules = ordered(rules, estimate(docs, rules))
    full = with_parts(docs).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    verdict = F.when(F.col("base_failed"), False).otherwise(chain(F.col("text"), F.col("_words"), rules).isNull())
    return full.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", verdict.alias("kept"))


# kept is the base verdict and then each rule, in any order
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_SPACE = r"[\x20\x09-\x0D]"
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda x: length(regexp_replace(x, '{_SPACE}', '', 'g')) > 0) AS ls
           FROM documents),
v AS (SELECT *, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS win
      FROM d),
x AS (SELECT doc_id, unnest(win) AS g, unnest(range(1, len(win) + 1)) AS i FROM v),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(3, coalesce(i - before, 3))) AS n
        FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) GROUP BY doc_id),
m AS (SELECT v.doc_id, t, w, ls, len(w) AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM v LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 100 * n_symbols > 10 * n_words
            OR 100 * (length(t) - length(regexp_replace(t, '[!?]', '', 'g'))) > 30 * n_words
            OR 100 * (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))
               > 40 * (length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')))
            OR (100 * n_dup_lines > 30 * len(ls) AND n_dup_lines > 2)
            OR 100 * len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) > 20 * n_words
            OR len(list_filter([{_STOP}],
                               lambda s: list_contains(list_transform(w, lambda x: lower(rtrim(x, '.,;:'))), s))) < 2
            OR 100 * len(list_distinct(w)) < 10 * least(n_words, 1000)) AS kept
FROM b
"""
