"""Personal data in disguise, found with spans in the original text.

Two searches run over each text. The base search finds plain identifiers. The
second reads the text through a chain of transducers, each of which rewrites
some places and carries for every output character the source span it stands
for:

1. look-alike letters, full-width and styled characters become ASCII, invisible
   characters vanish;
2. spelled digits ("four", "vier", "double five", "oh" among digits) become digits
   and "plus" or "más" before them "+";
3. "(at)", "[dot]", " @ ", and "name at host dot com" become "@" and ".".

The same detectors run over the result, and their spans map back to source
characters. An identifier of the second search counts only if its text was
rewritten somewhere; base spans always stay.

Spans are code points, end exclusive. A null text is empty; a null doc_id stays
null; repeated rows are searched each on its own; an empty table gives an empty
result. Columns other than doc_id and text pass through ``redact`` untouched and
are ignored otherwise. Texts of any length are searched whole: every pattern
takes time linear in the text, whatever runs of letters or digits it holds.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm.common import documents, prepare

KINDS = ["email", "ip", "card", "phone"]

# ----------------------------------------------------------------- detectors
# Leftmost non-overlapping matches of the contract's patterns. A look-behind or a possessive
# quantifier only rules out starts that cannot match, so that long runs are read once.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            free = host.end()
        else:
            free = max(free, at + 1)  # "@" itself is no local character
        at = text.find("@", max(at + 1, free))


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), by start, then kind as listed."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(a, 1, b) for a, b in _ips(text)]
        found += [(a, 2, b) for a, b in _cards(text)]
        if "+" in text:
            found += [(a, 3, b) for a, b in _phones(text)]
    return sorted(found)


# ----------------------------------------------------------------- transducers

# Letters of other scripts that look like ASCII letters, and invisible characters.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁӏԛԝһҽАВЕКМНОРСТУХІЈЅԌ" "αονρυικχτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                       "aeopcyxijsdlqwheABEKMHOPCTYXIJSG" "aovpuikxtABEZHIKMNOPTYX"))
INVISIBLE = "­​‌‍⁠﻿"
# The words for 0 to 9, by language of the corpus.
DIGITS_OF = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei|zwo drei vier fünf|fuenf sechs sieben acht neun",
    "fr": "zéro un|une deux trois quatre cinq six sept huit neuf",
    "es": "cero uno|un|una dos tres cuatro cinco seis siete ocho nueve",
}
DIGIT_WORDS = {form: str(d) for spoken in DIGITS_OF.values() for d, words in enumerate(spoken.split()) for word in words.split("|")
               for form in (word, unicodedata.normalize("NFD", word))}
ARTICLES = ("un", "une", "una")  # digits only after a digit word, or before one or a digit


def _styled() -> dict[str, str]:
    """By rule: every character whose compatibility form, or whose decimal value, is one ASCII character."""
    out = {}
    for cp in [*range(0x00A0, 0x3400), *range(0xFE00, 0x10000), *range(0x10000, 0x20000)]:
        ch = chr(cp)
        plain = unicodedata.normalize("NFKC", ch)
        digit = unicodedata.decimal(ch, None)
        if digit is not None:
            out[ch] = str(digit)
        elif len(plain) == 1 and plain.isascii() and plain.isprintable() and not plain.isspace():
            out[ch] = plain
    return out


CHARACTERS = {**_styled(), **LOOK_ALIKES, "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
              **{c: "" for c in INVISIBLE}}
_ODD = frozenset(CHARACTERS)
_CHARACTER = re.compile("[" + "".join(map(re.escape, CHARACTERS)) + "]")

_NUMBER = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_LETTER = "A-Za-zÀ-ÖØ-öø-\u024f\u0300-\u036f"  # of the languages' words
_SPELLED = re.compile(rf"(?i)(?<![{_LETTER}])(?:(?P<plus>plus|m(?:a\u0301?|á)s)(?=[\x20-]*(?:[0-9]|(?:{_NUMBER})(?![{_LETTER}])))"
                      rf"|(?P<many>double|triple)[\x20-]+(?P<what>{_NUMBER}|[0-9])(?![{_LETTER}0-9])"
                      rf"|(?P<digit>{_NUMBER})(?![{_LETTER}])"
                      rf"|(?<=[0-9eorxnt][\x20-])(?P<oh>oh|o)(?=[\x20-](?:[0-9]|oh|o|{_NUMBER})(?![{_LETTER}])))")
_DIGIT_BEFORE = re.compile(rf"(?i)(?<![{_LETTER}])(?:{_NUMBER})[\x20-]\Z")
_DIGIT_AFTER = re.compile(rf"(?i)[\x20-](?:[0-9]|(?:{_NUMBER})(?![{_LETTER}]))")
_SPACED_PLUS = re.compile(r"\+\x20+(?=[0-9])")
_OPEN, _CLOSE = r"[(\[{<]\s?", r"\s?[)\]}>]"
_AT = re.compile(rf"(?i)\s?{_OPEN}(?:at|@){_CLOSE}\s?")
_DOT = re.compile(rf"(?i)\s?{_OPEN}(?:dot|punkt|punto|point|\.){_CLOSE}\s?")
# "-at-" and "-dot-" always part labels, so that a run of them is read once
_LABEL = r"(?:[A-Za-z0-9]|-(?!(?:at|dot)[_-]))++"
# Last labels that make an "at" before plain dots an address and not prose.
_TOP = ("com|org|net|edu|gov|mil|int|info|biz|io|dev|app|co|uk|de|fr|es|eu|ca|au|ch|nl|jp|br|ru|cn|pl|se|mx|ar"
        "|example|test|invalid|localhost")
# After a dot said aloud every last label of three letters or more counts, and of those of two
# letters, which are all country codes, the ones in use.
_COUNTRY = "|".join("a[cdefgilmoqrstuwxz] b[abdefghijmnorstvwyz] c[acdfghiklmnoruvwxyz] d[ejkmoz] e[ceghrstu] f[ijkmor] "
                    "g[abdefghilmnpqrstuwy] h[kmnrtu] i[delmnoqrst] j[emop] k[eghimnprwyz] l[abcikrstuvy] "
                    "m[acdeghklmnopqrstuvwxyz] n[acefgilopruz] om p[aefghklmnrstwy] qa r[eosuw] s[abcdeghijklmnorstuvxyz] "
                    "t[cdfghjklmnortvwz] u[agksyz] v[aceginu] w[fs] y[et] z[amw]".split())
_SPOKEN_TOP = rf"(?:{_COUNTRY}|(?!(?:dot|punkt|punto|point)(?![A-Za-z0-9]))[A-Za-z]{{3,}})"
_SAID_ALOUD = r"(?:\x20dot\x20|[_-]dot[_-])"
_SPOKEN_DOT = r"(?:\x20dot\x20|[_-]dot[_-]|\x20\.\x20|\.)"
_SAID = re.compile(rf"(?i)(?<=[A-Za-z0-9_%+-])(?:"
                   rf"(?:\x20(?:at|@)\x20|[_-]at[_-]|\x20@|@\x20)"
                   rf"(?={_LABEL}(?:{_SPOKEN_DOT}{_LABEL}){{0,8}}?{_SPOKEN_DOT}(?:{_TOP})(?![A-Za-z0-9]))"
                   rf"|(?:\x20at\x20|[_-]at[_-])"
                   rf"(?={_LABEL}(?:{_SPOKEN_DOT}{_LABEL}){{0,8}}?{_SAID_ALOUD}{_SPOKEN_TOP}(?![A-Za-z0-9])))")
_SAID_DOT = re.compile(rf"(?i)(?<=[A-Za-z0-9-])(?:\x20dot\x20|[_-]dot[_-]|\x20\.\x20)(?={_LABEL})")


class Traced:
    """A text with, for every character, the source span it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text))
        self.ends = self.starts + 1

    def rewrite(self, pattern, replace) -> None:
        """Replace every match by ``replace(match)`` (None leaves it); each new
        character stands for the whole match."""
        text, starts, ends, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = replace(m)
            if new is None or m.end() == m.start():
                continue
            a, b = m.span()
            text += [self.text[last:a], new]
            starts += [self.starts[last:a], np.full(len(new), self.starts[a])]
            ends += [self.ends[last:a], np.full(len(new), self.ends[b - 1])]
            last = b
        if text:
            self.text = "".join(text) + self.text[last:]
            self.starts = np.concatenate([*starts, self.starts[last:]])
            self.ends = np.concatenate([*ends, self.ends[last:]])


def _digit(word: str) -> str:
    # the letters that (?i) takes for "i" and "s"
    word = word.lower().replace("\u017f", "s").replace("\u0131", "i").replace("\u0307", "")
    return DIGIT_WORDS.get(word, word)


def _spell(m) -> str | None:
    if m["plus"]:
        return "+"
    if m["oh"]:
        return "0"
    if m["digit"]:
        alone = m["digit"].lower() in ARTICLES and not (
            _DIGIT_AFTER.match(m.string, m.end()) or _DIGIT_BEFORE.search(m.string[max(0, m.start() - 10):m.start()]))
        return None if alone else _digit(m["digit"])
    return _digit(m["what"]) * (2 if m["many"].lower() == "double" else 3)


def _say_dots(traced: Traced) -> None:
    """Dots said aloud count only after an address's "@" or between numbers; they
    are read from left to right, each seeing what the ones before it became."""
    text, tail, last = traced.text, "", 0

    def dot(m):
        nonlocal tail, last
        tail = (tail + text[last:m.start()])[-256:].rpartition(" ")[2]
        last = m.end()
        new = "." if "@" in tail or re.fullmatch(r"[0-9.]*[0-9]", tail) else None
        tail += new or m[0]
        return new

    traced.rewrite(_SAID_DOT, dot)


def normalise(text: str) -> Traced | None:
    """The text read through all transducers; None if none of them rewrites a place."""
    traced = Traced(text)
    if not text.isascii() and not _ODD.isdisjoint(text):
        traced.rewrite(_CHARACTER, lambda m: CHARACTERS[m[0]])
    traced.rewrite(_SPELLED, _spell)
    traced.rewrite(_SPACED_PLUS, lambda m: "+")
    traced.rewrite(_AT, lambda m: "@")
    traced.rewrite(_DOT, lambda m: ".")
    traced.rewrite(_SAID, lambda m: "@")
    _say_dots(traced)
    return None if traced.text is text else traced


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, as (start, kind number, end)."""
    base = detect(text)
    traced = normalise(text)
    if traced is None:
        return base, base
    more = set()
    for a, kind, b in detect(traced.text):
        start, end = int(traced.starts[a]), int(traced.ends[b - 1])
        if text[start:end] != traced.text[a:b]:
            more.add((start, kind, end))
    return base, sorted(more.union(base))


def span_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ----------------------------------------------------------------- Spark jobs

def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans by kind, base and all spans as text."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            found = [find(t or "") for t in b.column("text").to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array([span_text(x) for x, _ in found], pa.string()),
                 pa.array([span_text(x) for _, x in found], pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_spans", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string")


def redact_text(text: str) -> str:
    """The text with every found span (overlapping ones as one) replaced by its kind in brackets."""
    out, last = [], 0
    for a, k, b in find(text)[1]:
        if a >= last:
            out += [text[last:a], f"<{KINDS[k].upper()}>"]
        last = max(last, b)
    return "".join(out) + text[last:] if out else text


def redact(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the personal data in ``text`` replaced; a null text stays null."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact_text(t))

    return docs.withColumn("text", clean(docs["text"]))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, plain and in disguise, with source spans."""
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS],
                        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")
