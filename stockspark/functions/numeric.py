"""Quantity parsing and whole-number rules as Column expressions (NUM-1..8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a lenient text-to-number parser accepts: optional sign, decimal or
# exponent notation, inf/infinity/nan, surrounding whitespace. Spark's own
# cast additionally accepts "5d"/"5f" suffixes, which must stay invalid.
_NUM_RE = (r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$")
# Python's int() and float() also accept digit groups separated by single underscores.
# Possessive: java.util.regex would recurse once per digit and overflow on long cells.
_DIGITS = r"\d++(?:_\d++)*+"
_PYFLOAT_RE = (rf"(?i)^\s*[+-]?(({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})(e[+-]?{_DIGITS})?"
               r"|inf|infinity|nan)\s*$")


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_number(c) -> Column:
    """NUM-2: lenient parse to double, null when the text is not a number."""
    col = _as_col(c)
    s = col.cast("string")
    return F.when(s.rlike(_NUM_RE), F.trim(s).try_cast("double"))


def coerce_numeric(c) -> Column:
    """NUM-1: parse, unparsable/null/NaN -> 0.0."""
    v = parse_number(c)
    return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


def to_int_safe(c) -> Column:
    """NUM-3: float parse, truncate toward zero; any failure (incl. inf/nan) -> 0."""
    s = _as_col(c).cast("string")
    v = F.when(s.rlike(_PYFLOAT_RE), F.regexp_replace(F.trim(s), "_", "").try_cast("double"))
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.when(finite, v.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def whole_number(c, rule: str = "round", clamp_negative: bool = False) -> Column:
    """NUM-5: unparsable -> 0, then floor / ceil / round-half-even, optional clamp >= 0."""
    v = coerce_numeric(c)
    rule = (rule or "round").lower()
    if rule == "floor":
        w = F.floor(v)
    elif rule == "ceil":
        w = F.ceil(v)
    else:
        w = F.bround(v, 0)
    w = F.coalesce(w.try_cast("bigint"), F.lit(0).cast("bigint"))  # beyond 64 bits is no quantity
    return F.greatest(w, F.lit(0).cast("bigint")) if clamp_negative else w


def stock_status_flag(c) -> Column:
    """NUM-7: 1 when quantity > 0 else 0."""
    return (_as_col(c) > 0).cast("int")


def sign_class(diff) -> Column:
    """NUM-8: pos / neg / zero tag of a difference."""
    d = _as_col(diff)
    return F.when(d == 0, "zero").when(d > 0, "pos").otherwise("neg")


def money(c) -> Column:
    """SRT-3 helper: text money ($1,234.50) to double."""
    return parse_number(F.regexp_replace(_as_col(c).cast("string"), r"[$,]", ""))


_PYINT_RE = rf"^\s*[+-]?{_DIGITS}\s*$"


def py_int(c) -> Column:
    """Text accepted by Python's int(): optional sign, digits with single
    underscores, surrounding whitespace. Blank/null -> 0 (the tools use
    ``int(x or 0)``); anything else -> null (invalid)."""
    s = _as_col(c).cast("string")
    blank = s.isNull() | (s == "")
    val = F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), "_", "").try_cast("bigint")
    return F.when(blank, F.lit(0).cast("bigint")).when(s.rlike(_PYINT_RE), val)


def py_float(c) -> Column:
    """Text accepted by Python's float() (incl. inf/nan/underscores); blank/null -> 0.0;
    invalid -> null."""
    s = _as_col(c).cast("string")
    blank = s.isNull() | (s == "")
    val = F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), "_", "").try_cast("double")
    return F.when(blank, F.lit(0.0)).when(s.rlike(_PYFLOAT_RE), val)
