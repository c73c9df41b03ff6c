"""Key normalisation and composite keys as Column expressions (STR-1..5, STR-9)."""

from __future__ import annotations

from typing import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark.config import Normalization

# The characters Python's str.strip()/str.split()/re "\s" treat as
# whitespace (str.isspace), as one explicit class - faster than Java's
# Unicode-mode (?U)\s, and it also covers U+001C..U+001F which (?U)\s lacks.
_WS = "[\\t\\n\\x{0b}\\f\\r\\x{1c}-\\x{1f} \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_EDGE_WS = "^" + _WS + "+|" + _WS + "+$"
_RUN_WS = _WS + "+"

# Separators of the two composite-key tools.
PIPE = "|"
VDOTS = "\u22ee"   # vertical ellipsis


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Unicode-aware strip (``trim()`` only removes ASCII spaces)."""
    return F.regexp_replace(_as_col(c), _EDGE_WS, "")


def collapse_ws(c) -> Column:
    return F.regexp_replace(_as_col(c), _RUN_WS, " ")


_casefold_udf = None


def casefold(c) -> Column:
    """Exact Unicode casefold (e.g. 'ß' -> 'ss'), which Spark's lower() does not do.
    The only Python on this path: an Arrow-batched pandas UDF, opt-in via
    Normalization(case="casefold")."""
    global _casefold_udf
    if _casefold_udf is None:
        @F.pandas_udf("string")
        def _fold(s: pd.Series) -> pd.Series:
            return s.str.casefold()
        _casefold_udf = _fold
    return _casefold_udf(_as_col(c))


def normalize_piece(c, norm: Normalization) -> Column:
    """STR-1: null -> token; strip; collapse whitespace runs; case; widen digit-only text."""
    s = F.coalesce(_as_col(c).cast("string"), F.lit(norm.null_token))
    if norm.trim and norm.collapse_spaces:
        # collapsing first leaves at most one plain blank at each edge
        s = F.trim(collapse_ws(s))
    elif norm.trim:
        s = strip_ws(s)
    elif norm.collapse_spaces:
        s = collapse_ws(s)
    if norm.case == "lower":
        s = F.lower(s)
    elif norm.case == "upper":
        s = F.upper(s)
    elif norm.case == "casefold":
        s = casefold(s)
    if norm.zero_pad and norm.zero_pad > 0:
        w = int(norm.zero_pad)
        # lpad truncates longer input, so only widen.
        s = F.when(s.rlike(r"^\p{Nd}+$") & (F.length(s) < w), F.lpad(s, w, "0")).otherwise(s)
    return s


def with_composite_key(df: DataFrame, cols: Iterable[str], norm: Normalization, sep: str = PIPE,
                       ignore_missing: bool = True, out: str = "key") -> DataFrame:
    """``composite_key`` as a column, computed in two projections: the normalised
    pieces first, then padding + join. The padding test reads each piece three
    times; Catalyst keeps the (regex) pieces in their own projection instead of
    repeating them."""
    cols = [c for c in cols if c]
    present = set(df.columns)
    base = Normalization(case=norm.case, trim=norm.trim, collapse_spaces=norm.collapse_spaces,
                         zero_pad=0, null_token=norm.null_token)
    pieces = []
    for i, c in enumerate(cols):
        if c in present:
            pieces.append(normalize_piece(F.col(c), base).alias(f"_k{i}"))
        elif not ignore_missing:
            pieces.append(normalize_piece(F.lit(None).cast("string"), base).alias(f"_k{i}"))
    if not pieces:
        return df.withColumn(out, F.lit(""))
    names = [f"_k{i}" for i, c in enumerate(cols) if c in present or not ignore_missing]
    d = df.select("*", *pieces)
    w = int(norm.zero_pad or 0)
    parts = []
    for n in names:
        p = F.col(n)
        if w > 0:
            p = F.when(p.rlike(r"^\p{Nd}+$") & (F.length(p) < w), F.lpad(p, w, "0")).otherwise(p)
        parts.append(p)
    return d.withColumn(out, F.concat_ws(sep, *parts)).drop(*names)


def composite_key(df: DataFrame, cols: Iterable[str], norm: Normalization, sep: str = PIPE,
                  ignore_missing: bool = True) -> Column:
    """STR-2/3: normalised pieces joined by ``sep``.

    ignore_missing=True drops columns the frame lacks (pipe tool); False turns
    them into blank pieces (change-feed tool). No usable column -> "".
    """
    cols = [c for c in cols if c]
    present = set(df.columns)
    pieces = []
    for c in cols:
        if c in present:
            pieces.append(normalize_piece(F.col(c), norm))
        elif not ignore_missing:
            pieces.append(normalize_piece(F.lit(None).cast("string"), norm))
    if not pieces:
        return F.lit("")
    return F.concat_ws(sep, *pieces)


def template_key(*cols) -> Column:
    """STR-4: SKU + Store + Bin, trimmed, joined with '|'."""
    return F.concat_ws(PIPE, *[strip_ws(F.coalesce(_as_col(c).cast("string"), F.lit(""))) for c in cols])


def split_sku(c) -> Column:
    """STR-5: text before the first pipe, stripped."""
    return strip_ws(F.substring_index(_as_col(c), PIPE, 1))


def upper_strip(c, upper: bool = True, strip: bool = True, null_token: str | None = "nan") -> Column:
    """STR-9: the dashboard's key normaliser (``astype(str)`` turns null into "nan")."""
    s = _as_col(c).cast("string")
    if null_token is not None:
        s = F.coalesce(s, F.lit(null_token))
    if strip:
        s = strip_ws(s)
    if upper:
        s = F.upper(s)
    return s
