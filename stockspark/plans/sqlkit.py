"""Small helpers that spell the oracle SQL (DuckDB dialect) for the registered queries.

The oracle is independent of the Spark code path: plain SQL text over the
driver's parquet views, used only to check results.
"""

from __future__ import annotations

LI_ORDER_DESC = ", ".join(f"{c} DESC" for c in [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])
LI_ORDER_ASC = LI_ORDER_DESC.replace(" DESC", " ASC")
LI_COLS = ("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, "
           "l_quantity, l_discount, l_tax, l_returnflag, l_linestatus")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '\\s+', ' ', 'g')"


def norm(x: str, case: str = "lower", null_token: str = "") -> str:
    s = collapse(strip(f"coalesce({x}, '{null_token}')"))
    if case == "lower":
        return f"lower({s})"
    if case == "upper":
        return f"upper({s})"
    return s


def pad(x: str, w: int) -> str:
    return (f"(CASE WHEN regexp_full_match({x}, '[0-9]+') AND length({x}) < {w} "
            f"THEN lpad({x}, {w}, '0') ELSE {x} END)")


def num(x: str) -> str:
    """Lenient text -> double (NUM-2)."""
    return f"TRY_CAST(trim({x}) AS DOUBLE)"


def coerce(x: str) -> str:
    """NUM-1."""
    return f"COALESCE(CASE WHEN isnan({num(x)}) THEN 0.0 ELSE {num(x)} END, 0.0)"
