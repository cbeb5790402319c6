"""The four tests for a missing cell. They differ in case folding, trimming and tokens, and stay apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Tokens are compared as given, but for the first list (trimmed, lower case).
WEB_TOKENS = ("na", "n/a", "nan", "null", "none", "__na__")
CORE_TOKENS = ("", "nan", "none", "null", "NA", "NaN")
STATS_TOKENS = (*CORE_TOKENS, "<N/A>", "<NA>", "<NaN>", "NaT", "None")
NA = "__NA__"


def ws_trim(c: Column) -> Column:
    """Without white space at the ends; SQL's trim takes spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def web_missing(c: Column) -> Column:
    t = ws_trim(c)
    return c.isNull() | (t == "") | F.lower(t).isin(*WEB_TOKENS)


def normalize_missing(c: Column) -> Column:
    """Null for a missing cell, else the cell as it is, untrimmed."""
    return F.when(web_missing(c), F.lit(None)).otherwise(c)


def finite_or_null(c: Column) -> Column:
    """Null for a number that is not finite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def core_missing(c: Column) -> Column:
    return c.isNull() | c.isin(*CORE_TOKENS)


def stats_missing(c: Column) -> Column:
    return c.isNull() | c.isin(*STATS_TOKENS)


def transfer_missing(c: Column) -> Column:
    return c.isNull() | ws_trim(c).isin(*CORE_TOKENS)
