"""Comparable values: normalisation, typed equality and matchers.

A value is carried as text with a type tag where its type matters (``true`` is not 1, and
in exact mode 1 is not 1.0). All functions build Column expressions; only
:func:`normalize_exact` needs Python, for NFC and full case folding.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A clean number: no sign, no grouping.
NUMERIC = r"^[0-9]+(\.[0-9]+)?$"
#: Shortest prefix that may stand for a longer text.
PREFIX_LENGTH = 100


def normalize(x: Column) -> Column:
    """White space collapsed, trimmed, lower case, sharp s folded: equals :func:`normalize_exact` on composed Latin text."""
    return F.replace(F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(StringType())
def normalize_exact(x: pd.Series) -> pd.Series:
    """NFC, white space collapsed, trimmed, case-folded, NFC."""
    nfc = unicodedata.normalize
    return pd.Series([None if t is None else nfc("NFC", " ".join(nfc("NFC", t).split()).casefold()) for t in x], dtype=object)


def tagged(tag: str, text: Column) -> Column:
    """A typed value: ``t`` null, bool, int, float, str, list or dict, and ``s`` its canonical text."""
    return F.struct(F.when(text.isNull(), "null").otherwise(tag).alias("t"), text.cast("string").alias("s"))


def tag_json(x: Column) -> Column:
    """The tag of a JSON value's text; integers and floats are told apart by how they are written."""
    t = F.trim(x)
    return (
        F.when(t.isNull() | (t == "null"), "null")
        .when(t.isin("true", "false"), "bool")
        .when(t.rlike(r"^-?[0-9]+$"), "int")
        .when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "float")
        .when(t.startswith("["), "list")
        .when(t.startswith("{"), "dict")
        .otherwise("str")
    )


def equal_exact(gt: Column, gs: Column, pt: Column, ps: Column) -> Column:
    """Same tag and same canonical text."""
    return (gt == pt) & gs.eqNullSafe(ps)


def equal_normalized(gt: Column, gs: Column, pt: Column, ps: Column) -> Column:
    """Numbers by value, also against a clean numeric string; strings by normalised text; others exactly."""
    number = lambda t: t.isin("int", "float")
    value = lambda t, s: F.when(number(t) | F.trim(s).rlike(NUMERIC), s.try_cast("double"))
    strings = (gt == "str") & (pt == "str")
    either = (number(gt) & (number(pt) | (pt == "str"))) | ((gt == "str") & number(pt))
    return F.when(strings, normalize(gs) == normalize(ps)).when(either, F.coalesce(value(gt, gs) == value(pt, ps), F.lit(False))).otherwise(equal_exact(gt, gs, pt, ps))


def strip_ellipsis(x: Column) -> Column:
    """Without one trailing ellipsis."""
    return F.rtrim(F.regexp_replace(F.rtrim(x), r"(…|\.\.\.)$", ""))


def prefix_match(gold: Column, pred: Column, least: int = PREFIX_LENGTH) -> Column:
    """One text starts the other, over at least ``least`` characters or all of a shorter gold."""
    g, p = strip_ellipsis(normalize(gold)), strip_ellipsis(normalize(pred))
    n = F.least(F.length(g), F.length(p))
    return (F.left(g, n) == F.left(p, n)) & (n >= F.least(F.lit(least), F.length(g)))


def containment_match(gold: Column, pred: Column) -> Column:
    """One text holds the other; an empty one only matches an empty one."""
    g, p = normalize(gold), normalize(pred)
    return F.when((g == "") | (p == ""), g == p).otherwise(F.contains(g, p) | F.contains(p, g))


def set_key(x: Column) -> Column:
    """An array as a set: sorted, without repeats; an empty one is null."""
    s = F.array_sort(F.array_distinct(F.filter(x, lambda v: v.isNotNull())))
    return F.when(F.size(s) > 0, s)


def occurrences(text: Column, value: Column) -> Column:
    """Non-overlapping literal occurrences; an empty value has none."""
    return F.when(F.length(value) > 0, (F.length(text) - F.length(F.replace(text, value, F.lit("")))) / F.length(value)).otherwise(0).cast("bigint")


def snippet(text: Column, value: Column, radius: int = 40) -> Column:
    """The first occurrence with ``radius`` characters on either side, white space collapsed; null if absent."""
    at = F.position(value, text)
    start = F.greatest(F.lit(1), at - radius)
    cut = F.substring(text, start, at - start + F.length(value) + radius)
    return F.when(at > 0, F.trim(F.regexp_replace(cut, r"\s+", " ")))


def hash_bucket(*parts: Column | str, of: int = 100) -> Column:
    """A reproducible bucket of a composite key, the same in any SQL engine: the md5's first four hex digits."""
    key = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int") % of).cast("int")
