"""The cell relation: one row for every compared value, and its outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOMES = ["correct", "correct_null", "hallucination", "omission", "wrong", "no_output"]
CELL_KEY = ["run_id", "doc_id", "field"]


def melt(records: DataFrame, key: str | list[str], fields: dict[str, Column], value: str = "value") -> DataFrame:
    """One row for each record and field, as text; the fields become (field, value).

    The records' partitioning is kept, which ``unpivot`` would forget.
    """
    keys = [key] if isinstance(key, str) else key
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), c.cast("string").alias(value)) for f, c in fields.items()])
    return records.select(*keys, F.explode(pairs).alias("__c")).select(*keys, "__c.field", f"__c.{value}")


def melt_list(records: DataFrame, key: list[str], items: Column, pos: str = "pos", item: str = "item") -> DataFrame:
    """One row for each entry of a list, with its position from 0; empty and null lists give none."""
    return records.select(*key, F.posexplode(items).alias(pos, item))


def melt_map(records: DataFrame, key: list[str], entries: Column) -> DataFrame:
    """One row for each (name, value) of a map; null values are absent."""
    return records.select(*key, F.explode(F.map_filter(entries, lambda k, v: v.isNotNull())).alias("name", "value"))


def classify(gold: Column, pred: Column, equal: Column) -> Column:
    """The five outcomes of a pair; only null is empty."""
    return (
        F.when(gold.isNull() & pred.isNull(), "correct_null")
        .when(gold.isNull(), "hallucination")
        .when(pred.isNull(), "omission")
        .when(equal, "correct")
        .otherwise("wrong")
    )


def outcome(gold: Column, pred: Column, equal: Column, no_output: Column | None = None, uncertain: Column | None = None) -> Column:
    """:func:`classify`, after fields left out as uncertain and documents without usable output."""
    out = classify(gold, pred, equal)
    if no_output is not None:
        out = F.when(no_output, "no_output").otherwise(out)
    if uncertain is not None:
        out = F.when(uncertain, "excluded_uncertain").otherwise(out)
    return out


def set_outcome(gold: Column, pred: Column) -> Column:
    """Outcome of two arrays compared as sets; empty ones are null."""
    from tallyspark.functions.values import set_key

    g, p = set_key(gold), set_key(pred)
    return classify(g, p, g == p)


def unusable(finish_reason: Column, text: Column) -> Column:
    """A response that failed or has no visible text."""
    return (finish_reason == "error") | text.isNull() | (F.regexp_replace(text, r"(?U)\s+", "") == "")
