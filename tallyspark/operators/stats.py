"""Distributions over a corpus of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.frame import numbered

NULL = "(null)"


def scalar_distribution(df: DataFrame, value: Column, total: int | None = None) -> DataFrame:
    """``value, n, share``, most frequent first, then by value; null is a bucket of its own."""
    n = df.count() if total is None else total
    return df.select(F.coalesce(value.cast("string"), F.lit(NULL)).alias("value")).groupBy("value").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.lit(float(max(n, 1)))).orderBy(F.desc("n"), "value")


def documents_of(df: DataFrame, value: Column, key: str) -> DataFrame:
    """``value, n, key`` rows, one for each record: the records of every bucket of :func:`scalar_distribution`.

    A list for each value would grow with the corpus in one row; sorted by falling ``n``, then
    ``value`` and the key, the rows are that list.
    """
    rows = df.select(F.coalesce(value.cast("string"), F.lit(NULL)).alias("value"), F.col(key))
    return rows.join(rows.groupBy("value").agg(F.count("*").alias("n")), "value").select("value", "n", key)


def short_texts(df: DataFrame, key: str, text: Column, least: int = 200) -> DataFrame:
    """``key, length`` of texts under ``least`` characters, a truncated or empty paste; a null text has none and is missing instead."""
    return df.select(key, F.length(text).alias("length")).filter(F.col("length") < least)


def membership_distribution(df: DataFrame, entries: Column, total: int | None = None) -> DataFrame:
    """Like :func:`scalar_distribution` for lists: a record counts once for each distinct entry."""
    n = df.count() if total is None else total
    return df.select(F.explode(F.array_distinct(entries)).alias("value")).groupBy("value").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.lit(float(max(n, 1))))


def list_size_stats(df: DataFrame, by: list[str], size: Column) -> DataFrame:
    """Entries, mean entries, records without any and their share."""
    return df.groupBy(*by).agg(F.sum(size).cast("bigint").alias("total"), F.avg(size.cast("double")).alias("per_record"), F.count_if(size == 0).alias("empty"), F.avg((size == 0).cast("double")).alias("empty_share"))


def most_frequent(values: DataFrame, by: list[str], value: str, least: int = 2) -> DataFrame:
    """The mode of each group if at least ``least`` records have it; ties go to the smaller value."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), value)
    counts = values.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def duplicate_groups(df: DataFrame, key: str, content: Column) -> DataFrame:
    """Content that several rows share: ``digest, n, first_key``."""
    return df.groupBy(F.sha2(content, 256).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first_key")).filter("n > 1")


def corpus_digest(df: DataFrame, key: str, content: Column) -> DataFrame:
    """``n, digest`` of all (key, content) pairs: changes with any of them, whatever the order of rows.

    Sums of two parts of each pair's SHA-256 are hashed once more, so partial sums suffice.
    """
    pair = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.sha2(F.coalesce(content, F.lit("")), 256)), 256)
    part = lambda i: F.sum(F.conv(F.substring(pair, i, 12), 16, 10).cast("decimal(20,0)")).cast("string")
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", part(1), part(13), part(25)), 256).alias("digest"))


def ordered_digest(df: DataFrame, key: str, content: Column, fan: int = 1024) -> DataFrame:
    """``n, digest`` of all (key, content) pairs in the order of the key, then the pair's own digest: their order counts.

    A tree: ``fan`` neighbours' digests at a time are hashed to one, level by level, so a
    task holds ``fan`` digests whatever the corpus. Of no rows the digest is that of nothing.
    """
    pair = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.sha2(F.coalesce(content, F.lit("")), 256)), 256)
    rows = numbered(df.select(F.struct(F.col(key), pair.alias("h")).alias("__order"), pair.alias("h")), "__order").select((F.col("rn") - 1).alias("at"), "h")
    n = rows.count()
    left = n
    while True:
        held = F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x.h)
        rows = rows.groupBy(F.floor(F.col("at") / fan).alias("at")).agg(F.sha2(F.array_join(held, ""), 256).alias("h"))
        left = -(-left // fan)
        if left <= 1:
            break
    return rows.agg(F.lit(n).cast("bigint").alias("n"), F.coalesce(F.first("h"), F.sha2(F.lit(""), 256)).alias("digest"))
