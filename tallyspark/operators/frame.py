"""Sampling frames: union of listings, duplicates, exclusions, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.values import normalize
from tallyspark.shared import keep


def union_listings(listings: list[DataFrame]) -> DataFrame:
    """All listings with their place in the order of arguments; :func:`numbered` gives the place of a row in the union."""
    out = None
    for i, df in enumerate(listings):
        own = df.withColumn("listing", F.lit(i))
        out = own if out is None else out.unionByName(own)
    return out


def first_occurrences(union: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``is_first`` and ``first_listing``: the first row of a key is kept, later ones point to it; null is a key like any other."""
    w = Window.partitionBy(key).orderBy(*order)
    return union.withColumn("rn", F.row_number().over(w)).withColumn("first_listing", F.first("listing").over(w)).withColumn("is_first", F.col("rn") == 1).drop("rn")


def exclude(population: DataFrame, exclusions: DataFrame, number: str, title: str) -> DataFrame:
    """The population without the excluded rows; excluding by number and by title must agree, titles compared normalised."""
    population, exclusions, columns = population.withColumn("__title", normalize(F.col(title))), exclusions.withColumn("__title", normalize(F.col(title))), population.columns
    title = "__title"
    by_number = population.join(exclusions.select(number).filter(F.col(number).isNotNull()).distinct(), number, "left_semi")
    by_title = population.join(exclusions.select(title).distinct(), title, "left_semi")
    odd = by_number.select(number).exceptAll(by_title.select(number)).limit(1).count() + by_title.select(number).exceptAll(by_number.select(number)).limit(1).count()
    if odd:
        raise ValueError("exclusion by number and by title differ")
    return population.join(exclusions.select(number).distinct(), number, "left_anti").select(columns)


def disagreement(population: DataFrame, exclusions: DataFrame, number: str, title: str) -> DataFrame:
    """Rows that only one of the two ways of exclusion meets; titles are compared normalised."""
    population, exclusions = population.withColumn("__title", normalize(F.col(title))), exclusions.withColumn("__title", normalize(F.col(title)))
    title = "__title"
    e = exclusions.select(number).filter(F.col(number).isNotNull()).distinct().withColumn("by_number", F.lit(True))
    t = exclusions.select(title).distinct().withColumn("by_title", F.lit(True))
    both = population.join(e, number, "left").join(t, title, "left").fillna(False, ["by_number", "by_title"])
    return both.filter(F.col("by_number") != F.col("by_title")).drop("__title")


def count_checks(pages: DataFrame, entries: DataFrame, key: str, total: str) -> DataFrame:
    """``key, total, n, status`` of every page: ``ok`` where it says as many entries as it has, ``incomplete`` where it does not, ``no_counter`` where it says nothing."""
    n = entries.groupBy(key).agg(F.count("*").alias("n"))
    status = F.when(F.col(total).isNull(), "no_counter").when(F.col(total) == F.col("n"), "ok").otherwise("incomplete")
    return pages.select(key, total).join(n, key, "left").fillna(0, ["n"]).select(key, total, "n", status.alias("status"))


def require_counts(checks: DataFrame, key: str) -> None:
    """An error if a page's counter and its entries differ: a frame from an incomplete page is no frame."""
    if bad := checks.filter("status <> 'ok'").orderBy(key).limit(10).collect():
        raise ValueError("pages that cannot be trusted: " + ", ".join(f"{r[key]} ({r.status}: {r.n})" for r in bad))


def swapped(owners: DataFrame, key: str, owner: str) -> DataFrame:
    """``owners`` with ``swapped``: two rows whose contents belong to each other, a cycle of two in the relation of key and owner."""
    pairs = owners.filter(F.col(key) != F.col(owner)).select(F.col(owner).alias(key), F.col(key).alias(owner)).distinct().withColumn("swapped", F.lit(True))
    return owners.join(pairs, [key, owner], "left").fillna(False, ["swapped"])


def numbered_ids(position: Column, start: int, width: int = 4) -> Column:
    """``start`` + a position from 0, padded with zeros; longer numbers are never cut."""
    n = (F.lit(start) + position).cast("string")
    return F.when(F.length(n) >= width, n).otherwise(F.lpad(n, width, "0"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rn`` from 1 by ``key``: each range partition numbers its own rows after the sizes of those before it, so no task sorts everything.

    The ranges are written once: made twice, for the sizes and for the rows, they could differ.
    """
    parts = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    parts = keep(parts, "ranges")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = sizes.select("__part", "__first", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row per partition
    return parts.join(F.broadcast(before), "__part").withColumn("rn", F.col("__at") - F.col("__first") + F.col("__before") + 1).drop("__part", "__at", "__first", "__before")


def assign(records: DataFrame, present: DataFrame, title: str, key: str, free: DataFrame, free_id: str) -> DataFrame:
    """Records whose title is present keep that id; the others take the free ids in order."""
    kept = records.join(present, title, "left")
    todo = numbered(kept.filter(F.col(free_id).isNull()).drop(free_id), key)
    pool = numbered(free, free_id)
    return kept.filter(F.col(free_id).isNotNull()).withColumn("kept", F.lit(True)).unionByName(todo.join(pool, "rn", "left").drop("rn").withColumn("kept", F.lit(False)))
