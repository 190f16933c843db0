"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import common


#: A node is hot with more edges than this, if they are more than one in so many of all: fewer nodes than this are hot.
HOT = 1000


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges(u, v)`` (bigint ids); the root is the smallest node.

    Each step is joins with a partially aggregated minimum. Nodes with very many neighbours
    are few (see ``HOT``), so their minima are broadcast and their edges stay where they
    are; only the others' edges are dealt by node. Rounds grow with the logarithm of the
    longest path; each one's edges are written to the shared folder.
    """
    edges = common.keep(_oriented(edges), "edges")
    seen = None
    while (now := _state(edges)) != seen and not _is_star(edges):
        seen = now
        old, edges = edges, common.keep(_small_star(_large_star(edges)), "edges")
        common.forget(old)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def _is_star(edges: DataFrame) -> bool:
    """Every node has one edge, and none leads to a node with an edge of its own."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    return not twice and not edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()


def spread_join(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join with a kept ``table`` of one row per key that says in ``n`` how many rows have it.

    Keys with very many rows are few (see ``HOT``): their entries are broadcast, their rows
    stay where they are. ``total`` is the number of rows.
    """
    if total <= HOT:
        return rows.join(table.drop("n"), key)
    hot = max(HOT, -(-total // HOT))
    few = F.broadcast(table.filter(F.col("n") > hot).drop("n"))  # HOT rows at most
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(table.filter(F.col("n") <= hot).drop("n"), key))


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """``u, v`` and ``m``, the smallest neighbour of u."""
    least = common.keep(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    return spread_join(edges, least, "u", total)


def _large_star(edges: DataFrame) -> DataFrame:
    total = 2 * edges.count()
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = _with_least(both, total).withColumn("m", F.least("u", "m"))
    return joined.filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    edges = common.keep(_oriented(edges), "edges")
    joined = _with_least(edges, edges.count())
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    stars = joined.filter("v = m").select("u", F.col("m").alias("v"))
    return _oriented(moved.unionByName(stars))
