"""Packing by optimal length buckets.

A histogram over all lengths, at most ``max_length`` bins, is all that leaves the
executors. Dynamic programming over it chooses the bucket boundaries that minimise
padding; inside a bucket consecutive sequences form batches of a token budget. The
position of a sequence in its bucket comes from counts of equal shards, so no task
ranks a whole bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import common

MAX_LENGTH = 2048
BUCKETS = 16
BUDGET = 16_384
#: Sequences ranked by one task.
SHARD_ROWS = 20_000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least padding; ties go to the smaller ends."""
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(x)
    if n <= buckets:
        return x.tolist()
    rows, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    best = x * rows[1:] - tokens[1:]  # one bucket over the first i + 1 lengths
    cuts = []
    for _ in range(buckets - 1):
        nxt, cut = best.copy(), np.full(n, -1)
        for j in range(1, n):
            # the last bucket holds lengths i + 1 .. j
            cost = best[:j] + x[j] * (rows[j + 1] - rows[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(np.argmin(cost))
            if cost[i] < nxt[j]:
                nxt[j], cut[j] = cost[i], i
        cuts.append(cut)
        best = nxt
    ends, j = [n - 1], n - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            j = int(cut[j])
            ends.append(j)
    return x[ends[::-1]].tolist()


def word_count(text: str | Column) -> Column:
    """Words between white space."""
    t = F.trim(F.regexp_replace(common.text_or_empty(text), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def pack(docs: DataFrame, n_tokens: Column, *, id_col: str = "doc_id", max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``doc_id, piece, start, length, bucket, bucket_length, batch, slot`` of every sequence.

    A document is cut into pieces of ``max_length`` tokens and a rest; every row gives at
    least one piece, so ``n_tokens`` below 1 or null counts as 1 (the end mark). ``batch``
    numbers the batches of a bucket, ``slot`` the places in it; a batch holds
    ``budget // bucket_length`` sequences, one at least. Order in a bucket is by shard of
    the id's hash, then id and piece; rows that repeat an id follow one another.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.greatest(F.coalesce(n_tokens, F.lit(1)), F.lit(1)).cast("bigint").alias("n"))
    piece = F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(max_length).cast("bigint"))).alias("piece", "start")
    pieces = common.keep(docs.select("doc_id", "n", piece).select("doc_id", "piece", "start", F.least(F.lit(max_length).cast("bigint"), F.col("n") - F.col("start")).alias("length")), "pieces")
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).toPandas()  # at most max_length rows
    ends = optimal_boundaries(histogram["length"].to_numpy(), histogram["n"].to_numpy(), buckets) if len(histogram) else [max_length]
    of = np.searchsorted(ends, histogram["length"].to_numpy()) if len(histogram) else np.empty(0, int)
    shards = [max(1, -(-int(histogram["n"].to_numpy()[of == b].sum()) // shard_rows)) if len(histogram) else 1 for b in range(len(ends))]

    bucket = F.lit(len(ends) - 1)
    for b in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("length") <= ends[b], b).otherwise(bucket)
    array = lambda values: F.array(*[F.lit(int(v)).cast("bigint") for v in values])
    rows = pieces.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(array(shards), F.col("bucket") + 1)))
    sizes = rows.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("bucket", "shard", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(F.col("doc_id").asc_nulls_first(), "piece", "length")) - 1
    placed = rows.withColumn("rank", rank).join(offsets, ["bucket", "shard"]).withColumn("at", F.col("before") + F.col("rank")).withColumn("bucket_length", F.element_at(array(ends), F.col("bucket") + 1))
    room = F.greatest(F.lit(1).cast("bigint"), F.expr(f"{int(budget)} div bucket_length"))
    return placed.withColumn("room", room).select("doc_id", "piece", "start", "length", "bucket", "bucket_length", F.expr("at div room").alias("batch"), F.expr("at % room").alias("slot"))


def pack_ids(stored: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", width: int = 4, **settings) -> DataFrame:
    """The sequences of :func:`pack` over token ids, with the ids themselves.

    ``stored`` holds each document's ids as bytes of ``width`` each, end id included, as the
    token store gives them back. Every id of every document is in exactly one sequence, at
    ``start`` and on. Rows that share a document id, or have none, are told apart by a number
    of their own, so ``doc_id`` may repeat.
    """
    kept = common.keep(stored.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")), "stored-ids")
    places = pack(kept, F.expr(f"octet_length(ids) div {int(width)}"), id_col="row", **settings).withColumnRenamed("doc_id", "row")
    cut = F.substring(F.col("ids"), (F.col("start") * width + 1).cast("int"), (F.col("length") * width).cast("int"))
    return places.join(kept, "row").select("doc_id", "piece", "start", "length", "bucket", "bucket_length", "batch", "slot", cut.alias("ids"))


def pack_documents(docs: DataFrame, **settings) -> DataFrame:
    """Documents by words and an end mark."""
    return pack(docs, word_count("text") + 1, **settings)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
