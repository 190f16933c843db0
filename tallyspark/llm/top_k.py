"""Exact top-k search by distributed selection on score histograms.

Every query is scored against every row, in waves of queries of a bounded size that
travel with the tasks. A first pass brackets each query's k-th score; then histograms
of the scores inside the bracket, summed over all partitions, narrow it until one value
is left. A last pass keeps what scores higher, and of the rows at the k-th score the
smallest ids. Scores are never stored: they are cheaper to make again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import common

BINS = 256
#: Bytes of query vectors, and queries, in one wave; a task holds ``BINS`` counts for each query.
WAVE_BYTES, WAVE_QUERIES = 8 << 20, 16_384
#: Rows and queries whose scores are in memory at once.
_ROWS, _QUERIES = 1024, 1024


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of equal length, at most ``_ROWS`` at a time."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            for i in range(0, len(rows), _ROWS):
                part = rows[i : i + _ROWS]
                yield ids[part], flat[starts[part][:, None] + np.arange(dim)]


def _scored(queries: dict, batches: Iterator[pa.RecordBatch]):
    """(positions of queries, row ids, their scores as int64, a mask of a query's own row), at most ``_QUERIES`` by ``_ROWS`` at a time."""
    for ids, vectors in _blocks(batches):
        at, q_ids, q = queries.get(vectors.shape[1], ((), (), ()))
        for i in range(0, len(at), _QUERIES):
            part = slice(i, i + _QUERIES)
            yield at[part], ids, _scores(q[part], vectors), q_ids[part, None] == ids[None, :]


def _scores(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products; beyond 64 bits the nearest number of 64 bits."""
    top = (np.abs(q).max(initial=0.0) * np.abs(vectors).max(initial=0.0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q @ vectors.T).astype(np.int64)
    # beyond what doubles hold exactly
    rows, asked = ([[int(x) for x in v] for v in m] for m in (vectors, q))
    exact = [[min(MOST - 1, max(LEAST + 1, sum(map(int.__mul__, a, b)))) for b in rows] for a in asked]
    return np.array(exact, dtype=np.int64).reshape(len(q), len(vectors))


LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _bracket(queries: dict, n_queries: int, k: int):
    """Per partition and query: candidates, the k-th largest score, the smallest and the largest."""

    def run(batches):
        best = np.full((n_queries, k), LEAST, np.int64)
        low = np.full(n_queries, MOST, np.int64)
        n = np.zeros(n_queries, np.int64)
        for at, ids, s, own in _scored(queries, batches):
            n[at] += (~own).sum(axis=1)
            low[at] = np.minimum(low[at], np.where(own, MOST, s).min(axis=1, initial=MOST))
            s = np.where(own, LEAST, s)
            both = np.concatenate([best[at], np.partition(s, s.shape[1] - k, axis=1)[:, -k:] if s.shape[1] > k else s], axis=1)
            best[at] = np.sort(both, axis=1)[:, -k:]
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(has, pa.int64()), pa.array(n[has], pa.int64()), pa.array([int(best[i, 0]) if n[i] >= k else None for i in has], pa.int64()), pa.array(low[has], pa.int64()), pa.array(best[has, -1], pa.int64())],
            ["q", "n", "kth", "low", "high"],
        )

    return run


def _histogram(queries: dict, low: np.ndarray, width: np.ndarray, high: np.ndarray):
    """Per partition: (query, bin, count) of the scores in each query's bracket."""

    def run(batches):
        n = len(low)
        counts = np.zeros((n, BINS), np.int64)
        for at, ids, s, own in _scored(queries, batches):
            inside = ~own & (s >= low[at][:, None]) & (s <= high[at][:, None])
            row, col = np.nonzero(inside)
            q = at[row]
            np.add.at(counts, (q, (s[row, col] - low[q]) // width[q]), 1)
        q, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(b, pa.int64()), pa.array(counts[q, b], pa.int64())], ["q", "bin", "n"])

    return run


def _chosen(queries: dict, q_ids: np.ndarray, kth: np.ndarray, k: int):
    """Per partition: all rows above a query's k-th score, and the ``k`` smallest ids of those at it."""

    def run(batches):
        ties: dict[int, list[int]] = {}
        for at, ids, s, own in _scored(queries, batches):
            row, col = np.nonzero(~own & (s > kth[at][:, None]))
            yield _rows(q_ids[at[row]], ids[col], s[row, col])
            row, col = np.nonzero(~own & (s == kth[at][:, None]))
            for q in np.unique(row):
                i = int(at[q])
                ties[i] = sorted(ties.get(i, []) + np.sort(ids[col[row == q]])[:k].tolist())[:k]
        q = np.array([i for i, x in ties.items() for _ in x], np.int64)
        yield _rows(q_ids[q], np.array([v for x in ties.values() for v in x], np.int64), kth[q])

    return run


def _rows(q, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products.

    Components become ``floor(scale * x)``. The id is the row's identity: rows with a
    query's own id are no candidates for it, and query rows that repeat an id are answered
    once, for the smallest of their vectors.
    Vectors that are null, hold null or non-finite components, or have a null id take no
    part; vectors of another length than the query's are no candidates. Fewer than ``k``
    candidates are all returned; ties go to the smaller id. A component or a score beyond 64
    bits counts as the nearest number of 64 bits. A wave of queries is one set of passes over the rows.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    x = F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"), bad.alias("bad"))
    rows = rows.filter("id IS NOT NULL AND v IS NOT NULL AND NOT bad")
    asked = rows.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    total = asked.agg(F.sum(F.size("v") * 8 + 16).alias("n")).first().n or 0
    waves = max(-(-total // wave_bytes), -(-asked.count() // WAVE_QUERIES))
    results = []
    for wave in range(waves):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(waves)) == wave).collect()  # about wave_bytes
        own = sorted((r.id, r.v) for r in own)
        results.append(common.keep(_wave(rows.select("id", "v"), own, k), "top-k"))
    if not results:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    found = results[0]
    for r in results[1:]:
        found = found.unionByName(r)
    return found


def _wave(rows: DataFrame, asked: list, k: int) -> DataFrame:
    n = len(asked)
    q_ids = np.array([i for i, _ in asked], np.int64)
    by_dim: dict[int, list[int]] = {}
    for i, (_, v) in enumerate(asked):
        by_dim.setdefault(len(v), []).append(i)
    queries = {d: (np.array(at), q_ids[at], np.array([asked[i][1] for i in at], np.float64).reshape(len(at), d)) for d, at in by_dim.items()}
    got = rows.mapInArrow(_bracket(queries, n, k), "q bigint, n bigint, kth bigint, low bigint, high bigint").groupBy("q").agg(F.sum("n").alias("n"), F.max("kth").alias("kth"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    low, high, total = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for r in got:
        total[r.q], high[r.q] = r.n, r.high
        low[r.q] = r.low if r.n <= k or r.kth is None else r.kth
    above = np.zeros(n, np.int64)  # scores over the bracket
    open_ = (total > k) & (low < high)
    while open_.any():
        width = np.maximum(1, -(-(high - low + 1) // BINS))
        shut = np.where(open_, high, low - 1)  # settled queries match nothing
        counts = np.zeros((n, BINS), np.int64)
        got = rows.mapInArrow(_histogram(queries, low, width, shut), "q bigint, bin bigint, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()  # WAVE_QUERIES * BINS rows at most
        counts[got["q"].to_numpy(), got["bin"].to_numpy()] = got["n"].to_numpy()
        over = above[:, None] + np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # scores in a bin or higher
        for i in np.flatnonzero(open_):
            b = int(np.flatnonzero(over[i] >= k)[-1])
            above[i] = over[i, b + 1] if b + 1 < BINS else above[i]
            low[i], high[i] = low[i] + b * width[i], min(high[i], low[i] + (b + 1) * width[i] - 1)
        open_ &= low < high
    found = rows.mapInArrow(_chosen(queries, q_ids, low, k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
