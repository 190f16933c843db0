"""Quality filter by importance resampling.

Two bag-of-hashed-n-gram models, one of the target (labelled good and not toxic) and one
of all raw text, give each document a log importance weight, the sum of its n-grams' log
ratios; Gumbel top-k then samples without replacement in proportion to the weights. The
models are counts over the whole corpus in a fixed number of buckets, so their size does
not depend on it. A bucket's log ratio is estimated by the end nearest 0 of an interval of
``SURE`` standard errors around the smoothed one: what a few counts suggest by chance would
otherwise add up over a long text and outweigh every word that the target never has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

#: Buckets of each n-gram length (a power of 2), each length's pseudo-count, and the standard errors by which its ratios are drawn to 1.
BITS = 19
PSEUDO = {1: 0.3, 2: 1.0}
SURE = {1: 3.0, 2: 9.0}
#: The sample is as large as the number of rows that weigh no less than this share of the target's documents do.
KEEP = 0.98
#: Labelled rows that fit the target model, and those that calibrate the sample size: about so many at most, picked by the id's hash.
TARGET_ROWS, CALIBRATION_ROWS = 200_000, 50_000
#: Of labelled rows, one in this many calibrates and is not in the target model.
FOLDS = 8


def buckets(text: str | None) -> list[np.ndarray]:
    """For each n-gram length the bucket of every n-gram."""
    tokens = common.token_hashes(text or "", punct=True)
    shift = np.uint64(64 - BITS)
    return [((tokens if n == 1 else common.ngram_hashes(tokens, n)) >> shift).astype(np.int64) + (i << BITS) for i, n in enumerate(PSEUDO)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, raw count, target count) of what a task has read."""
    size = len(PSEUDO) << BITS
    counts = np.zeros((2, size), np.int64)

    def add(kind: int, held: list) -> None:
        if held:
            counts[kind] += np.bincount(np.concatenate(held), minlength=size)

    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            held: tuple[list, list] = ([], [])
            for text, target in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                held[bool(target)].extend(buckets(text))
            add(0, held[0] + held[1])
            add(1, held[1])
    used = np.flatnonzero(counts[0])
    for i in range(0, len(used), 100_000):
        at = used[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], ["bucket", "raw", "target"])


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Log of target over raw frequency per bucket, smoothed, and ``SURE`` standard errors nearer to 0 (0 if it is no further away).

    Zeros stay on the executors; the rest, at most one number per bucket, comes to the
    driver as Arrow.
    """
    length = F.shiftright("bucket", BITS)
    totals = {r.k: (r.raw, r.target) for r in counts.groupBy(length.alias("k")).agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()}
    ratio = F.lit(0.0)
    for i, n in enumerate(PSEUDO):
        raw, target = totals.get(i, (0, 0))
        expected = F.col("raw") * (target / max(1, raw)) + PSEUDO[n]
        x = F.log((F.col("target") + PSEUDO[n]) / expected)
        ratio = F.when(length == i, F.signum(x) * F.greatest(F.lit(0.0), F.abs(x) - SURE[n] / F.sqrt(expected))).otherwise(ratio)
    table = counts.select("bucket", ratio.cast("float").alias("r")).filter("r <> 0").toArrow()
    out = np.zeros(len(PSEUDO) << BITS, np.float32)
    out[table["bucket"].to_numpy()] = table["r"].to_numpy()
    return out


def log_weight(ratios: np.ndarray, text: str | None) -> float:
    """Sum of the n-grams' log ratios; 0 without tokens."""
    return float(sum(ratios[x].sum(dtype=np.float64) for x in buckets(text)))


class Model:
    """The fitted ratios and the weight at which calibration divides target from the rest."""

    def __init__(self, spark: SparkSession, ratios: np.ndarray):
        self._ratios = spark.sparkContext.broadcast(ratios)  # len(PSEUDO) * 2^BITS floats, whatever the corpus
        self.threshold = 0.0

    def weight(self, text: str | Column) -> Column:
        ratios = self._ratios

        @F.pandas_udf("double")
        def weight(texts: pd.Series) -> pd.Series:
            r = ratios.value
            return pd.Series([log_weight(r, t) for t in texts], dtype=float)

        return weight(text)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_rows: int = TARGET_ROWS, calibration_rows: int = CALIBRATION_ROWS, keep: float = KEEP) -> Model:
    """The raw model over all documents; the target one over those that ``labels(doc_id, quality, toxic)`` calls good and not toxic.

    A document with several labels is a target if all of them say so. Of the labelled
    documents every ``FOLDS``-th (by the id's hash) calibrates instead: the threshold is the
    weight that ``keep`` of the target ones among them reach. Without labels of both kinds it is below all weights, so that nothing is rejected. The
    target model fits on about ``target_rows`` documents at most and calibration on about
    ``calibration_rows``, so their ids can be broadcast and no text is shuffled.
    """
    spark = docs.sparkSession
    common.ship(spark)
    good = F.bool_and((F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    labels = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(good.alias("good")).select(F.col("doc_id").alias("__id"), F.col("good").alias("__good"))
    fold = F.pmod(F.xxhash64("__id"), F.lit(FOLDS)) == 0
    # only ids and flags are shuffled; texts meet their label once
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text"))
    targets = _at_most(labels.filter(~fold & F.col("__good")).select("__id"), target_rows)
    known = texts.join(F.broadcast(targets), F.col("__doc") == F.col("__id"), "left").select("__text", F.col("__id").isNotNull().alias("target"))
    counts = known.mapInArrow(_count, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    model = Model(spark, log_ratios(common.keep(counts, "n-gram-counts")))
    checks = _at_most(labels.filter(fold), calibration_rows)
    rows = texts.join(F.broadcast(checks), F.col("__doc") == F.col("__id")).select(F.col("__good").cast("int").alias("good"), model.weight("__text").alias("w")).toArrow()
    model.threshold = keeping_threshold(rows["w"].to_numpy(), rows["good"].to_numpy().astype(bool), keep)
    return model


def _at_most(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows at most, by the id's hash."""
    n = labelled.count()
    share = F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * rows / max(n, 1))
    return labelled.filter(share) if n > rows else labelled


def keeping_threshold(weights: np.ndarray, good: np.ndarray, keep: float = KEEP) -> float:
    """The largest weight of a target row that ``keep`` of the target's rows reach; below all weights if there are not rows of both kinds."""
    if not good.any() or good.all():
        return float("-inf")
    w = np.sort(weights[good])
    return float(w[int((len(w) - 1) * (1 - keep) + 1e-9)])


def gumbel(*key: Column) -> Column:
    """Standard Gumbel noise that depends on the key alone."""
    u = (F.pmod(F.xxhash64(*key), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def sampling_key(model: Model, id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """(log weight, Gumbel key). Rows equal in id and text have equal keys."""
    w = model.weight(F.col(text_col).cast("string"))
    return w, gumbel(F.coalesce(F.col(id_col).cast("string"), F.lit("")), common.text_or_empty(text_col))


def kth_key(keys: DataFrame, k: int) -> float:
    """The k-th largest ``key`` of a kept table, by ever finer histograms."""
    low, high, above, bins = *keys.agg(F.min("key"), F.max("key")).first(), 0, 1024
    if k <= 0 or low is None:
        return float("inf")
    while low < high:
        width = (high - low) / bins
        if not low + width > low:
            break
        at = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        rows = {r.b: (r.n, r.low, r.high) for r in keys.filter((F.col("key") >= low) & (F.col("key") <= high)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        for b in sorted(rows, reverse=True):
            if above + rows[b][0] >= k:
                _, low, high = rows[b]
                break
            above += rows[b][0]
        else:
            return low
    return low


def _keyed(docs: DataFrame, labels: DataFrame, k: int | None, id_col: str, text_col: str, columns: list[Column]) -> tuple[DataFrame, float]:
    """``columns`` with __weight and __key of every row, kept, and the k-th largest key; weights are worked out once."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    w, noise = sampling_key(model, id_col, text_col)
    rows = common.keep(docs.select(*columns, w.alias("__weight"), noise.alias("__key")), "weights").withColumn("__key", F.col("__weight") + F.col("__key"))
    k = rows.filter(F.col("__weight") >= model.threshold).count() if k is None else k
    return rows, kth_key(rows.select(F.col("__key").alias("key")), k)


def resample(docs: DataFrame, labels: DataFrame, *, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, log_weight, sample_key, selected`` of every row.

    A row's key is its log weight and standard Gumbel noise that depends on its id and text
    alone. The ``k`` rows with the largest keys are selected; ``k`` defaults to the number
    of rows at or over the calibrated weight. Rows equal in id and text stand or fall
    together, so ties may add to ``k``. A null text counts as empty and has weight 0.
    """
    rows, least = _keyed(docs, labels, k, id_col, text_col, [F.col(id_col).alias("doc_id")])
    return rows.select("doc_id", F.col("__weight").alias("log_weight"), F.col("__key").alias("sample_key"), (F.col("__key") >= least).alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, *, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`resample` selects, every column as it was; repeated rows stand or fall together."""
    rows, least = _keyed(docs, labels, k, id_col, text_col, [F.col(c) for c in docs.columns])
    return rows.filter(F.col("__key") >= least).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample: its documents alone."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("selected")
