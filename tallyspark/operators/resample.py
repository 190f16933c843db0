"""Bootstrap intervals, exact binomial intervals and seeded samples."""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tallyspark.operators.order import global_index
from tallyspark.shared import keep


#: Bytes of documents, at most, that travel with the draws, and draws in memory at once.
DRAWN_BYTES, _DRAWS = 256 * 2**20, 50_000
#: Documents packed together, and draws of a row of :func:`drawn_sums` (of whole ``_DRAWS``, which share their first digits).
_PACK, _UNIT = 65_536, 1_000_000


def single_draws(spark: SparkSession, n: Column | int, iterations: int, seed: int) -> DataFrame:
    """``b, idx``: a row for each draw of resample ``b`` from ``n`` documents.

    The k-th draw is the first eight hex digits of md5(seed|b|k) modulo ``n``, so any SQL
    engine makes the same draws.
    """
    n = F.lit(n) if isinstance(n, int) else n
    b = spark.range(iterations).withColumnRenamed("id", "b").withColumn("n", n.cast("bigint"))
    k = b.filter("n > 0").select("b", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k"))
    idx = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "b", "k")), 1, 8), 16, 10).cast("bigint") % F.col("n")
    return k.select("b", idx.alias("idx"))


def draws(spark: SparkSession, n: Column | int, iterations: int, seed: int) -> DataFrame:
    """``b, idx, weight``: how often :func:`single_draws` has document ``idx`` in resample ``b``."""
    return single_draws(spark, n, iterations, seed).groupBy("b", "idx").agg(F.count("*").alias("weight"))


@lru_cache(16)
def _tails(at: int, digits: int, own: bool, start: int, n: int) -> tuple[list[np.ndarray], np.ndarray | int]:
    """The last digits of n numbers as words of messages in which they begin at byte ``at``, with the mark of the end, and how many they are.

    Each number has ``digits`` of them, with zeros in front, or as many as it has of its ``own``.
    """
    k, rows = np.arange(start, start + n), np.arange(n)
    counts = sum((k >= 10**j for j in range(1, digits)), np.ones(n, int)) if own else np.full(n, digits)
    text = np.zeros((n, 4 * (-(-(at + digits + 1) // 4))), np.uint8)
    for j in range(digits):
        has = rows[j < counts]
        text[has, (at + counts - 1 - j)[has]] = 48 + (k // 10**j % 10)[has]
    text[rows, at + counts] = 0x80
    return [np.ascontiguousarray(w) for w in text.view("<u4").T], counts.astype(np.uint32) if own else digits


def md5_heads(prefix: str, start: int, n: int) -> np.ndarray:
    """The first eight hex digits of md5(prefix + k), as numbers, for the n numbers k from ``start``.

    Arrays of messages go through the rounds together, several times faster than one call for
    each. First digits that all k share count as the prefix; rounds before the first word that
    differs are those of one message. A message too long for one block is left to hashlib.
    """
    end, digits = start + n - 1, 1
    while start // 10**digits != end // 10**digits:
        digits += 1
    shared = start // 10**digits
    head = f"{prefix}{shared or ''}".encode()
    if len(head) + digits > 55:
        return np.array([int(hashlib.md5(f"{prefix}{k}".encode()).hexdigest()[:8], 16) for k in range(start, start + n)], np.uint32)
    words = np.frombuffer(head.ljust(64, b"\0"), "<u4").tolist()
    tails, counts = _tails(len(head) % 4, digits, not shared, start % 10**digits, n)
    first = len(head) // 4
    for i, tail in enumerate(tails, first):
        words[i] = tail + np.uint32(words[i])
    words[14] = (counts + len(head)) * 8
    a, b, c, d = _MD5_START
    for i in range(first):
        f, turn = (((c ^ d) & b) ^ d) + a + words[i] + int(_MD5_SINES[i]) & 0xFFFFFFFF, _MD5_TURNS[0][i % 4]
        a, d, c, b = d, c, b, b + (f << turn | f >> 32 - turn) & 0xFFFFFFFF
    a, b, c, d = (np.full(n, x, np.uint32) for x in (a, b, c, d))
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(first, 61):  # the last three steps do not touch the first word
        kind, turn = i // 16, np.uint32(_MD5_TURNS[i // 16][i % 4])
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        np.add(f, a, out=f)
        if isinstance(word, np.ndarray):
            np.add(f, word, out=f)
            np.add(f, _MD5_SINES[i], out=f)
        else:
            np.add(f, np.uint32((word + int(_MD5_SINES[i])) & 0xFFFFFFFF), out=f)
        np.left_shift(f, turn, out=t)
        np.right_shift(f, np.uint32(32) - turn, out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    np.add(b, np.uint32(_MD5_START[0]), out=b)
    return b.byteswap()


_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_MD5_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)


def _packed(per_doc: DataFrame, key: str, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The documents in the order of draws: the class of each, and the columns of a class (NaN for null)."""
    docs = indexed(per_doc, key).select("idx", *[F.col(c).cast("double").alias(c) for c in columns])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        # as bytes, for nulls equal each other
        values, of = np.unique(np.ascontiguousarray(pdf[columns].to_numpy(float, na_value=np.nan)).view(np.int64), axis=0, return_inverse=True)
        return pd.DataFrame({"pack": [pdf["idx"].iloc[0] // _PACK], "values": [values.tobytes()], "of": [of.astype("<i4").tobytes()]})

    packs = docs.groupBy(F.floor(F.col("idx") / _PACK)).applyInPandas(pack, "pack bigint, values binary, of binary").collect()
    values, of, n = [], [], 0
    for r in sorted(packs, key=lambda r: r.pack):
        values.append(np.frombuffer(r["values"], np.int64).reshape(-1, len(columns)))
        of.append(np.frombuffer(r["of"], "<i4") + n)
        n += len(values[-1])
    values, merged = np.unique(np.concatenate(values), axis=0, return_inverse=True)
    return merged.astype(np.min_scalar_type(len(values)))[np.concatenate(of)], values.view(float)


def drawn_sums(per_doc: DataFrame, key: str, columns: list[str], iterations: int, seed: int) -> DataFrame:
    """``b`` and the sums of ``columns`` (as doubles) over the documents of every resample, drawn as :func:`single_draws` does.

    Documents travel with the draws as a class each and the classes' columns; a row is up to
    ``_UNIT`` draws of one resample, so no task holds more than the documents, and draws never
    become rows. Documents that take more than ``DRAWN_BYTES`` so (four bytes each and the
    classes of every pack) are joined with the weights of draws.
    """
    spark = per_doc.sparkSession
    classes, n = per_doc.groupBy(*columns).agg(F.count("*").alias("__n")).agg(F.count("*"), F.coalesce(F.sum("__n"), F.lit(0))).first()
    if 4 * n + min(n, classes * -(-n // _PACK)) * 8 * len(columns) > DRAWN_BYTES:
        weighted = draws(spark, n, iterations, seed).join(indexed(per_doc, key), "idx")
        return weighted.groupBy("b").agg(*[F.sum(F.col("weight") * F.col(c)).cast("double").alias(c) for c in columns])
    schema = "b bigint, " + ", ".join(f"`{c}` double" for c in columns)
    if not n:
        return spark.createDataFrame([], schema)
    of, values = _packed(per_doc, key, columns)
    held = spark.sparkContext.broadcast((of, values))
    units = -(-n // _UNIT)

    def sums(batches):
        of, values = held.value
        null = np.isnan(values)
        table = np.where(null, 0.0, values)
        for pdf in batches:
            rows = []
            for unit, b in zip((pdf["id"] // iterations).tolist(), (pdf["id"] % iterations).tolist()):
                hits, k, end = [], unit * _UNIT, min(n, (unit + 1) * _UNIT)
                while k < end:
                    stop = min(end, k - k % _DRAWS + _DRAWS)
                    drawn = md5_heads(f"{seed}|{b}|", k, stop - k)
                    drawn -= drawn // np.uint32(n) * np.uint32(n)  # the remainder; % takes ten times as long
                    hits.append(of.take(drawn))
                    k = stop
                counts = np.bincount(np.concatenate(hits), minlength=len(values))
                rows.append([b, *np.where(counts @ ~null > 0, counts @ table, np.nan)])
            out = pd.DataFrame(rows, columns=["b", *columns])
            yield out.astype({"b": "int64"}).astype({c: "Float64" for c in columns})

    tasks = min(iterations * units, 4 * spark.sparkContext.defaultParallelism)
    parts = spark.range(0, iterations * units, 1, tasks).mapInPandas(sums, schema)
    return parts.groupBy("b").agg(*[F.sum(c).alias(c) for c in columns])


def indexed(per_doc: DataFrame, key: str) -> DataFrame:
    return global_index(per_doc, F.md5(F.col(key).cast("string")), [key])


#: Up to so many classes of documents travel with the tasks.
MOST_CLASSES = 1_000_000


def class_sums(per_doc: DataFrame, columns: list[str], *, iterations: int, seed: int) -> DataFrame:
    """``b`` and the sums of ``columns`` over every resample, drawn by classes.

    Documents alike in all columns are one class, and a resample is one multinomial draw of
    the classes' sizes, so its cost is the number of classes, however many documents there
    are. More than ``MOST_CLASSES`` classes are an error: round the columns, or draw
    documents. The draws are those of a generator seeded by (seed, b).
    """
    classes = per_doc.groupBy(*columns).agg(F.count("*").alias("__n"))
    few = classes.limit(MOST_CLASSES + 1).toPandas().sort_values(columns, ignore_index=True)
    if len(few) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes of documents")
    sizes, values = few["__n"].to_numpy(), few[columns].to_numpy(float, na_value=np.nan)
    values = np.nan_to_num(values)
    held = per_doc.sparkSession.sparkContext.broadcast((sizes, values))

    def draw(batches):
        n, x = held.value
        for pdf in batches:
            rows = [np.random.default_rng([seed, int(b)]).multinomial(n.sum(), n / n.sum()) @ x if len(n) else np.full(len(columns), np.nan) for b in pdf["b"]]
            out = pd.DataFrame(np.array(rows).reshape(len(pdf), len(columns)), columns=columns)
            out.insert(0, "b", pdf["b"].to_numpy())
            yield out

    bs = per_doc.sparkSession.range(iterations).withColumnRenamed("id", "b")
    return bs.mapInPandas(draw, "b bigint, " + ", ".join(f"{c} double" for c in columns))


def bootstrap(per_doc: DataFrame, key: str, metrics: list[str], *, iterations: int, seed: int, by_class: bool = False) -> DataFrame:
    """Percentile intervals of ratios of sums; ``per_doc`` has ``<metric>_num`` and ``<metric>_den``.

    ``by_class`` draws classes of like documents (:func:`class_sums`), for corpora too large to
    draw document by document; the other way's draws any SQL engine can repeat.

    Documents are resampled with replacement. Resamples without a denominator are left out
    and ``n_valid`` counts the others; fewer than two give no interval.
    """
    columns = [f"{m}_{p}" for m in metrics for p in ("num", "den")]
    if by_class:
        sums = class_sums(per_doc, columns, iterations=iterations, seed=seed)
    else:
        sums = drawn_sums(per_doc, key, columns, iterations, seed)
    long = sums.select("b", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.try_divide(F.col(f"{m}_num").cast("double"), F.col(f"{m}_den").cast("double")).alias("v")) for m in metrics])).alias("m")).select("b", "m.*")
    return long.groupBy("metric").agg(F.count("v").alias("n_valid"), F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high")).select("metric", "n_valid", F.when(F.col("n_valid") >= 2, F.col("low")).alias("ci_low"), F.when(F.col("n_valid") >= 2, F.col("high")).alias("ci_high"))


# --- multinomial splitting ------------------------------------------------------------

#: Documents of a portion, on average, and resamples whose weights are in memory at once.
PORTION_DOCS, _BLOCK = 8192, 64


def split_draws(ends: np.ndarray, portion: int, iterations: int, seed: int) -> np.ndarray:
    """How many of each resample's draws fall into a portion; ``ends`` are the portions' sizes summed up.

    One multinomial draw over all portions, taken along one path of a binary tree: what a
    node has is split between its halves by a binomial draw of the node's own generator, so
    each portion finds its part alone, and all parts add up to the resample's size.
    """
    starts = np.concatenate([[0], ends])
    lo, hi = 0, len(ends)
    n = np.full(iterations, starts[-1], np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, whole = starts[mid] - starts[lo], starts[hi] - starts[lo]
        first = np.random.default_rng([seed, 0, lo, hi]).binomial(n, left / whole if whole else 0.0)
        lo, hi, n = (lo, mid, first) if portion < mid else (mid, hi, n - first)
    return n


def portion_sums(values: np.ndarray, draws_: np.ndarray, seed: int, portion: int) -> np.ndarray:
    """The sums [resamples, columns] of so many draws of the rows of ``values`` [documents, columns]."""
    rng, n, out = np.random.default_rng([seed, 1, portion]), len(values), np.empty((len(draws_), values.shape[1]))
    for i in range(0, len(draws_), _BLOCK):
        weights = np.array([np.bincount(rng.integers(0, n, size=k), minlength=n) if n else np.empty(0) for k in draws_[i : i + _BLOCK].tolist()], float)
        out[i : i + _BLOCK] = weights @ values
    return out


def split_sums(per_doc: DataFrame, key: str, columns: list[str], by: str, *, iterations: int, seed: int, portion_docs: int = PORTION_DOCS) -> DataFrame:
    """``b, by`` and the sums of ``columns`` over every resample of the documents ``key``.

    ``per_doc`` has at most one row for each document and value of ``by``, whose resamples
    are the same documents. A document belongs to a portion by a hash of its key; a
    resample's draws are first divided among the portions, then each portion draws within
    itself and multiplies its weights with its documents' columns. Documents are dealt to
    their portions once and are neither broadcast nor joined with draws; the cost of a draw
    is linear in the rows. Keys sort the documents of a portion, so results do not depend
    on how rows are dealt. Null sums count as 0, null keys are one document.
    """
    spark = per_doc.sparkSession
    id_ = F.coalesce(F.col(key).cast("string"), F.lit(""))
    docs = per_doc.select(id_.alias("__id"), F.col(by).cast("string").alias("__by"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    n = docs.agg(F.approx_count_distinct("__id").alias("n")).first().n  # only says how many portions to make
    portions = max(1, -(-n // portion_docs))
    docs = docs.withColumn("__portion", F.pmod(F.xxhash64("__id"), F.lit(portions)))
    sizes = np.zeros(portions, np.int64)
    for r in docs.groupBy("__portion").agg(F.count_distinct("__id").alias("n")).collect():  # a number for each portion
        sizes[r["__portion"]] = r.n
    held = spark.sparkContext.broadcast(np.cumsum(sizes))
    tasks = min(portions, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def draw(batches):
        ends, sums = held.value, {}

        def add(rows: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(rows)
            portion = table["__portion"][0].as_py()
            _, doc = np.unique(table["__id"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            names = table["__by"].to_pylist()
            values = np.column_stack([table[c].to_numpy() for c in columns])
            kinds = list(dict.fromkeys(names))
            wide = np.zeros((doc.max() + 1, len(kinds), len(columns)))
            wide[doc, [kinds.index(x) for x in names]] = values
            part = portion_sums(wide.reshape(len(wide), -1), split_draws(ends, portion, iterations, seed), seed, portion).reshape(iterations, len(kinds), len(columns))
            for i, kind in enumerate(kinds):
                sums[kind] = sums[kind] + part[:, i] if kind in sums else part[:, i]

        rows: list[pa.RecordBatch] = []
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("__portion")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for x, y in zip(cuts, cuts[1:]):
                if rows and x < y and rows[-1]["__portion"][0].as_py() != at[x]:
                    add(rows)
                    rows = []
                if x < y:
                    rows.append(batch.slice(x, y - x))
        if rows:
            add(rows)
        for kind, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(iterations)), pa.array([kind] * iterations, pa.string()), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(len(columns)))], ["b", by, *columns])

    dealt = docs.repartition(tasks, "__portion").sortWithinPartitions("__portion", "__id")
    parts = dealt.mapInArrow(draw, f"b bigint, `{by}` string, " + ", ".join(f"`{c}` double" for c in columns))
    return parts.groupBy("b", by).agg(*[F.sum(c).alias(c) for c in columns])


def split_bootstrap(per_doc: DataFrame, key: str, metrics: list[str], by: str, *, iterations: int, seed: int, portion_docs: int = PORTION_DOCS) -> DataFrame:
    """``by, metric, num, den, n_valid, ci_low, ci_high`` of many ratios of sums in one pass of draws.

    ``per_doc`` has ``<metric>_num`` and ``<metric>_den``. Ratios without a denominator in
    the documents themselves are left out; resamples without one do not count.
    """
    columns = [f"{m}_{p}" for m in metrics for p in ("num", "den")]
    sums = split_sums(per_doc, key, columns, by, iterations=iterations, seed=seed, portion_docs=portion_docs)
    v = [F.try_divide(F.col(f"{m}_num"), F.col(f"{m}_den")) for m in metrics]
    wide = sums.groupBy(by).agg(*[F.struct(F.count(x).alias("n_valid"), F.percentile(x, F.array(F.lit(0.025), F.lit(0.975))).alias("ci")).alias(f"m{i}") for i, x in enumerate(v)])
    ranges = wide.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"m{i}").alias("x")) for i, m in enumerate(metrics)])).alias("m")).select(by, "m.metric", "m.x.n_valid", "m.x.ci")
    whole = per_doc.groupBy(F.col(by).cast("string").alias(by)).agg(*[F.sum(c).alias(c) for c in columns])
    whole = whole.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_num").cast("double").alias("num"), F.col(f"{m}_den").cast("double").alias("den")) for m in metrics])).alias("m")).select(by, "m.*").filter("den > 0")
    bound = lambda i: F.when(F.col("n_valid") >= 2, F.col("ci")[i])
    return whole.join(ranges, [by, "metric"]).select(by, "metric", "num", "den", "n_valid", bound(0).alias("ci_low"), bound(1).alias("ci_high"))


#: Pairs of sums that the resamples of one ratio may have, and counts of pairs in memory at once.
MOST_PAIRS, _COUNTS = 100_000, 4_000_000


def class_bootstrap(per_doc: DataFrame, metrics: list[str], by: str, *, iterations: int, seed: int, weight: str | None = None) -> DataFrame:
    """The columns of :func:`split_bootstrap`, at a cost of draws that does not grow with the documents.

    An interval of one ratio rests on its own (num, den) pairs alone, and documents with the
    same pair are alike to it: how often a resample of all documents has each pair is one
    multinomial draw of the pairs' sizes, exactly. So documents are only counted by pair.
    Ratios draw apart; where the draws of several must be the same documents, use
    :func:`split_sums`, and so for sums that have more than ``MOST_PAIRS`` pairs (an error here).

    ``per_doc`` has a row for each document and value of ``by``, or for ``weight`` like
    documents. Null sums count as 0.
    """
    of = lambda m, p: F.coalesce(F.col(f"{m}_{p}").cast("double"), F.lit(0.0)).alias(p)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), of(m, "num"), of(m, "den")) for m in metrics])
    long = per_doc.select(F.col(by).cast("string").alias(by), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("n"), F.explode(pairs).alias("m")).select(by, "n", "m.*")
    classes = long.groupBy(by, "metric", "num", "den").agg(F.sum("n").alias("n"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_PAIRS:
            raise ValueError(f"more than {MOST_PAIRS} pairs of sums: use split_bootstrap")
        pdf = pdf.sort_values(["num", "den"])
        name, metric = pdf[by].iloc[0], pdf["metric"].iloc[0]
        n, num, den = (pdf[c].to_numpy() for c in ("n", "num", "den"))
        if n @ den <= 0:
            return pd.DataFrame(columns=[by, "metric", "num", "den", "n_valid", "ci_low", "ci_high"])
        rng = np.random.default_rng([seed, zlib.crc32(f"{'' if pd.isna(name) else name}|{metric}".encode())])
        parts = []
        step = max(1, _COUNTS // len(n))
        for i in range(0, iterations, step):
            k = rng.multinomial(n.sum(), n / n.sum(), size=min(step, iterations - i))
            a, b = k @ num, k @ den
            parts.append(a[b != 0] / b[b != 0])
        v = np.concatenate(parts)
        low, high = np.quantile(v, [0.025, 0.975]) if len(v) >= 2 else (None, None)
        return pd.DataFrame([[name, metric, n @ num, n @ den, len(v), low, high]], columns=[by, "metric", "num", "den", "n_valid", "ci_low", "ci_high"])

    return classes.groupBy(by, "metric").applyInPandas(draw, f"`{by}` string, metric string, num double, den double, n_valid bigint, ci_low double, ci_high double")


def paired_bootstrap(per_doc: DataFrame, key: str, a: str, b: str, *, iterations: int, seed: int) -> DataFrame:
    """Interval of the difference of two runs' ratios under the same draws; ``per_doc`` has ``<run>_num`` and ``<run>_den``."""
    columns = [f"{r}_{p}" for r in (a, b) for p in ("num", "den")]
    diff = F.try_divide(F.col(f"{a}_num"), F.col(f"{a}_den")) - F.try_divide(F.col(f"{b}_num"), F.col(f"{b}_den"))
    sums = drawn_sums(per_doc, key, columns, iterations, seed).select("b", diff.alias("d")).filter("d IS NOT NULL")
    return sums.agg(F.count("d").alias("n_valid"), F.percentile("d", 0.025).alias("ci_low"), F.percentile("d", 0.975).alias("ci_high")).withColumn("includes_zero", (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))


# --- exact intervals ----------------------------------------------------------------


#: Points of the quadrature on each side, and the log of what is left out of the density's height.
_POINTS, _TAIL = 48, 45.0
#: Rows whose quadrature is in memory at once.
_ROWS = 20_000


def _beta_quantile(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quantiles of beta distributions with parameters of at least 1, whole arrays at once.

    Such a density is log-concave, so it is followed from its mode to where it has fallen by
    exp(-45) and integrated on both sides of a point by Gauss and Legendre's rule; the cost
    does not grow with the parameters. Heights are relative to the mode's, for sizes of 1e9
    leave no digits to a difference of log gammas. Newton's steps that would leave the
    bracket found so far are halvings instead.
    """
    nodes, weights = np.polynomial.legendre.leggauss(_POINTS)
    nodes, weights = (nodes + 1) / 2, weights / 2
    a1, b1 = a - 1, b - 1
    total = a1 + b1
    mode = np.where(total > 0, a1 / np.maximum(total, 1), 0.5)

    def log_height(x: np.ndarray, k=slice(None)) -> np.ndarray:
        shape = (slice(None),) + (None,) * (x.ndim - 1)
        m, u, v = mode[k][shape], a1[k][shape], b1[k][shape]
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(u > 0, u * np.log1p((x - m) / np.where(m > 0, m, 1)), 0.0)
            right = np.where(v > 0, v * np.log1p((m - x) / np.where(m < 1, 1 - m, 1)), 0.0)
        return left + right

    def fallen(end: float) -> np.ndarray:
        inner, outer = mode.copy(), np.full_like(mode, end)
        for _ in range(60):
            mid = (inner + outer) / 2
            low = log_height(mid) < -_TAIL
            outer, inner = np.where(low, mid, outer), np.where(low, inner, mid)
        return outer

    low, high = fallen(0.0), fallen(1.0)

    def integral(start: np.ndarray, end: np.ndarray, k) -> np.ndarray:
        x = start[:, None] + (end - start)[:, None] * nodes
        return (end - start) * (np.exp(log_height(x, k)) @ weights)

    every = np.arange(len(p))
    mass = integral(low, mode, every) + integral(mode, high, every)
    x = np.clip(mode + np.where(p < 0.5, -2, 2) * np.sqrt(np.maximum(mode * (1 - mode), 1 / (total + 2)) / (total + 3)), (3 * low + mode) / 4, (3 * high + mode) / 4)
    lo, hi, open_ = low.copy(), high.copy(), every
    for _ in range(80):
        k = open_
        near_low = x[k] < mode[k]
        part = np.where(near_low, integral(low[k], x[k], k), mass[k] - integral(x[k], high[k], k)) / mass[k]
        below = part < p[k]
        lo[k], hi[k] = np.where(below, x[k], lo[k]), np.where(below, hi[k], x[k])
        step = (part - p[k]) * mass[k] / np.maximum(np.exp(log_height(x[k], k)), 1e-300)
        new = x[k] - step
        new = np.where((new > lo[k]) & (new < hi[k]), new, (lo[k] + hi[k]) / 2)
        done = np.abs(new - x[k]) <= 1e-12 * new
        x[k] = new
        open_ = k[~done]
        if not len(open_):
            break
    return x


def clopper_pearson_bounds(k: np.ndarray, n: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Exact binomial intervals of ``k`` of ``n``, for whole arrays; 0 of 0 says nothing."""
    shape = np.broadcast_shapes(np.shape(k), np.shape(n))
    k, n = (np.broadcast_to(np.asarray(x, float), shape).ravel() for x in (k, n))
    low, high = np.zeros(k.shape), np.ones(k.shape)
    for out, some, p, a, b in ((low, k > 0, alpha / 2, k, n - k + 1), (high, k < n, 1 - alpha / 2, k + 1, n - k)):
        at = np.flatnonzero(some)
        for i in range(0, len(at), _ROWS):
            part = at[i : i + _ROWS]
            out[part] = _beta_quantile(np.full(len(part), p), a[part], b[part])
    return low.reshape(shape)[()], high.reshape(shape)[()]


@F.pandas_udf(StructType().add("low", DoubleType()).add("high", DoubleType()))
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Null where ``k`` or ``n`` is, or where they are no counts; equal pairs are solved once."""
    pairs = pd.DataFrame({"k": k.to_numpy(float, na_value=np.nan), "n": n.to_numpy(float, na_value=np.nan)})
    known = pairs[(pairs["k"] >= 0) & (pairs["k"] <= pairs["n"])].drop_duplicates()
    known["low"], known["high"] = clopper_pearson_bounds(known["k"].to_numpy(), known["n"].to_numpy())
    return pairs.merge(known, how="left", on=["k", "n"])[["low", "high"]]


def zero_error_bound(n: Column, alpha: float = 0.05) -> Column:
    """Lower bound of a rate after ``n`` of ``n`` successes: (alpha / 2) ^ (1 / n)."""
    return F.when(n > 0, F.pow(F.lit(alpha / 2), 1 / n.cast("double")))


def rule_of_three(n: Column) -> Column:
    return F.when(n > 0, 1 - 3 / n.cast("double"))


# --- samples ------------------------------------------------------------------------


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) by the smallest md5(seed|key); a sort that keeps ``n`` rows per task."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def checked_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """:func:`seeded_sample`, but more rows than there are is an error."""
    if (have := df.limit(n).count()) < n:
        raise ValueError(f"a sample of {n} needs as many rows; there are {have}")
    return seeded_sample(df, key, n, seed)


def extend_sample(existing: DataFrame, pool: DataFrame, key: str, total: int, seed: int) -> DataFrame:
    """``existing`` with as many further rows of ``pool`` as make ``total``.

    Both parts are written once, so neither is drawn again to be counted, left out or
    returned: the pool is read once for each. A sample is small, so its keys are broadcast.
    """
    existing = keep(existing, "sample")
    have = existing.count()
    if total < have:
        raise ValueError(f"the sample already has {have} rows")
    more = keep(seeded_sample(pool.join(F.broadcast(existing.select(key)), key, "left_anti"), key, total - have, seed), "sample")
    if (found := more.count()) < total - have:
        raise ValueError(f"a sample of {total - have} needs as many rows; there are {found}")
    return existing.unionByName(more)
