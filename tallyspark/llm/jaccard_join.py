"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Every text becomes its set of word shingles, one digest of the set and ``HASHES``
   MinHash values; texts with equal sets are one class of copies from here on.
2. Bands of MinHash values put similar classes into common buckets (at 0.8 a pair is
   missed with probability 2e-7). A bucket only links its members to its smallest one,
   so its cost is linear; connected buckets form candidate groups.
3. The texts of a group meet in blocks of a bounded size, every pair of classes in one
   block. A group of several blocks may hang together by chains of buckets alone; where
   that sends fewer texts, its buckets are blocked each for itself instead, and a pair that
   shares several counts in the first. In a block MinHash values are compared some at a time; a pair is dropped as soon as
   the posterior probability that its similarity reaches the threshold falls below
   ``TOLERANCE``. Pairs that survive all values are verified on their shingles.
4. A block returns sums of links per class and a spanning forest of its links, never
   the pairs themselves; the forests' components are the result's classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common
from tallyspark.llm.graph import components, spread_join

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: MinHash values compared before each decision.
STEP = 40
TOLERANCE = 1e-7
#: Texts and shingles of one chunk; a block is one chunk or two.
CHUNK_TEXTS, CHUNK_SHINGLES = 256, 200_000


@lru_cache(maxsize=4)
def _multipliers(n: int) -> np.ndarray:
    rng = np.random.default_rng(20_240_607)
    return (rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def signature(shingles: np.ndarray, n: int = HASHES) -> np.ndarray:
    """MinHash values: the least of ``a * x + y`` mod 2^32 over the halves x, y of each shingle's hash."""
    a = _multipliers(n)
    lo, hi = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 1024):
        np.minimum(out, (a * lo[i : i + 1024] + hi[i : i + 1024]).min(axis=1), out=out)
    return out


@lru_cache(maxsize=16)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> tuple[tuple[int, int], ...]:
    """(values compared, matches a pair must have to go on).

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(step, hashes + 1, step):
        p, m = 0.0, 0
        while (p := p + math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append((n, m))
    return tuple(out)


def _sign(words: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = [common.shingle_set(t, words) for t in part.column(3).to_pylist()]
                with np.errstate(over="ignore"):
                    a = [int(common.mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                    b = [int(common.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s, hashes).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["row", "doc_id", "text_hash", "set_a", "set_b", "n", "sig"],
                )

    return run


def _pairs(first: list, second: list | None, limits, threshold: float, band: int = -1):
    """(i, [j ...]) of all links; second None: within ``first``. Items: (row, copies, shingles, signature).

    Of a band's bucket, only the pairs that share no band before it.
    """
    other = first if second is None else second
    sigs = np.stack([x[3] for x in other])
    sets = [x[2] for x in first] + ([] if second is None else [x[2] for x in second])
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    shift = 0 if second is None else len(first)
    sizes = np.array([len(x[2]) for x in other])
    flag = np.zeros(len(vocabulary), bool)
    for i, x in enumerate(first):
        alive = np.arange(i + 1 if second is None else 0, len(other))
        # sizes alone bound the similarity
        n = len(x[2])
        alive = alive[np.minimum(sizes[alive], n) >= threshold * np.maximum(sizes[alive], n) - 1e-9]
        if band > 0 and len(alive):
            same = (sigs[alive, : band * ROWS] == x[3][: band * ROWS]).reshape(len(alive), band, ROWS).all(axis=2).any(axis=1)
            alive = alive[~same]
        matches, done = np.zeros(len(alive), np.int64), 0
        for upto, least in limits:
            if not len(alive):
                break
            matches += (sigs[alive, done:upto] == x[3][done:upto]).sum(axis=1)
            ok = matches >= least
            alive, matches, done = alive[ok], matches[ok], upto
        if not len(alive):
            continue
        own = ids[cuts[i] : cuts[i + 1]]
        flag[own] = True
        common_ = np.array([np.count_nonzero(flag[ids[cuts[j + shift] : cuts[j + shift + 1]]]) for j in alive])
        flag[own] = False
        linked = alive[common_ >= threshold * (n + sizes[alive] - common_) - 1e-9]
        if len(linked):
            yield i, linked


def _verify(words: int, threshold: float, tolerance: float, hashes: int, step: int):
    def block(band: int, rows: list[tuple]) -> Iterator[tuple]:
        """rows: (side, row, copies, text, sig) → (row, other or None, links)."""
        items: dict[int, list] = {0: [], 1: []}
        last = None
        for side, row, copies, text, sig in rows:
            if (side, row) == last:  # the text of another row with the same id and text
                continue
            last = side, row
            items[side].append((row, copies, common.shingle_set(text, words), np.frombuffer(sig, np.uint32)))
        first, second = items[0], items[1]
        if not first or (second == [] and len(first) < 2):
            return
        both = first + second
        links = np.zeros(len(both), np.int64)
        copies = np.array([x[1] for x in both])
        up = list(range(len(both)))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        shift = len(first) if second else 0
        for i, linked in _pairs(first, second or None, least_matches(threshold, tolerance, hashes, step), threshold, band):
            links[i] += copies[linked + shift].sum()
            links[linked + shift] += copies[i]
            for j in linked + shift:
                a, b = root(i), root(int(j))
                if a != b:
                    up[max(a, b)] = min(a, b)
                    yield both[i][0], both[int(j)][0], 0
        for i in np.flatnonzero(links):
            yield both[i][0], None, int(links[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, alone = None, True
        out: list[tuple] = []

        def close() -> None:
            # a block of two chunks has both sides; one whose other chunk is empty has no pairs of its own
            if alone or len({r[0] for r in held}) == 2:
                out.extend(block(key[1], held))

        def rows() -> pa.RecordBatch:
            a, b, n = zip(*out) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["row", "other", "links"])

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                for g, band, bucket, x, y, side, row, copies, text, sig in zip(*(c.to_pylist() for c in batch.slice(i, 512).columns)):
                    if key != (g, band, bucket, x, y):
                        if key is not None:
                            close()
                        held, key, alone = [], (g, band, bucket, x, y), x == y
                        if len(out) > 50_000:
                            yield rows()
                    held.append((side, row, copies, text, sig))
        if key is not None:
            close()
        yield rows()

    return run


def _chunks(texts: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(texts / CHUNK_TEXTS), F.ceil(shingles / CHUNK_SHINGLES)).cast("int")


def _place(members: DataFrame, posted: DataFrame) -> DataFrame:
    """``row, grp, band, bucket, chunk, chunks``: the blocks where a row meets others of its group.

    A group of one chunk, or one whose buckets would send as many texts or more, is blocked
    as a whole (band -1); any other bucket by bucket.
    """
    sizes = members.groupBy("grp").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).withColumn("chunks", _chunks(F.col("size"), F.col("shingles")))
    sizes = common.keep(sizes.select("grp", "chunks", (F.col("size") * F.col("chunks")).alias("cost")), "group-sizes")
    large = members.join(sizes.filter("chunks > 1").select("grp"), "grp").select("row", "grp")
    own = posted.join(large, "row")
    buckets = own.groupBy("grp", "band", "bucket").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).filter("size > 1").withColumn("chunks", _chunks(F.col("size"), F.col("shingles")))
    buckets = common.keep(buckets.select("grp", "band", "bucket", "chunks", (F.col("size") * F.col("chunks")).alias("cost")), "bucket-sizes")
    apart = buckets.groupBy("grp").agg(F.sum("cost").alias("apart"))
    plan = common.keep(sizes.join(apart, "grp", "left").select("grp", "chunks", F.coalesce(F.col("apart") < F.col("cost"), F.lit(False)).alias("by_bucket")), "plan")
    whole = members.select("row", "grp").join(plan.filter("NOT by_bucket").select("grp", "chunks"), "grp").select("row", "grp", F.lit(-1).alias("band"), F.lit(0).cast("bigint").alias("bucket"), "chunks")
    split = own.join(plan.filter("by_bucket").select("grp"), "grp", "left_semi").join(buckets.select("grp", "band", "bucket", "chunks"), ["grp", "band", "bucket"]).select("row", "grp", "band", "bucket", "chunks")
    return whole.unionByName(split).withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, text_hash, class_id, copy_of, n_copies, n_links, keeper`` for every row.

    A row's links are all other rows whose shingle set has a Jaccard similarity of at
    least ``threshold`` with its own, its copies among them. ``class_id`` is the smallest
    id that links connect it to, ``copy_of`` the smallest id with an equal set. A null or
    empty text has no shingle, no links and a class of its own. One row of each class is
    its keeper: the smallest id, then the smallest hash of the text; rows equal in both
    are keepers together. Null ids sort last, and a class of null ids has a null class_id.
    ``threshold`` must be at least 0.8 for the stated odds of missing a pair.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(common.text_or_empty(text_col)).alias("text_hash"), common.text_or_empty(text_col).alias("text"))
    signed = common.keep(rows.mapInArrow(_sign(words, HASHES), "row bigint, doc_id bigint, text_hash bigint, set_a bigint, set_b bigint, n bigint, sig binary"), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row")
    classes = common.keep(signed.filter("n > 0").groupBy("set_a", "set_b").agg(F.min(order).alias("least"), F.count("*").alias("copies")).select("set_a", "set_b", F.col("least.row").alias("row"), F.col("least.doc_id").alias("copy_of"), F.col("least.text_hash").alias("first_hash"), "copies"), "classes")

    sigs = signed.filter("n > 0").join(classes.select("row", "copies"), "row").select("row", "doc_id", "text_hash", "n", "sig", "copies")
    sigs = common.keep(sigs, "class-signatures")
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (4 * ROWS) + 1, F.lit(4 * ROWS))))).alias("band", "bucket")
    posted = sigs.select("row", "n", band)
    buckets = common.keep(posted.groupBy("bucket").agg(F.min("row").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("bucket", "hub"), "buckets")
    near = posted.join(buckets, "bucket").filter("row <> hub").select(F.col("row").alias("u"), F.col("hub").alias("v"))
    groups = common.keep(components(near).select(F.col("node").alias("row"), F.col("root").alias("grp")), "groups")

    placed = _place(sigs.select("row", "n").join(groups, "row"), posted)
    members = sigs.select("row", "doc_id", "text_hash", "copies", "sig").join(placed, "row")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    texts = rows.select("doc_id", "text_hash", "text").withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    # of rows equal in id and text any one serves
    texts = members.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    key = ["grp", "band", "bucket", "x", "y"]
    meeting = texts.withColumn("o", other).select("grp", "band", "bucket", F.least("chunk", "o").alias("x"), F.greatest("chunk", "o").alias("y"), (F.col("chunk") > F.col("o")).cast("int").alias("side"), "row", "copies", "text", "sig")
    blocks = meeting.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, "side", "row")
    found = common.keep(blocks.mapInArrow(_verify(words, threshold, tolerance, HASHES, STEP), "row bigint, other bigint, links bigint"), "links")

    linked = found.filter("other IS NULL").groupBy("row").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other IS NOT NULL").select(F.col("row").alias("u"), F.col("other").alias("v")))
    named = classes.join(linked, "row", "left").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    first = F.min(F.struct(F.col("copy_of").isNull().alias("no_id"), F.col("copy_of").alias("id"), F.col("first_hash").alias("hash")))
    named = common.keep(named, "roots")
    tops = common.keep(named.groupBy("root").agg(first.alias("top"), F.count("*").alias("n")), "tops")
    named = common.keep(spread_join(named, tops, "root", named.count()).select("set_a", "set_b", "copy_of", F.col("copies").alias("n_copies"), F.coalesce("links", F.lit(0)).alias("links"), F.col("top.id").alias("class_id"), F.col("top.hash").alias("class_hash")), "named")
    joined = signed.drop("sig").join(named, ["set_a", "set_b"], "left")
    empty = F.col("n") == 0
    return joined.select(
        "doc_id",
        "text_hash",
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.when(empty, 1).otherwise(F.col("n_copies")).cast("bigint").alias("n_copies"),
        F.when(empty, 0).otherwise(F.col("n_copies") - 1 + F.col("links")).cast("bigint").alias("n_links"),
        (empty | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash")))).alias("keeper"),
    )


def keep_one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` with one row left of each class; every column stays as it is."""
    id_col, text_col = settings.get("id_col", "doc_id"), settings.get("text_col", "text")
    result = common.keep(jaccard_join(docs, **settings).filter("keeper").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")), "keepers")
    repeated = result.filter("n > 1").limit(1).count() > 0
    columns = docs.columns
    keys = result.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    kept = docs.join(keys, F.col(id_col).cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(common.text_or_empty(text_col)) == F.col("__hash")), "left_semi")
    if repeated:  # rows equal in id and text were keepers together
        empty = F.trim(common.text_or_empty(text_col)) == ""
        kept = kept.filter(~empty).dropDuplicates([id_col, text_col]).unionByName(kept.filter(empty))
    return kept.select(columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "copy_of", "n_copies", "n_links")
