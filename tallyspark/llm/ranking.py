"""Ranked lexical search over hierarchical max trees.

Documents lie in shards, runs of at most ``SHARD_DOCS`` documents. For every term a shard
holds the documents with their scores and, above them, level by level, the highest score in
each range of ``FAN`` documents, of ``FAN`` such ranges, and so on to the whole shard. The
weighted highs of an item's terms add up to a bound for all documents of a range. A search
opens the range with the highest bound first, until none reaches the k-th score found; a
range whose bound equals that score is opened, for a smaller id may tie there.

Texts are read once, whatever the number of items. Items are searched in waves of a bounded
size; a task goes through its shards one at a time and carries each item's k-th score along,
and where there are many shards, a first search of a few sets that score for all tasks.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import common

#: Children of a range; documents and term entries of a shard.
FAN, SHARD_DOCS, SHARD_ENTRIES = 16, 4096, 1 << 19
#: Bytes of terms that may travel with the tasks as a filter; with more terms, every term of the documents is indexed.
FILTER_BYTES = 64 << 20
#: Bytes of items in one wave.
WAVE_BYTES = 8 << 20
#: Shards of the first search, which is made where there are ``SEED_FROM`` times as many.
SEED_SHARDS, SEED_FROM = 32, 8

_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_END = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_PART = 4 << 20
_SHARD = "n_docs bigint, n_words bigint, ids binary, sizes binary, terms array<binary>, starts binary, docs binary, times binary"
_TREE = "ids binary, terms array<binary>, levels array<struct<starts:binary,nodes:binary,most:binary>>"


def term_counts(text: bytes) -> tuple[int, Counter]:
    """Number of terms and each one's occurrences; only A-Z are lower-cased."""
    text, n, counts, at = text.lower(), 0, Counter(), 0
    while at < len(text):
        end = m.start() if len(text) - at > _PART and (m := _END.search(text, at + _PART)) else len(text)
        found = _TERM.findall(text[at:end] if end - at < len(text) else text)
        n += len(found)
        counts.update(found)
        at = end
    return n, counts


def _shards(wanted):
    """One row a shard: its documents' ids and sizes, and for each wanted term the documents and times it occurs in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value if wanted else None
        ids, sizes, entries, n_docs, n_words = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            names = sorted({t for _, t, _ in entries})
            at = {t: i for i, t in enumerate(names)}
            term = np.fromiter((at[t] for _, t, _ in entries), np.int64, len(entries))
            doc = np.fromiter((d for d, _, _ in entries), np.uint16, len(entries))
            times = np.fromiter((k for _, _, k in entries), np.int32, len(entries))
            order = np.argsort(term, kind="stable")
            starts = np.searchsorted(term[order], np.arange(len(names) + 1)).astype(np.int32)
            values = [np.array(ids, np.int64), np.array(sizes, np.int64)]
            return pa.RecordBatch.from_arrays(
                [pa.array([n_docs]), pa.array([n_words]), *(pa.array([x.tobytes()], pa.binary()) for x in values), pa.array([names], pa.list_(pa.binary())), *(pa.array([x.tobytes()], pa.binary()) for x in (starts, doc[order], times[order]))],
                ["n_docs", "n_words", "ids", "sizes", "terms", "starts", "docs", "times"],
            )

        for batch in common.grouped(batches, 1, _PART):
            for doc_id, text in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary()).to_pylist()):
                n, counts = term_counts(text)
                if not n:
                    continue
                n_docs, n_words = n_docs + 1, n_words + n
                found = [(t, k) for t, k in counts.items() if keep is None or t in keep]
                if found:
                    entries += [(len(ids), t, k) for t, k in found]
                    ids.append(doc_id)
                    sizes.append(n)
                if len(ids) >= SHARD_DOCS or len(entries) >= SHARD_ENTRIES:
                    yield flush()
                    ids, sizes, entries, n_docs, n_words = [], [], [], 0, 0
        if n_docs:
            yield flush()

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents that hold it) of the task's shards."""
    counts: Counter = Counter()
    for batch in batches:
        for terms, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update(dict(zip(terms, np.diff(np.frombuffer(starts, np.int32)).tolist())))
        if len(counts) >= SHARD_ENTRIES:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["term", "df"])
            counts = Counter()
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["term", "df"])


def unit_scores(times: np.ndarray, sizes: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """What a term of weight 1 adds to the score of documents of these sizes that hold it so many times."""
    m = 100 - 25 + (25 * sizes * n_docs) // n_words
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


def _trees(n_docs: int, n_words: int):
    """Each shard's max trees: level 0 has the documents' unit scores, level i the highest of FAN nodes below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, terms, starts, docs, times in zip(*(batch.column(i).to_pylist() for i in range(6))):
                n = len(ids) // 8
                if not n:
                    continue
                starts, node = np.frombuffer(starts, np.int32), np.frombuffer(docs, np.uint16).astype(np.int64)
                most = unit_scores(np.frombuffer(times, np.int32).astype(np.int64), np.frombuffer(sizes, np.int64)[node], n_docs, n_words)
                term = np.repeat(np.arange(len(terms)), np.diff(starts))
                levels = []
                while True:
                    levels.append({"starts": starts.tobytes(), "nodes": node.astype(np.uint16).tobytes(), "most": most.astype(np.int32).tobytes()})
                    if n == 1:
                        break
                    node, n = node // FAN, -(-n // FAN)
                    first = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(node) != 0)]))
                    most, term, node = np.maximum.reduceat(most, first), term[first], node[first]
                    starts = np.searchsorted(term, np.arange(len(terms) + 1)).astype(np.int32)
                kind = pa.list_(pa.struct([("starts", pa.binary()), ("nodes", pa.binary()), ("most", pa.binary())]))
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([terms], pa.list_(pa.binary())), pa.array([levels], kind)], ["ids", "terms", "levels"])

    return run


class Tree:
    """One shard, ready to search."""

    def __init__(self, ids: bytes, terms: list[bytes], levels: list[dict], fan: int = FAN):
        self.fan = fan
        self.ids = np.frombuffer(ids, np.int64)
        self.term = {t: i for i, t in enumerate(terms)}
        self.levels = []
        width = len(self.ids)
        for x in levels:
            starts = np.frombuffer(x["starts"], np.int32)
            term = np.repeat(np.arange(len(terms)), np.diff(starts))
            # by term and node, so the children of a node are found for all terms at once
            self.levels.append((width, term * width + np.frombuffer(x["nodes"], np.uint16), np.frombuffer(x["most"], np.int32)))
            width = -(-width // fan)

    def children(self, level: int, first: int, last: int, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The weighted sums over the terms of the nodes from ``first`` to before ``last`` of a level."""
        width, keys, most = self.levels[level]
        last = min(last, width)
        lo, hi = np.searchsorted(keys, term * width + first), np.searchsorted(keys, term * width + last)
        n = hi - lo
        at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
        out = np.zeros(last - first, np.int64)
        np.add.at(out, keys[at] % width - first, most[at] * np.repeat(weight, n))
        return out

    def search(self, weights: dict[bytes, int], k: int, least: int) -> list[tuple[int, int]]:
        """(score, id) of all documents that may be among the ``k`` highest of a shard, and score ``least`` or more; best first."""
        have = [(i, w) for t, w in weights.items() if (i := self.term.get(t)) is not None]
        if not have:
            return []
        term, weight = np.array(have, np.int64).T
        top = len(self.levels) - 1
        heap = [(-int(b), top, i) for i, b in enumerate(self.children(top, 0, self.levels[top][0], term, weight)) if b >= least]
        heapq.heapify(heap)
        found: list[tuple[int, int]] = []
        while heap and -heap[0][0] >= least:
            bound, level, node = heapq.heappop(heap)
            if level == 0:
                found.append((-bound, int(self.ids[node])))
                if len(found) >= k:
                    least = max(least, found[k - 1][0])
                continue
            first = node * self.fan
            sums = self.children(level - 1, first, first + self.fan, term, weight)
            for i in np.flatnonzero(sums >= least).tolist():
                heapq.heappush(heap, (-int(sums[i]), level - 1, first + i))
        return found


def _search(wave, k: int):
    """(item's place in the wave, id, score) of a task's best documents for each item, ``k`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least = wave.value
        least, best = list(least), [[] for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree(*(batch.column(c)[i].as_py() for c in range(3)), FAN)
                for q, weights in enumerate(items):
                    if found := tree.search(weights, k, least[q]):
                        best[q] = sorted(best[q] + found, key=lambda x: (-x[0], x[1]))[:k]
                        if len(best[q]) == k:
                            least[q] = max(least[q], best[q][-1][0])
        rows = [(q, d, s) for q, found in enumerate(best) for s, d in found]
        if rows:
            q, d, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["place", "doc_id", "score"])

    return run


@dataclass
class Index:
    shards: DataFrame
    n_shards: int
    frequencies: DataFrame
    n_docs: int
    n_words: int


def build_index(docs: DataFrame, terms: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The trees of all documents with a term, and how many documents hold each term.

    ``terms`` (one binary column, lower case) limits the index to these terms, if they are
    few enough to travel with the tasks. A row without an id takes no part.
    """
    spark = docs.sparkSession
    common.ship(spark)
    wanted = None
    if terms is not None:
        terms = terms.toDF("term").distinct()
        if (terms.agg(F.sum(F.octet_length("term") + 64).alias("n")).first().n or 0) <= FILTER_BYTES:
            wanted = spark.sparkContext.broadcast(frozenset(bytes(t) for t in terms.toArrow()["term"].to_pylist()))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), common.text_or_empty(F.col(text_col).cast("string")).alias("text")).filter("id IS NOT NULL")
    shards = common.keep(rows.mapInArrow(_shards(wanted), _SHARD), "shards")
    total = shards.agg(F.sum("n_docs").alias("d"), F.sum("n_words").alias("w"), F.count("*").alias("n")).first()
    n_docs, n_words = total.d or 0, total.w or 0
    frequencies = common.keep(shards.select("terms", "starts").mapInArrow(_frequencies, "term binary, df bigint").groupBy("term").agg(F.sum("df").alias("df")), "frequencies")
    trees = common.keep(shards.select("ids", "sizes", "terms", "starts", "docs", "times").mapInArrow(_trees(n_docs, n_words), _TREE), "trees")
    common.forget(shards)
    return Index(trees, total.n, frequencies, n_docs, n_words)


def _read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.grouped(batches, 1, _PART):
        counts = [term_counts(t)[1] for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))], ["item_id", "terms", "times"]
        )


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(index: Index, items: DataFrame, *, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score`` for ``items`` of the columns item_id, terms and times."""
    spark = items.sparkSession
    total = items.agg(F.sum(F.aggregate("terms", F.lit(0).cast("bigint"), lambda a, t: a + F.octet_length(t) + 64) + 64).alias("n")).first().n or 0
    waves, out = max(1, -(-total // WAVE_BYTES)), None
    for w in range(waves):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(waves)) == w)
        asked = mine.toArrow()  # about WAVE_BYTES
        known = mine.select(F.explode("terms").alias("term")).distinct().join(index.frequencies, "term").toArrow()
        weights = {t: v for t, df in zip(known["term"].to_pylist(), known["df"].to_pylist()) if (v := weight(df, index.n_docs)) > 0}
        vectors = [{t: c * weights[t] for t, c in zip(terms, times) if t in weights} for terms, times in zip(asked["terms"].to_pylist(), asked["times"].to_pylist())]
        least = [1] * len(vectors)  # scores above 0
        if index.n_shards > SEED_FROM * SEED_SHARDS:
            few = index.shards.limit(SEED_SHARDS)  # for a lower bound of the k-th score; all shards are searched below
            held = spark.sparkContext.broadcast((vectors, least))
            first = few.mapInArrow(_search(held, k), "place int, doc_id bigint, score bigint").groupBy("place").agg(F.slice(F.sort_array(F.collect_list("score"), False), k, 1).alias("kth"))
            for r in first.collect():
                least[r.place] = max([1, *r.kth])
        held = spark.sparkContext.broadcast((vectors, least))
        found = index.shards.mapInArrow(_search(held, k), "place int, doc_id bigint, score bigint")
        rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "doc_id"))
        found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, v) for i, v in enumerate(asked["item_id"].to_pylist())], "place int, item_id bigint")
        found = found.join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score")  # as large as the wave
        if waves > 1:
            found = common.keep(found, "ranked")
            held.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def rank(docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` highest-scoring documents with a score above 0.

    Equal scores go by ascending id. A null or empty text has no terms and is no document;
    rows without an id take no part. Documents that share an id are ranked each; items that
    share one are answered each under it. Other columns are not read, whatever their names.
    """
    common.ship(docs.sparkSession)
    asked = items.select(F.col(item_col).cast("bigint").alias("item_id"), common.text_or_empty(F.col(item_text_col).cast("string")).alias("text")).filter("item_id IS NOT NULL")
    asked = common.keep(asked.mapInArrow(_read_items, "item_id bigint, terms array<binary>, times array<bigint>"), "items")
    index = build_index(docs, asked.select(F.explode("terms")), id_col=id_col, text_col=text_col)
    return search(index, asked, k=k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LOWER = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, ts, len(ts) AS n FROM (SELECT doc_id, {_LOWER} AS ts FROM documents) WHERE len(ts) > 0),
g AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_LOWER}) AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, sum(c * floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))))::BIGINT AS score
  FROM q JOIN df USING (term) JOIN tf USING (term), g GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
