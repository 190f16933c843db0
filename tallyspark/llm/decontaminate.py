"""Benchmark decontamination by greedy string tiling.

Runs of ``SEED`` words that a text shares with a test item are its seeds; only items whose
seeds could cover enough of them are tiled. Tiling marks the longest match of unmarked
words first, found by running Karp-Rabin hashes of both sides, and repeats with shorter
ones, so passages count in whatever order they stand. A text is contaminated by an item
if its tiles cover at least ``COVERAGE`` of the item's words.

The test set's seeds travel with the tasks in portions of a bounded size. Each portion is a
pass of its own over the texts, whose result is written before the next portion is
collected, so one portion at a time is held by the driver and the workers, however large
the test set is. No text is ever shuffled.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

#: Shortest tile in words, and the share of an item's words that tiles must cover.
SEED, COVERAGE = 4, 0.5
#: Bytes of test items in one portion.
PORTION_BYTES = 16 << 20

MATCHES = "array<struct<item_id:bigint,coverage:double,longest:int,n_tiles:int>>"


def _windows(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` tokens, each from the one before by prefix differences."""
    n = len(tokens)
    if n < size:
        return np.empty(0, np.uint64)
    power, inverse = common.powers(n + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(tokens * power[:n], dtype=np.uint64)])
        return (prefix[size:] - prefix[:-size]) * inverse[: n - size + 1]


def tile(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in text, words): longest first, then leftmost in the item, then in the text.

    Equal windows are never paired off: each of the item's takes the first of the text's
    that is still unmarked, so a length costs as much as both sides have windows, however
    often words repeat.
    """
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    size = min(len(item), len(text))
    while size >= least and (size := _longest(item, text, free_item, free_text, least, size)):
        tiles += _mark(item, text, free_item, free_text, size)
        size -= 1
    return tiles


def _unmarked(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows of ``size`` words none of which is marked."""
    c = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(c[size:] == c[:-size])


def _mark(item, text, free_item, free_text, size: int) -> list[tuple[int, int, int]]:
    """Mark the tiles of one length from left to right."""
    a, b = _unmarked(free_item, size), _unmarked(free_text, size)
    ha, hb = _windows(item, size)[a], _windows(text, size)[b]
    wanted = np.unique(ha)
    at = np.minimum(np.searchsorted(wanted, hb), len(wanted) - 1)
    met = wanted[at] == hb
    b, key = b[met], at[met]
    order = np.argsort(key, kind="stable")
    b, key = b[order], key[order]
    starts = np.searchsorted(key, np.arange(len(wanted) + 1)).tolist()
    nxt = starts[:-1]
    tiles, done = [], 0
    for i, k in zip(a.tolist(), np.searchsorted(wanted, ha).tolist()):
        if i < done:
            continue
        while nxt[k] < starts[k + 1] and not free_text[b[nxt[k]] : b[nxt[k]] + size].all():
            nxt[k] += 1  # marked words stay marked
        for j in b[nxt[k] : starts[k + 1]].tolist():
            if free_text[j : j + size].all() and (item[i : i + size] == text[j : j + size]).all():
                free_item[i : i + size] = False
                free_text[j : j + size] = False
                tiles.append((i, j, size))
                done = i + size
                break
    return tiles


def _longest(item, text, free_item, free_text, least: int, most: int) -> int:
    """The greatest length from ``least`` to ``most`` of which both sides have an equal unmarked window, else 0: windows that match at a length match at every shorter one, so it is found by halving."""

    def match(size: int) -> bool:
        a, b = _unmarked(free_item, size), _unmarked(free_text, size)
        if not len(a) or not len(b):
            return False
        wanted, hb = np.unique(_windows(item, size)[a]), _windows(text, size)[b]
        return bool((wanted[np.minimum(np.searchsorted(wanted, hb), len(wanted) - 1)] == hb).any())

    if not match(least):
        return 0
    low, high = least, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if match(mid) else (low, mid - 1)
    return low


class Items:
    """One portion of the test set: its items' words and where each seed stands."""

    def __init__(self, rows: list[tuple[int, str]], seed: int = SEED):
        self.seed = seed
        self.items = [(i, t) for i, text in rows if len(t := common.token_hashes(text or ""))]
        keys, owners, places = [], [], []
        for k, (_, t) in enumerate(self.items):
            h = _windows(t, min(seed, len(t))) if len(t) >= seed else np.empty(0, np.uint64)
            keys.append(h)
            owners.append(np.full(len(h), k))
            places.append(np.arange(len(h)))
        flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.owners = np.concatenate(owners)[order] if keys else np.empty(0, int)
        self.places = np.concatenate(places)[order] if keys else np.empty(0, int)
        self.keys, first = np.unique(flat[order], return_index=True)
        self.starts = np.concatenate([first, [len(flat)]])
        self.sizes = np.array([len(t) for _, t in self.items], int)
        # items shorter than a seed, by their number of words and hash
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, t) in enumerate(self.items):
            if len(t) < seed:
                self.short[len(t)][int(_windows(t, len(t))[0])].append(k)
        self.short = {n: dict(x) for n, x in self.short.items()}

    def match(self, text: str | None, coverage: float = COVERAGE) -> list[tuple[int, float, int, int]]:
        """(item_id, coverage, longest tile, tiles) of the items that contaminate the text."""
        words = common.token_hashes(text or "")
        seed, out = self.seed, []
        h = _windows(words, seed)
        if len(h) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == h)
        else:
            hit = np.empty(0, int)
        if len(hit):
            of_text = at[hit]
            # each seed once, however often the text has it
            found = np.unique(of_text)
            n = self.starts[found + 1] - self.starts[found]
            entry = np.repeat(self.starts[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            owner, place, key = self.owners[entry], self.places[entry], np.repeat(found, n)
            order = np.lexsort((place, owner))
            owner, place, key = owner[order], place[order], key[order]
            last = np.concatenate([owner[1:] != owner[:-1], [True]])
            under = np.where(last, seed, np.minimum(seed, np.diff(place, append=0)))
            first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            covered = np.add.reduceat(under, first)
            ends = np.append(first[1:], len(owner))
            for g in np.flatnonzero(covered >= coverage * self.sizes[owner[first]]):  # tiles lie within the seeds
                item_id, item = self.items[owner[first[g]]]
                own = np.zeros(len(found), bool)
                own[np.searchsorted(found, key[first[g] : ends[g]])] = True
                # only words under a seed can be in a tile; a gap keeps distant ones apart
                begin = hit[own[np.searchsorted(found, of_text)]]
                stretch = np.split(begin, np.flatnonzero(np.diff(begin) > seed) + 1)
                gap = np.zeros(1, np.uint64)
                island = np.concatenate([x for p in stretch for x in (words[p[0] : p[-1] + seed], gap)])
                tiles = tile(item, island, seed)
                total = sum(t[2] for t in tiles)
                if total >= coverage * len(item):
                    out.append((item_id, total / len(item), max(t[2] for t in tiles), len(tiles)))
        for n, known in self.short.items():  # items shorter than a seed must stand there whole
            for w in set(_windows(words, n).tolist()) & known.keys():
                out += [(self.items[k][0], 1.0, n, 1) for k in known[w]]
        return sorted(out)


def _portions(benchmark: DataFrame, item_col: str, item_text_col: str, portion_bytes: int) -> list[DataFrame]:
    """The items with an id and a text, in parts of about ``portion_bytes`` each."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("id"), F.col(item_text_col).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text") + 64).alias("n")).first().n or 0
    portions = max(1, -(-total // portion_bytes))
    return [items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(portions)) == p) for p in range(portions)]


class _Held:
    """One portion on the workers, until it is let go."""

    def __init__(self, portion: DataFrame, seed: int):
        rows = sorted((r.id, r.text) for r in portion.collect())  # about portion_bytes
        self.items = portion.sparkSession.sparkContext.broadcast(Items(rows, seed))

    def column(self, text: Column, coverage: float) -> Column:
        return _matcher(self.items, coverage)(text.cast("string"))

    def let_go(self) -> None:
        self.items.destroy()


def with_matches(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE, portion_bytes: int = PORTION_BYTES, into: str = "matches") -> DataFrame:
    """``docs`` with an array of the items each row is contaminated by (item_id, coverage, longest, n_tiles).

    Items with a null id, null text or no words contaminate nothing; one shorter than the
    seed counts if it stands in the text whole. A null text has no words. Items that repeat
    are reported as often. Existing columns stay, whatever their names, except ``into``.
    With several portions the table is written once for each but the last.
    """
    common.ship(docs.sparkSession)
    portions = _portions(benchmark, item_col, item_text_col, portion_bytes)
    out, text = docs, F.col(text_col)
    for p, portion in enumerate(portions):
        held = _Held(portion, seed)
        found = held.column(text, coverage)
        out = out.withColumn(into, found if p == 0 else F.concat(F.col(into), found))
        if len(portions) > 1:
            before, out = out, common.keep(out, "matches")
            held.let_go()
            if p:
                common.forget(before)
    return out.withColumn(into, F.array_sort(into)) if len(portions) > 1 else out


def _matcher(held, coverage: float):
    @F.pandas_udf(MATCHES)
    def match(texts: pd.Series) -> pd.Series:
        items = held.value
        return pd.Series([[{"item_id": i, "coverage": c, "longest": n, "n_tiles": k} for i, c, n, k in items.match(t, coverage)] for t in texts], dtype=object)

    return match


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE, portion_bytes: int = PORTION_BYTES) -> DataFrame:
    """``doc_id, item_id, coverage, longest, n_tiles``: one row for each text and item that contaminates it.

    With several portions each one's rows are written, never the texts.
    """
    common.ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    portions = _portions(benchmark, item_col, item_text_col, portion_bytes)
    out = None
    for portion in portions:
        held = _Held(portion, seed)
        rows = docs.select("doc_id", F.explode(held.column(F.col("text"), coverage)).alias("m")).select("doc_id", "m.item_id", "m.coverage", "m.longest", "m.n_tiles")
        if len(portions) > 1:
            rows = common.keep(rows, "contaminated")
            held.let_go()
        out = rows if out is None else out.unionByName(rows)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE, portion_bytes: int = PORTION_BYTES) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, every column as it was; with several portions what each one leaves is written."""
    common.ship(docs.sparkSession)
    portions = _portions(benchmark, item_col, item_text_col, portion_bytes)
    out = docs
    for p, portion in enumerate(portions):
        held = _Held(portion, seed)
        before, out = out, out.filter(F.size(held.column(F.col(text_col), coverage)) == 0)
        if len(portions) > 1:
            out = common.keep(out, "clean")
            held.let_go()
            if p:
                common.forget(before)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
