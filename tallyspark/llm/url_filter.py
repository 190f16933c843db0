"""URL verdicts: longest-match rules, then exact list membership by a Bloom filter cascade.

Level 1 encodes the listed keys, level 2 the unlisted keys of the universe that level 1
lets pass, level 3 the listed keys that level 2 lets pass, and so on until nothing wrong
passes. For every key of the universe the cascade then answers exactly, and pages need
no join: the filters travel with the task. Keys whose cascade could pass ``MAX_BYTES`` are
parted by hash into several cascades, each of which is built, asked and let go before the
next one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

#: (verdict, host, path prefix)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The query's list: hosts with one of these in a label.
LISTED_WORDS = ["casino", "pills", "bets", "ads-track"]
MAX_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null; ties go to the smaller rule."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


# --- the cascade --------------------------------------------------------------------


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray  # uint64

    @staticmethod
    def shape(n: int, p: float) -> tuple[int, int]:
        """Bits and hash functions for ``n`` keys at a false positive rate ``p``."""
        bits = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
        return bits, max(1, round(bits / max(n, 1) * math.log(2))) if n else 1


def positions(a: np.ndarray, b: np.ndarray, level: int, i: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = np.uint64((level * 0x9E3779B97F4A7C15 + i * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)
        return common.mix(common.mix(a ^ seed) + b * np.uint64(2 * i + 1)) % np.uint64(bits)


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def passed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many levels, from the first, let each key pass."""
        out = np.zeros(len(a), np.int32)
        live = np.arange(len(a))
        for n, level in enumerate(self.levels):
            x, y = a[live], b[live]
            ok = np.ones(len(live), bool)
            for i in range(level.hashes):
                at = positions(x, y, n, i, level.bits)
                ok &= (level.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            live = live[ok]
            out[live] = n + 1
        return out

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Stopped before an even level (the second, ...), a key is listed."""
        return self.passed(a, b) % 2 == 1

    def nbytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)

    def column(self, key: Column) -> Column:
        """Membership of a key column (a null key is not listed)."""
        levels = [(x.bits, x.hashes, x.words) for x in self.levels]

        @F.pandas_udf("boolean")
        def contains(a: pd.Series, b: pd.Series) -> pd.Series:
            own = Cascade([Level(*x) for x in levels])
            return pd.Series(own.contains(a.to_numpy(np.int64).view(np.uint64), b.to_numpy(np.int64).view(np.uint64)))

        return F.when(key.isNull(), False).otherwise(contains(*_hashes(F.coalesce(key, F.lit("")))))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.concat(F.lit("#"), key))


def _encode(keys: DataFrame, n: int, p: float, level: int) -> Level:
    """The filter of ``n`` keys: each batch sets bits, equal words of the filter are or-ed by Spark."""
    bits, hashes = Level.shape(n, p)

    def run(batches):
        for pdf in batches:
            a, b = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("a", "b"))
            at = np.unique(np.concatenate([positions(a, b, level, i, bits) for i in range(hashes)]))
            word, start = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start) if len(at) else at
            yield pd.DataFrame({"word": word.astype(np.int64), "bits": value.view(np.int64)})

    rows = keys.select("a", "b").mapInPandas(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64 + 1, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Level(bits, hashes, words)


def _keys(universe: DataFrame, key_col: str, listed_col: str) -> DataFrame:
    """``a, b, listed`` of every distinct key, kept."""
    common.ship(universe.sparkSession)
    keys = universe.select(F.col(key_col).cast("string").alias("key"), F.coalesce(F.col(listed_col), F.lit(False)).alias("listed")).filter("key IS NOT NULL")
    a, b = _hashes(F.col("key"))
    return common.keep(keys.groupBy("key").agg(F.max("listed").alias("listed")).select(a.alias("a"), b.alias("b"), "listed"), "url-keys")


def _sizes(keys: DataFrame) -> tuple[int, int]:
    n = {r.listed: r.n for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    return n.get(True, 0), n.get(False, 0)


def _first_rate(listed: int, others: int) -> float:
    """The first level leaves about as many false positives as listed keys."""
    return min(0.5, listed / (math.sqrt(2) * others)) if listed and others else 0.5


def expected_bytes(listed: int, others: int) -> int:
    """What a cascade takes at most: its first level, and as much again as halving levels of as many keys."""
    first = Level.shape(listed, min(_first_rate(listed, others), 1e-4 if listed <= 10_000 else 1.0))[0]
    return (first + 4 * Level.shape(max(listed, 10_000), 0.5)[0]) // 8


def _build(keys: DataFrame) -> Cascade:
    listed, others = _sizes(keys)
    levels: list[Level] = []
    turn, left = True, listed
    wrong = keys.filter("listed")
    while left or not levels:
        # later levels halve what is left; small sets get sharper ones
        p = _first_rate(listed, others) if not levels else 0.5
        levels.append(_encode(wrong, left, min(p, 1e-4) if left <= 10_000 else p, len(levels)))
        turn = not turn
        # wrong: keys of the other kind that pass every level so far
        wrong = keys.filter(F.col("listed") == turn).mapInPandas(_passing([(x.bits, x.hashes, x.words) for x in levels]), "a bigint, b bigint")
        left, before = wrong.count(), left
        if left and left == before and len(levels) > 200:
            raise ValueError(f"{left} keys cannot be told from others: they share 128 bits of hash")
    return Cascade(levels)


def build_cascade(universe: DataFrame, *, key_col: str = "key", listed_col: str = "listed") -> Cascade:
    """One cascade that is exact on every key of ``universe`` (repeats allowed; listed if any row says so; null keys are left out)."""
    return _build(_keys(universe, key_col, listed_col))


def with_listed(rows: DataFrame, key: Column, universe: DataFrame, *, into: str = "listed", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``rows`` with whether ``universe(key, listed)`` lists their key (a null key is not listed).

    Beyond ``max_bytes`` the keys are parted by hash. Each part is a pass over the rows,
    whose answers are written before the next part's cascade is built.
    """
    keys = _keys(universe, "key", "listed")
    parts = max(1, -(-expected_bytes(*_sizes(keys)) // max_bytes))
    if parts == 1:
        return rows.withColumn(into, _build(keys).column(key))
    part = F.pmod(F.xxhash64(F.lit(7), F.coalesce(key, F.lit(""))), F.lit(parts))
    # a part's keys are told by a hash of the key; both hashes of a key name its part
    own = F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(parts))
    whole = universe.select(F.col("key").cast("string").alias("key"), "listed").filter("key IS NOT NULL").withColumn("part", own)
    out = rows.withColumn(into, F.lit(False))
    for p in range(parts):
        cascade = _build(_keys(whole.filter(F.col("part") == p), "key", "listed"))
        before, out = out, common.keep(out.withColumn(into, F.when(part == p, cascade.column(F.when(part == p, key))).otherwise(F.col(into))), "listed")
        if p:
            common.forget(before)
    return out


def _passing(levels):
    def run(batches):
        own = Cascade([Level(*x) for x in levels])
        for pdf in batches:
            a, b = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("a", "b"))
            yield pdf.loc[own.passed(a, b) == len(levels), ["a", "b"]]

    return run


def judge_urls(pages: DataFrame, listed: Column | DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` of every row.

    ``listed`` is the list: a table whose first column holds host names (case is ignored;
    nulls and repeats count for nothing), or a predicate on a ``host`` column. The cascade is
    built over the distinct hosts of all pages, which alone meet the list, and is then asked
    for every page. The longest fitting rule decides; without one a listed host is blocked,
    any other allowed. A null url or one without ``://`` has an empty host and path, which
    no rule fits. Rows that repeat are judged one by one.
    """
    common.ship(pages.sparkSession)
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = rows.select("host").groupBy("host").agg(F.lit(1).alias("one"))
    if isinstance(listed, DataFrame):
        names = listed.select(F.translate(F.col(listed.columns[0]).cast("string"), UPPER, LOWER).alias("name")).filter("name IS NOT NULL").distinct().withColumn("there", F.lit(True))
        universe = hosts.join(names, F.col("host") == F.col("name"), "left").select(F.col("host").alias("key"), F.coalesce("there", F.lit(False)).alias("listed"))
    else:
        universe = hosts.select(F.col("host").alias("key"), listed.alias("listed"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    rows = with_listed(rows, F.col("host"), universe, max_bytes=max_bytes)
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def listed_words(host: Column, words=LISTED_WORDS) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | host.contains(w)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed_words(F.col("host")))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r AS (SELECT *, contains(host, 'casino') OR contains(host, 'pills') OR contains(host, 'bets') OR contains(host, 'ads-track') AS listed,
  CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
  FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""
