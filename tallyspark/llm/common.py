"""What the training-data operators share: scratch tables, token hashing.

Scratch tables are Parquet below the folder that ``spark.checkpoint.dir`` names, so
they are visible to every executor and outlive the loss of any of them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import shipping
from tallyspark.shared import keep, new_path, shared_dir

__all__ = ["keep", "new_path", "shared_dir"]

def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`keep` that nothing reads any more."""
    spark = df.sparkSession
    for f in {p.rpartition("/")[0] for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        if "/tallyspark/" in f:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Texts of one Arrow batch; with Spark's default of 10,000, long texts make batches of hundreds of MB on both sides.
BATCH_ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Make the package known to executors, and keep the batches of texts sent to Python small unless the session says otherwise."""
    shipping.ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def grouped(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches whose texts have about ``limit`` bytes together, one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        at, done = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, done + limit - size, side="right")))
            held.append(batch.slice(at, end - at))
            size += int(sizes[end - 1]) - done
            at, done = end, int(sizes[end - 1])
            if at < batch.num_rows or size >= limit:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer file lies; the folder can be set by TOKENIZERS_DIR."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


# --- token hashing ---------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))
_SEGMENT = 1 << 20


def _classes(punct: bool) -> np.ndarray:
    """0: white space and control bytes, 1: letters, digits, _ and all bytes over 127, 2: the rest."""
    c = np.full(256, 2 if punct else 0, np.uint8)
    c[:33] = 0
    c[128:] = 1
    for a, b in ((48, 58), (65, 91), (97, 123), (95, 96)):
        c[a:b] = 1
    return c


_WORDS, _WORDPUNCT = _classes(False), _classes(True)
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant mod 2^64 and of its inverse, ``n`` at least."""
    global _POW, _IPOW
    if len(_POW) < n:
        m = 1 << max(12, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, _ODD)]), dtype=np.uint64)
            _IPOW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, _INV)]), dtype=np.uint64)
    return _POW, _IPOW


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_hashes(text: str, punct: bool = False) -> np.ndarray:
    """64-bit hashes of the lower-cased text's words, in order (``punct``: of runs of punctuation too).

    Word bytes are folded into a polynomial whose prefix sums give every word at once,
    so no Python object is made per word. Long texts go in segments cut at white space.
    """
    data = text.lower().encode("utf-8", "surrogatepass")
    if len(data) <= _SEGMENT:
        return _hashes(data, punct)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _SEGMENT)
        if end < len(data):
            cut = data.rfind(b" ", at + 1, end)
            end = cut if cut > 0 else (nxt if (nxt := data.find(b" ", end)) > 0 else len(data))
        parts.append(_hashes(data[at:end], punct))
        at = end
    return np.concatenate(parts)


def _hashes(data: bytes, punct: bool) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    c = (_WORDPUNCT if punct else _WORDS)[b]
    turn = np.flatnonzero(np.diff(c)) + 1
    starts = np.concatenate([[0], turn])
    ends = np.concatenate([turn, [len(b)]])
    word = c[starts] > 0
    starts, ends = starts[word], ends[word]
    if not len(starts):
        return np.empty(0, np.uint64)
    pw, ipw = powers(len(b) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * pw[: len(b)], dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * ipw[starts])


def ngram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` tokens."""
    if len(tokens) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(tokens) - n + 1, np.uint64)
        for i in range(n):
            h = h * _ODD + tokens[i : len(tokens) - n + 1 + i]
        return mix(h + np.uint64(n))


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words.

    A text of fewer words has one shingle, all of them; one without words but with
    other characters has its stripped self; an empty or null one has none.
    """
    text = text or ""
    words = token_hashes(text)
    if len(words) >= n:
        return np.unique(ngram_hashes(words, n))
    if len(words):
        return ngram_hashes(words, len(words))
    rest = text.strip()
    if not rest:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(rest.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    return ngram_hashes(raw, len(raw)) if len(raw) <= 64 else np.array([hash_bytes(rest)], np.uint64)


def hash_bytes(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
