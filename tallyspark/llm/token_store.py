"""Token-id files: canonical length-limited Huffman codes over a whole corpus's counts.

A store is a folder with two tables. ``ids`` has one row per block: the block's
documents and their lengths, the packed code words, and the bit offset of every
``STEP``-th id, so a block is decoded alone and all its runs between checkpoints
are decoded side by side. ``code`` has one row: the code length of every id, from
which both sides derive the same canonical code.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
MAX_BITS = 16
STEP = 256
BLOCK_IDS = 1 << 18
#: Distinct white-space-free chunks whose ids a worker remembers.
CACHE = 300_000


# --- the code -----------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for unused ids."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    if n <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order]
    level, leaf_flags = leaves, []
    for _ in range(limit):
        leaf_flags.append(None)
        if len(leaf_flags) == 1:
            flags = np.ones(n, bool)
        else:
            merged = np.concatenate([leaves, packed])
            at = np.argsort(merged, kind="stable")
            level, flags = merged[at], at < n
        leaf_flags[-1] = flags
        packed = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    depth = np.zeros(n, np.int64)
    for flags in reversed(leaf_flags):
        k = int(flags[:take].sum())
        depth[:k] += 1
        take = 2 * (take - k)
    out[order] = depth
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical code words: by length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code, last = 0, 0
    for i in order[np.searchsorted(lengths[order], 1) :]:
        n = int(lengths[i])
        code <<= n - last
        codes[i] = code
        code, last = code + 1, n
    return codes


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``MAX_BITS`` bits: the id it starts with and that id's length."""
    ids = np.zeros(1 << MAX_BITS, np.uint32)
    bits = np.ones(1 << MAX_BITS, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = np.left_shift(1, MAX_BITS - lengths[order].astype(np.int64))
    total = int(span.sum())
    ids[:total] = np.repeat(order.astype(np.uint32), span)
    bits[:total] = np.repeat(lengths[order], span)
    return ids, bits


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' code words as bytes, most significant bit first, and the bit offset of every ``STEP``-th."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    total = int(ends[-1]) if len(ids) else 0
    words = (total + 31) // 32 + 2
    value = codes[ids].astype(np.uint64) << (np.uint64(64) - n.astype(np.uint64) - (at & 31).astype(np.uint64))
    k = at >> 5
    hi = np.bincount(k, weights=(value >> np.uint64(32)).astype(np.float64), minlength=words)
    lo = np.bincount(k + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
    packed = (hi[:words] + lo[:words]).astype(np.uint64).astype(">u4")
    return packed.tobytes()[: (total + 7) // 8], at[::STEP].astype(np.int64)


def unpack(data: bytes, n_ids: int, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids again: every run between checkpoints advances by one table look-up a step."""
    ids, bits = table
    raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    runs = len(checkpoints)
    out = np.zeros((STEP, runs), np.uint32)
    at = checkpoints.copy()
    last = n_ids - (runs - 1) * STEP if runs else 0
    for i in range(STEP if runs > 1 else last):
        if i == last:  # the last run is shorter
            at = at[: runs - 1]
        key = (window[at >> 3] >> (np.uint32(16) - (at & 7).astype(np.uint32))) & np.uint32(0xFFFF)
        out[i, : len(at)] = ids[key]
        at = at + bits[key]
    return out.T.reshape(-1)[:n_ids]


# --- encoding texts -----------------------------------------------------------------


#: Chunks with other characters than these, or with an added token in any case, go to the tokenizer as they stand.
_ODD = r"[^\t-\r -~\x{a1}-\x{ac}\x{ae}-\x{24f}]|\x{130}"
#: Bytes of texts that are encoded together.
_TEXT_BYTES = 8 << 20
#: Words of one call of the model, whose result takes some hundred bytes a word.
_WORDS = 20_000


def _byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in own)}


def word_pattern(settings: dict) -> str | None:
    """The pattern of a tokenizer's words if no word crosses ASCII white space and each stands alone, else None.

    So it is if texts are composed (NFC), white space unified and lower-cased, then cut into
    matches of the pattern, and words go to a byte-level BPE model that marks their ends.
    """
    normal = [(x.get("type"), x.get("pattern"), x.get("content")) for x in (settings.get("normalizer") or {}).get("normalizers", [])]
    cuts = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = settings["model"]
    # added tokens are sought in the text as it stands
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in settings.get("added_tokens", [])):
        return None
    if normal != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] or [x.get("type") for x in cuts] != ["Split", "ByteLevel"]:
        return None
    split, level = cuts
    if split.get("behavior") != "Removed" or not split.get("invert") or level.get("add_prefix_space") or level.get("use_regex"):
        return None
    if model.get("type") != "BPE" or not model.get("end_of_word_suffix") or model.get("unk_token") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
        return None
    pattern = split.get("pattern", {}).get("Regex")
    return pattern if pattern and not any(regex.search(pattern, c) for c in " \t\n\v\f\r") else None


class Encoder:
    """Ids of whole texts by a tokenizer.

    Where its settings say that words never cross ASCII white space, a text's ids are those
    of its chunks between white space, one after another. The distinct chunks of many texts
    are then looked up together, unknown ones are cut into words by the tokenizer's own
    pattern, and the distinct new words go to its model in one call. Chunks that are not
    plain, and all texts of other tokenizers, go through the whole tokenizer.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        path = common.vocabulary_path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.seen: dict[str, bytes] = {}
        pattern = word_pattern(settings)
        self.split = regex.compile(f"{pattern}|\n") if pattern else None
        if pattern:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = WhitespaceSplit()
            vocabulary_ = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary_.values()) + 1, bool)
            suffix = settings["model"]["end_of_word_suffix"]
            self.ends[[i for k, i in vocabulary_.items() if k.endswith(suffix)]] = True
            self.alphabet = _byte_alphabet()
            self.odd = "|".join([_ODD, *(f"(?i:{re.escape(t['content'])})" for t in settings.get("added_tokens", []))])

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids, as little-endian integers of ``dtype``."""
        if self.split is None:
            return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        # upper and lower case share an entry, but where composing letters depends on case
        chunks = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, self.odd), texts, pc.ascii_lower(texts)))
        flat = chunks.flatten().dictionary_encode()
        known = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.seen) > CACHE:
            self.seen.clear()
        values = list(map(self.seen.get, known))
        unknown = [i for i, v in enumerate(values) if v is None]
        if unknown:
            self._learn(flat.dictionary.take(pa.array(unknown, pa.int32())))
            for i in unknown:
                values[i] = self.seen[known[i]]
        width = int(self.dtype[-1])
        ids = np.frombuffer(b"".join(values), self.dtype)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // width
        starts = np.cumsum(sizes) - sizes
        at = flat.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        out = ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[at] - (ends - n), n)].tobytes()
        offsets = chunks.offsets.to_numpy()
        cuts = (np.concatenate([[0], ends])[offsets - offsets[0]] * width).tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]

    def _bytes(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _learn(self, chunks: pa.Array) -> None:
        """Remember the ids of new distinct chunks."""
        seen = self.seen
        odd = pc.match_substring_regex(chunks, self.odd)
        for c in chunks.filter(odd).to_pylist():
            seen[c] = self._bytes(self.tokenizer.encode(c, add_special_tokens=False).ids)
        plain = chunks.filter(pc.invert(odd))
        low = pc.utf8_lower(plain)
        letters = pc.utf8_is_alpha(low)
        alone = low.filter(letters).to_numpy(zero_copy_only=False).tolist()
        mixed = low.filter(pc.invert(letters)).to_numpy(zero_copy_only=False).tolist()
        # chunks of letters alone are words; all others are cut by one call
        cut: list[list[str]] = [[]]
        for w in self.split.findall("\n".join(mixed)):
            if w == "\n":
                cut.append([])
            else:
                cut[-1].append(w)
        new = dict.fromkeys(alone)
        new.update(dict.fromkeys(w for p in cut for w in p))
        words = [w for w in new if w not in seen]
        for i in range(0, len(words), _WORDS):
            self._learn_words(words[i : i + _WORDS])
        for c, p in zip(mixed, cut):
            seen[c] = b"".join([seen[w] for w in p])
        other = pc.not_equal(plain, low)
        for c, w in zip(plain.filter(other).to_pylist(), low.filter(other).to_pylist()):
            seen[c] = seen[w]

    def _learn_words(self, new: list[str]) -> None:
        """One call of the model for all words; its last piece of each carries the end mark."""
        if not new:
            return
        alphabet = self.alphabet
        forms = [w if w.isascii() else "".join([alphabet[b] for b in w.encode()]) for w in new]
        ids = np.array(self.model.encode_batch_fast([" ".join(forms)], add_special_tokens=False)[0].ids, self.dtype)
        width = int(self.dtype[-1])
        cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()]
        if len(cuts) != len(new) + 1:  # a piece of the vocabulary looks like an end within a word
            for w, f in zip(new, forms):
                self.seen[w] = self._bytes([t.id for t in self.tokenizer.model.tokenize(f)])
            return
        raw = ids.tobytes()
        for w, a, b in zip(new, cuts, cuts[1:]):
            self.seen[w] = raw[a:b]


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> Encoder:
    """One for a Python worker, whichever tasks it runs."""
    return Encoder(vocabulary)


def _encode(vocabulary: str, end_id: int):
    """(doc_id, key, n, ids) of each text, its end id appended; then (id, null, count, null) of all ids the task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        dtype = encoder.dtype
        end = np.array([end_id], dtype).tobytes()
        counts = np.zeros(max(encoder.tokenizer.get_vocab_size(), end_id + 1), np.int64)
        for part in common.grouped(batches, 1, _TEXT_BYTES):
            ids = [x + end for x in encoder(part.column(1))]
            counts += np.bincount(np.frombuffer(b"".join(ids), dtype), minlength=len(counts))
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // int(dtype[-1])
            # spreads rows that share an id; equal ids of tokens share it
            key = np.fromiter(map(zlib.crc32, ids), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "key", "n", "ids"])
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.nulls(len(used), pa.int64()), pa.array(counts[used]), pa.nulls(len(used), pa.binary())], ["doc_id", "key", "n", "ids"])

    return run


def _write_blocks(lengths: bytes, dtype: str):
    lengths_ = np.frombuffer(lengths, np.uint8)
    width = int(dtype[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths_)
        held: list[tuple[int | None, bytes]] = []
        part, first, size = None, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), dtype)
            data, at = pack(ids, lengths_, codes)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([first], pa.int64()), pa.array([[d for d, _ in held]], pa.list_(pa.int64())), pa.array([[len(x) // width for _, x in held]], pa.list_(pa.int64())), pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                ["part", "block", "doc_ids", "doc_lengths", "checkpoints", "data"],
            )

        for batch in batches:
            for p, doc_id, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if size >= BLOCK_IDS:
                    yield flush()
                    first += len(held)
                    held, size = [], 0
                part = p
                held.append((doc_id, ids))
                size += len(ids) // width
        if held:
            yield flush()

    return run


BLOCK_SCHEMA = "part bigint, block bigint, doc_ids array<bigint>, doc_lengths array<bigint>, checkpoints array<bigint>, data binary"


def write_ids(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encode every whole text, append ``end_id`` and write the ids in ascending ``id_col`` order below ``path``.

    A null or empty text is its end id alone. Null ids come first; rows that share an
    id stand next to each other, ordered by a checksum of their ids, then the ids. Other
    columns are not read. Texts are encoded where they are read; only ids are dealt, by
    ranges of document id and checksum, so each part's documents are consecutive and rows
    that share an id may fill several parts. The counts that leave a task are bounded by
    the vocabulary, which may have at most 65,536 ids in use.
    """
    spark = docs.sparkSession
    common.ship(spark)
    dtype = _encoder(vocabulary).dtype
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), common.text_or_empty(F.col(text_col).cast("string")).alias("text"))
    encoded = common.keep(rows.mapInArrow(_encode(vocabulary, end_id), "doc_id bigint, key bigint, n bigint, ids binary"), "ids")
    counts = encoded.filter("key IS NULL").groupBy("doc_id").agg(F.sum("n").alias("n")).toArrow()  # at most one row per id of the vocabulary
    by_id = np.zeros(max(_encoder(vocabulary).tokenizer.get_vocab_size(), end_id + 1), np.int64)
    by_id[counts["doc_id"].to_numpy()] = counts["n"].to_numpy()
    lengths = code_lengths(by_id).tobytes()
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("key").asc()]
    dealt = encoded.filter("key IS NOT NULL").select("doc_id", "key", "ids").repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids")
    blocks = dealt.select(F.spark_partition_id().cast("bigint").alias("part"), "doc_id", "ids").mapInArrow(_write_blocks(lengths, dtype), BLOCK_SCHEMA)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/ids")
    common.forget(encoded)


def _read(lengths: bytes):
    lengths_ = np.frombuffer(lengths, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths_, canonical(lengths_))
        for batch in batches:
            for row in batch.to_pylist():
                sizes = row["doc_lengths"]
                ids = unpack(row["data"], sum(sizes), np.array(row["checkpoints"], np.int64), table).astype("<u4")
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int64()), pa.array([row["block"]] * n, pa.int64()), pa.array(cuts[:-1].tolist(), pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    ["part", "block", "at", "doc_id", "ids"],
                )

    return run


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``part, block, at, doc_id, ids``: each document's ids as little-endian 32-bit integers."""
    common.ship(spark)
    code = spark.read.parquet(f"{path}/code").first()
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/ids").mapInArrow(_read(bytes(code.lengths)), "part bigint, block bigint, at bigint, doc_id bigint, ids binary")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(4).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(4)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
            ["part", "block", "at", "doc_id", "n_tokens", "ids_crc32"],
        )


def id_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of a store; ``start`` counts the ids of all documents before.

    Only the sizes of blocks (one row for about ``BLOCK_IDS`` ids) are ordered globally.
    """
    from pyspark.sql import Window

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/ids").select("part", "block", F.aggregate("doc_lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    starts = blocks.withColumn("inner", F.coalesce(F.sum("n").over(in_part), F.lit(0))).join(before, "part").select("part", "block", (F.col("base") + F.col("inner")).alias("block_start"))
    read = read_ids(spark, path).mapInArrow(_digest, "part bigint, block bigint, at bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(starts, ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-store")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return id_digests(spark, path)
