"""Cross-tokenizer alignment by label strings.

Two tokenizers' tokens are laid over the bytes of one text. A string with one label a byte
says where tokens end: none, A, B or both. A regular expression cuts it into spans up to
each both-label; the labels of a span count the tokens of one group, the smallest runs of
A and B tokens that hold the same bytes. Between two neighbouring labels lies exactly one
A and one B token, so every label but none is one link.

Texts are encoded once; both tokenizers' ids are kept and all else comes from them and from
the tokens' sizes. Neither vocabulary has a piece with white space behind other characters,
so texts are cut where white space follows something else, and a worker encodes the distinct
chunks that are new to it in one call. A pair of vocabularies that breaks this rule encodes
whole texts.

How often two ids are linked in the whole corpus is summed from the tasks' partial counts.
The most frequent pairs (``HEAD``, a bound whatever the corpus) travel with the tasks; the
occurrences of all others, none of which is frequent, are joined with the table of counts.
No text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import common

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts travel with the tasks: 16 bytes each.
HEAD = 1 << 20
#: Chunks that a worker remembers, and pairs whose counts a task holds.
CACHE, HELD_PAIRS = 300_000, 1 << 20
#: Bytes of texts in one round, characters of a long text's part, and labels cut into groups at a time.
_TEXT_BYTES, _PART, _LABELS = 4 << 20, 1 << 20, 1 << 20

#: Texts are cut before white space (to both tokenizers, so without 1C to 1F) that follows other
#: characters, but not before a carriage return, with which pieces may end.
_W, _N = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
_CUT = re.compile(rf"(?<={_N})(?!\r){_W}")
_CHUNK = re.compile(rf"{_W}*{_N}+(?:\r{_W}*(?:{_N}+|\Z))*|{_W}+\Z")
#: Up to each label 3 (an end of both): labels 0 (no end), 1 (of A) and 2 (of B) come before it.
_GROUP = re.compile(rb"[\x00-\x02]*\x03")
_SPACE = "▁"


class Tokenizers:
    """Both tokenizers, and the bytes of each token."""

    def __init__(self, vocabulary_a: str, vocabulary_b: str):
        import json

        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        from tallyspark.llm.token_store import _byte_alphabet

        path = common.vocabulary_path(vocabulary_a)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        alphabet = {c: b for b, c in _byte_alphabet().items()}
        names = settings["model"]["vocab"]
        self.bytes_a = [b""] * (max(names.values(), default=-1) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        self._a = self._plain(settings, tiktoken)
        if self._a is None:
            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            self._a = lambda text: whole.encode(text, add_special_tokens=False).ids
        b = sentencepiece.SentencePieceProcessor(model_file=common.vocabulary_path(vocabulary_b))
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self._b, self.space_b = (lambda text: b.encode(text, num_threads=1)), b.piece_to_id(_SPACE)
        # no piece crosses a cut, or joins the space in front with other white space
        self.by_chunk = not any(_CUT.search(p.replace(_SPACE, " ")) or re.search(rf"{_SPACE}[^\S \r]", p) for p in pieces) and self._keeps_text(b)
        self.size_a = np.fromiter(map(len, self.bytes_a), np.int64, len(self.bytes_a))
        self.size_b = np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))

    def _plain(self, settings: dict, tiktoken):
        """The same byte-level merges by the faster library, if the file's settings are those that it knows; else None."""
        level, model = settings.get("pre_tokenizer") or {}, settings["model"]
        if settings.get("normalizer") or level.get("type") != "ByteLevel" or level.get("add_prefix_space") or not level.get("use_regex", True):
            return None
        if model.get("type") != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        added = {t["content"] for t in settings.get("added_tokens", [])}
        ranks = {self.bytes_a[i]: i for name, i in model["vocab"].items() if name not in added}
        # ids are ranks if every merge makes the next id
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(ranks) != 256 + len(merges):
            return None
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def _keeps_text(b) -> bool:
        """Whether the second model leaves texts as they are, but for spaces and the one it adds in front."""
        odd = " a  b\tc\nééﬁ　\x07 "
        return b.decode(b.encode(odd)) == odd and b.encode(odd, out_type=str)[0].startswith(_SPACE)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Both tokenizers' ids of a text that starts with white space; the second puts a space in front by itself."""
        if text == " ":
            b = [self.space_b]
        elif text[0] == " ":
            b = self._b(text[1:])
        else:
            b = self._b(text)[1:]
        return np.array(self._a(text), np.int64), np.array(b, np.int64)


def labels(ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
    """One byte for each byte of the text: 0, or the sum of 1 where an A token ends and 2 where a B token does."""
    out = np.zeros(int(ends_a[-1]) if len(ends_a) else 0, np.uint8)
    out[ends_a - 1] = 1
    out[ends_b - 1] += 2
    return out.tobytes()


class _Spans(dict):
    """A number for each kind of span met, and the kinds' numbers of A and B tokens."""

    def __init__(self):
        self.counts: list[tuple[int, int]] = []
        self.held = np.empty((0, 2), np.int64)

    def __missing__(self, span: bytes) -> int:
        n = (span.count(b"\x01") + 1, span.count(b"\x02") + 1)
        if len(self) < CACHE and len(span) < 64:
            self[span] = len(self.counts)
        self.counts.append(n)
        return len(self.counts) - 1


def groups(label: bytes, spans: _Spans | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and of B tokens up to each both-label."""
    spans = _Spans() if spans is None or len(spans.counts) > 4 * CACHE else spans
    found = _GROUP.findall(label)
    at = np.fromiter(map(spans.__getitem__, found), np.int64, len(found))
    if len(spans.held) < len(spans.counts):
        spans.held = np.array(spans.counts, np.int64)
    return spans.held[at, 0], spans.held[at, 1]


def links(label: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a << 32 | b`` for each pair of tokens that share bytes, in order: one up to each label."""
    x = np.frombuffer(label, np.uint8)
    x = x[x > 0]
    in_a, in_b = x & 1, x >> 1
    return a[np.cumsum(in_a) - in_a] << 32 | b[np.cumsum(in_b) - in_b]


class _Known:
    """Chunks and their ids of A and of B, one chunk after another."""

    def __init__(self, dtype: str):
        self.at: dict[str, int] = {}
        self.bad: set[int] = set()  # the tokens' bytes are not the chunk's
        self.ids = [np.empty(0, dtype), np.empty(0, dtype)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def add(self, chunks: list[str], sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``sides``: all ids, and each chunk's number of them."""
        self.at.update(zip(chunks, range(len(self.at), len(self.at) + len(chunks))))
        for k, (ids, n) in enumerate(sides):
            self.ids[k] = np.concatenate([self.ids[k], ids.astype(self.ids[k].dtype)])
            self.ends[k] = np.concatenate([self.ends[k], self.ends[k][-1] + np.cumsum(n)])

    def take(self, codes: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        first, n = self.ends[side][codes], np.diff(self.ends[side])[codes]
        ends = np.cumsum(n)
        return self.ids[side][np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], n


class Encoder:
    """Both tokenizers' ids of texts, by the chunks met so far."""

    def __init__(self, vocabulary_a: str, vocabulary_b: str):
        self.t = Tokenizers(vocabulary_a, vocabulary_b)
        self.dtype = "<u2" if max(len(self.t.bytes_a), len(self.t.bytes_b)) <= 1 << 16 else "<u4"
        # chunks met lately, and those before them
        self.known, self.old = _Known(self.dtype), _Known(self.dtype)

    def parts(self, text: str) -> Iterator[list[str]]:
        """The text behind its space in chunks, so many at a time as ``_PART`` characters hold."""
        text = " " + text
        if not self.t.by_chunk:
            yield [text]
            return
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > _PART and (m := _CUT.search(text, at + _PART)):
                end = m.start()
            yield _CHUNK.findall(text[at:end])
            at = end

    def __call__(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids as little-endian integers of ``dtype``; none where a text is empty or tokens do not hold its bytes."""
        if len(self.known.at) > CACHE:
            self.known, self.old = _Known(self.dtype), self.known
        chunks = [[c for part in self.parts(t) for c in part] if t else [] for t in texts]
        known, old = self.known, self.old
        new = set(chain.from_iterable(chunks)).difference(known.at)
        again = [c for c in new.intersection(old.at) if old.at[c] not in old.bad]
        codes = np.fromiter(map(old.at.__getitem__, again), np.int64, len(again))
        known.add(again, [old.take(codes, k) for k in range(2)])
        self._learn(list(new.difference(again)))
        ends = np.cumsum([len(x) for x in chunks])
        codes = np.fromiter(map(known.at.__getitem__, chain.from_iterable(chunks)), np.int64, int(ends[-1]) if len(ends) else 0)
        spoilt = set(np.searchsorted(ends, np.flatnonzero(np.isin(codes, list(known.bad))), side="right").tolist()) if known.bad else ()
        out = []
        for k in range(2):
            ids, n = known.take(codes, k)
            cuts = (np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends]).astype(np.int64)] * ids.itemsize).tolist()
            data = ids.tobytes()
            out.append([b"" if i in spoilt else data[x:y] for i, (x, y) in enumerate(zip(cuts, cuts[1:]))])
        return list(zip(*out))

    def _learn(self, new: list[str]) -> None:
        # chunks encode behind one another as they do alone; what ends with white space stands last in its text
        some = [c for c in new if not c[-1].isspace()] if self.t.by_chunk else []
        at, size = 0, 0
        for end, c in enumerate([*some, None]):
            size += 0 if c is None else len(c)
            if end > at and (c is None or size > _PART):
                self._add(some[at:end], " x")
                at, size = end, 0 if c is None else len(c)
        for c in new:
            if c not in self.known.at and not self._add([c]):
                self.known.bad.add(len(self.known.at))
                self.known.add([c], [(np.empty(0, np.int64), np.zeros(1, np.int64))] * 2)

    def _add(self, chunks: list[str], lead: str = "") -> bool:
        """Encode the chunks as one text, behind ``lead``; False if tokens' bytes are not its own."""
        joined, t, sides = lead + "".join(chunks), self.t, []
        raw = joined.encode()
        ends = len(lead) + np.cumsum([len(c.encode()) for c in chunks])
        for ids, table, size in zip(t(joined), (t.bytes_a, t.bytes_b), (t.size_a, t.size_b)):
            if b"".join(map(table.__getitem__, ids.tolist())) != raw:
                return False
            cuts = np.searchsorted(np.cumsum(size[ids]), [len(lead), *ends], side="right")
            sides.append((ids[cuts[0] :], np.diff(cuts)))
        self.known.add(chunks, sides)
        return True


@lru_cache(maxsize=1)
def _encoder(vocabulary_a: str, vocabulary_b: str) -> Encoder:
    """One for a Python worker, whichever tasks it runs."""
    return Encoder(vocabulary_a, vocabulary_b)


def _encode(vocabulary_a: str, vocabulary_b: str):
    """(id, digest, ids of A, ids of B) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary_a, vocabulary_b)
        for batch in common.grouped(batches, 1, _TEXT_BYTES):
            ids = encoder(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, pa.binary()) for x in zip(*ids))], ["id", "digest", "ids_a", "ids_b"])

    return run


def _overlaid(encoder: Encoder, a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Both sides' ids of one or more texts, and the label string over their bytes."""
    a, b = (np.frombuffer(x, encoder.dtype).astype(np.int64) for x in (a, b))
    t = encoder.t
    return a, b, labels(np.cumsum(t.size_a[a]), np.cumsum(t.size_b[b]))


def _count(vocabulary_a: str, vocabulary_b: str):
    """(pair, n) of all links that the task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary_a, vocabulary_b)
        pairs, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in common.grouped(batches, 0, _TEXT_BYTES):
            # texts' bytes end on both sides, so those of a round are laid out as one
            a, b, label = _overlaid(encoder, *(b"".join(batch.column(i).to_pylist()) for i in range(2)))
            keys, n = np.unique(links(label, a, b), return_counts=True)
            pairs, inverse = np.unique(np.concatenate([pairs, keys]), return_inverse=True)
            sums = np.bincount(inverse, weights=np.concatenate([sums, n]), minlength=len(pairs)).astype(np.int64)
            if len(pairs) >= HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(sums)], ["pair", "n"])
                pairs, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(sums)], ["pair", "n"])

    return run


class Names:
    """Each id with what follows it: the next id of its side, the other side, or the next group."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a, self.n_b = n_a, n_b
        self.table = [f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)]

    def written(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> str:
        """The groups of so many A and B ids each: ``a1,a2|b1;a3|b2,b3``."""
        ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
        of_a, of_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        out = np.empty(len(a) + len(b), np.int64)
        last = np.zeros(len(a), bool)
        last[ends_a - 1] = True
        out[np.arange(len(a)) + (ends_b - n_b)[of_a]] = a + self.n_a * last
        last = np.zeros(len(b), bool)
        last[ends_b - 1] = True
        out[np.arange(len(b)) + ends_a[of_b]] = 2 * self.n_a + b + self.n_b * last
        return "".join(map(self.table.__getitem__, out.tolist()))[:-1]


@lru_cache(maxsize=1)
def _names(vocabulary_a: str, vocabulary_b: str) -> Names:
    t = _encoder(vocabulary_a, vocabulary_b).t
    return Names(len(t.bytes_a), len(t.bytes_b))


class Head:
    """The counts of the most frequent pairs."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table["pair"].to_numpy())
        self.pair = table["pair"].to_numpy()[order]
        self.n = table["n"].to_numpy()[order]
        self.best = table["best"].to_numpy(zero_copy_only=False)[order]

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, whether highest of its B id, whether known."""
        if not len(self.pair):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        known = self.pair[at] == pairs
        return np.where(known, self.n[at], 0), known & self.best[at], known


def _align(vocabulary_a: str, vocabulary_b: str, head):
    """(id, digest, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, by what the head knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names, top = _encoder(vocabulary_a, vocabulary_b), _names(vocabulary_a, vocabulary_b), head.value
        spans = _Spans()
        for batch in common.grouped(batches, 2, _TEXT_BYTES):
            numbers, strings = [], []
            for raw_a, raw_b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b, label = _overlaid(encoder, raw_a, raw_b)
                written, n_groups, at, i, j = [], 0, 0, 0, 0
                while at < len(label):  # a long text in parts, each up to a both-label
                    end = len(label) if len(label) - at <= _LABELS else label.index(b"\x03", at + _LABELS) + 1
                    n_a, n_b = groups(label[at:end], spans)
                    to_a, to_b = i + int(n_a.sum()), j + int(n_b.sum())
                    written.append(names.written(a[i:to_a], b[j:to_b], n_a, n_b))
                    n_groups, at, i, j = n_groups + len(n_a), end, to_a, to_b
                link = links(label, a, b)
                n, best, _ = top.look_up(link)
                numbers.append((len(a), len(b), n_groups, len(link), int(best.sum()), int(n.sum())))
                strings.append(";".join(written))
            m = np.array(numbers, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(m[:, i]) for i in range(6)), pa.array(strings, pa.string())], ["id", "digest", *_COLUMNS])

    return run


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def _rest(vocabulary_a: str, vocabulary_b: str, head):
    """(id, digest, pair, times) of the links that the head does not know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, top = _encoder(vocabulary_a, vocabulary_b), head.value
        for batch in batches:
            for i, (raw_a, raw_b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                a, b, label = _overlaid(encoder, raw_a, raw_b)
                pairs, times = np.unique(links(label, a, b), return_counts=True)
                missing = ~top.look_up(pairs)[2]
                k = int(missing.sum())
                if k:
                    same = pa.array([i] * k)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(pairs[missing]), pa.array(times[missing])], ["id", "digest", "pair", "times"])

    return run


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """``id, digest, ids_a, ids_b`` of each row, written once; the digest is the text's."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), common.text_or_empty(F.col(text_col).cast("string")).alias("text"))
    return common.keep(rows.withColumn("digest", F.md5("text")).mapInArrow(_encode(vocabulary_a, vocabulary_b), "id bigint, digest string, ids_a binary, ids_b binary"), "ids")


def pair_counts(encoded: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """``pair, a, b, n, best``: how many links of all texts hold each pair of ids; ``best``: no other A id has more with this B id. Written once."""
    counts = encoded.select("ids_a", "ids_b").mapInArrow(_count(vocabulary_a, vocabulary_b), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    # a B id has at most as many rows as the A vocabulary has ids
    counts = counts.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))})
    most = F.max("n").over(Window.partitionBy("b"))
    return common.keep(counts.select("pair", "a", "b", "n", (F.col("n") == most).alias("best")), "pairs")


def align(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, head: int = HEAD) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``, one row for each row of ``docs``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of each group. A link is a pair of an A and
    a B token that share bytes; ``n_best`` counts those whose ids' count in the whole corpus
    is the highest of their B id, ``count_sum`` adds up all counts. A text that is null or
    empty, or that either tokenizer does not give back byte for byte, has no tokens: zeros
    and an empty string. Special tokens' strings are plain text. Rows that repeat count as
    often and are answered each; a null id stays null; other columns are not read, whatever
    their names. Long texts are worked on in parts.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = encode(docs, id_col=id_col, text_col=text_col, vocabulary_a=vocabulary_a, vocabulary_b=vocabulary_b)
    pairs = pair_counts(rows, vocabulary_a, vocabulary_b)
    more_than_head = pairs.count() > head
    top = pairs.select("pair", "n", "best")
    if more_than_head:
        top = top.orderBy(F.desc("n"), "pair").limit(head)
    held = spark.sparkContext.broadcast(Head(top.toArrow()))  # at most ``head`` rows
    numbers = ", ".join(f"{c} bigint" for c in _COLUMNS[:-1])
    out = rows.mapInArrow(_align(vocabulary_a, vocabulary_b, held), f"id bigint, digest string, {numbers}, groups string")
    if more_than_head:
        # rare pairs: none of them is in more links than the last one of the head
        rest = rows.mapInArrow(_rest(vocabulary_a, vocabulary_b, held), "id bigint, digest string, pair bigint, times bigint")
        rest = rest.groupBy("id", "digest", "pair").agg(F.max("times").alias("times"))  # rows that repeat
        rest = rest.join(pairs.select("pair", "n", "best"), "pair").groupBy(F.col("id").alias("of"), F.col("digest").alias("text_of"))
        rest = rest.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        out = out.join(rest, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("text_of")), "left")
        out = out.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.select(F.col("id").alias("doc_id"), *_COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("groups_sha256", digest).drop("groups")
