"""Document log-probability summed over all subword segmentations.

Vocabulary: the pieces of an existing subword model. A word's lattice holds every way
to cut it into pieces; the first piece, inner pieces, the last piece and pieces that are
the whole word have scores of their own, so that the model is a proper distribution
over words. A unigram model's scores are taken as they stand; of a model that states
ranks alone the scores start from Zipf's law. They are re-estimated on the training
words, each as often as it occurs, by expectation-maximisation over the lattices; the
vocabulary itself stays as it is. A word's probability is the sum over its segmentations
and nothing else; a document's is the product of its words' marginals and of the end
token's.

Work is done once per distinct word: words are counted over the corpus, the lattice is
summed for each, and documents meet the frequent words in a table of a bounded size and
the others in a join. Many words' lattices are summed side by side, position by position;
words over ``LONG`` units one by one, in time linear in their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

VOCABULARY = "piece_bpe_32k.model"
#: Rounds of expectation-maximisation.
ROUNDS = 4
#: Frequent words that travel with the tasks; longer words than this many bytes go by their digest.
HEAD_WORDS, KEY_BYTES = 131_072, 48
HELD_OUT_OF, HELD_OUT = 7, 2
SMOOTHING = 0.01
#: Units of a word from which on its lattice is summed alone, and cells (words x units) of one block of shorter ones.
LONG, CELLS = 256, 400_000
#: Bytes of texts or words handled together.
GROUP_BYTES = 8 << 20

WHOLE, FIRST, INNER, LAST = range(4)
BYTE = "\0"  # before a byte's value: a piece for one byte of a character that the vocabulary lacks
_BYTE_CODE = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


class Pieces:
    """The surfaces of a vocabulary with their prior natural-log weights, and a piece for each byte."""

    def __init__(self, surfaces: list[str], weights: list[float]):
        self.index = {s: i for i, s in enumerate(surfaces)}
        self.surfaces = surfaces
        self.weights = np.array(weights, float)
        self.n = len(surfaces)
        self.single = np.array([len(s) == 1 or s[0] == BYTE for s in surfaces])
        codes = [[_BYTE_CODE + int(s[1:])] if s[0] == BYTE else [ord(c) for c in s] for s in surfaces]
        self.longest = max(map(len, codes))
        self.known = np.zeros(_BYTE_CODE, bool)
        self.known[[c[0] for c in codes if len(c) == 1 and c[0] < _BYTE_CODE]] = True
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([[_ONE], np.full(self.longest, _BASE)]), dtype=np.uint64)
            hashes = []
            for c in codes:
                h = np.uint64(0)
                for x in c:
                    h = h * _BASE + np.uint64(x + 1)
                hashes.append(h)
            self.keys = np.concatenate([common.mix(np.array(hashes, np.uint64)), [np.uint64(0)]])
        # tables from the top bits of a hash to a piece; those that find their slot taken go to the next table
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        left = np.arange(self.n)
        while len(left):
            bits = max(8, int(32 * len(left) - 1).bit_length())
            slots = np.full(1 << bits, self.n, np.int32)
            at = (self.keys[left] >> np.uint64(64 - bits)).astype(np.int64)
            slots[at[::-1]] = left[::-1]
            self.tables.append((np.uint64(64 - bits), slots))
            left = left[slots[at] != left]

    @classmethod
    def load(cls, name: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=common.vocabulary_path(name))
        best: dict[str, float] = {}
        for i in range(m.get_piece_size()):
            s = m.id_to_piece(i).replace("▁", "")
            if s and not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)):
                best[s] = max(best.get(s, -math.inf), m.get_score(i))
        ranks = all(float(x).is_integer() for x in best.values())  # a merge order, no probabilities
        low = min(best.values(), default=0.0) - 1.0
        best |= {f"{BYTE}{b}": low for b in range(256)}
        return cls(list(best), [-math.log(10.0 - x) if ranks else x for x in best.values()])

    def prior(self) -> np.ndarray:
        """Natural-log scores [4, pieces]: the weights, first and whole, then inner and last, each pair summing to one."""
        w = np.exp(self.weights - self.weights.max())
        return np.log(np.tile(w / w.sum() / 2, (4, 1)))

    def units(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all words, bytes where the vocabulary lacks the character, and each word's number of them."""
        x = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        n = np.fromiter(map(len, words), np.int64, len(words))
        known = self.known[x]
        if known.all():
            return x, n
        size = np.where(known, 1, 1 + (x >= 0x80) + (x >= 0x800) + (x >= 0x10000))
        out, whole = np.repeat(x, size), np.repeat(known, size)
        at = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)
        of = np.repeat(size, size)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[of]
        byte = np.where(at == 0, lead | (out >> (6 * (of - 1))), 0x80 | ((out >> (6 * (of - 1 - at))) & 0x3F))
        word = np.repeat(np.repeat(np.arange(len(words)), n), size)
        return np.where(whole, out, _BYTE_CODE + byte), np.bincount(word, minlength=len(words))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The pieces of runs of units by their hash; the number of pieces where there is none."""
        x = common.mix(hashes)
        shift, slots = self.tables[0]
        out = slots[(x >> shift).astype(np.int64)]
        out[self.keys[out] != x] = self.n
        for shift, slots in self.tables[1:]:
            more = slots[(x >> shift).astype(np.int64)]
            np.copyto(out, more, where=self.keys[more] == x)
        return out


def _flat(scores: np.ndarray) -> np.ndarray:
    """[4 * (pieces + 1)]: the last of each kind is for runs that are no piece."""
    return np.concatenate([scores, np.full((4, 1), -np.inf)], axis=1).ravel()


def _block(pieces: Pieces, table: np.ndarray, units: np.ndarray, n: np.ndarray, times: np.ndarray | None, uses: list) -> np.ndarray:
    """Log marginals of words (``units`` [longest, words], longest word first) by the forward recursion in log space.

    With ``times`` the arcs' expected uses, each word so often, are added to ``uses`` as (arc, uses).
    """
    top, size, stride = len(units), len(n), pieces.n + 1
    having = np.searchsorted(-n, -np.arange(top + 2), side="right")  # words of so many units or more
    h, alpha = np.zeros((top + 1, size), np.uint64), np.full((top + 1, size), -np.inf)
    alpha[0] = 0.0
    arcs: list[np.ndarray] = [np.empty(0, np.int32)]
    for end in range(1, top + 1):
        w, going_on, k = having[end], having[end + 1], min(end, pieces.longest)
        with np.errstate(over="ignore"):
            h[end, :w] = h[end - 1, :w] * _BASE + units[end - 1, :w] + _ONE
            arc = pieces.find(h[end, :w] - h[end - k : end, :w] * pieces.powers[k:0:-1, None])
        arc[:, :going_on] += INNER * stride
        arc[:, going_on:] += LAST * stride
        if k == end:  # the first row's arcs start the word
            arc[0, :going_on] += (FIRST - INNER) * stride
            arc[0, going_on:] += (WHOLE - LAST) * stride
        x = table[arc]
        x += alpha[end - k : end, :w]
        best = x.max(axis=0)
        x -= best
        alpha[end, :w] = best + np.log(np.exp(x, out=x).sum(axis=0))
        if times is not None:
            arcs.append(arc)
    total = alpha[n, np.arange(size)]
    if times is not None:
        beta = np.full((top + 1, size), -np.inf)
        beta[n, np.arange(size)] = 0.0
        for end in range(top, 0, -1):
            arc = arcs[end]
            k, w = arc.shape
            x = table[arc]
            x += beta[end, :w]
            gain = np.exp(x + (alpha[end - k : end, :w] - total[:w])) * times[:w]
            uses.append((arc.ravel(), gain.ravel()))
            into = beta[end - k : end, :w]
            np.logaddexp(into, x, out=into)
    return total


def _long(pieces: Pieces, table: np.ndarray, units: np.ndarray, times: float | None, uses: list) -> float:
    """The same for one word of any length, arc by arc."""
    n, stride = len(units), pieces.n + 1
    power, inverse = common.powers(n + 1)
    found = []
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((units.astype(np.uint64) + _ONE) * inverse[:n], dtype=np.uint64)])
        for k in range(1, min(n, pieces.longest) + 1):
            piece = pieces.find((sums[k:] - sums[:-k]) * power[k - 1 : n])
            start = np.flatnonzero(piece < pieces.n)
            end = start + k
            kind = np.where(start == 0, np.where(end == n, WHOLE, FIRST), np.where(end == n, LAST, INNER))
            arc = piece[start] + kind * stride
            ok = table[arc] > -np.inf
            found.append((start[ok], end[ok], arc[ok]))
    start, end, arc = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(end, kind="stable")
    start, end, arc = start[order], end[order], arc[order]
    score = table[arc]
    alpha = [0.0] * (n + 1)
    steps = list(zip(start.tolist(), score.tolist()))
    cuts = np.searchsorted(end, np.arange(1, n + 2)).tolist()
    exp, log = math.exp, math.log
    for e in range(1, n + 1):
        x = [alpha[s] + p for s, p in steps[cuts[e - 1] : cuts[e]]]
        best = max(x)
        alpha[e] = best + log(sum([exp(y - best) for y in x]))
    if times is not None:
        beta = [-math.inf] * n + [0.0]
        for e in range(n, 0, -1):
            for s, p in steps[cuts[e - 1] : cuts[e]]:
                y, z = beta[s], p + beta[e]
                beta[s] = z if y == -math.inf else (y + log(1 + exp(z - y)) if y > z else z + log(1 + exp(y - z)))
        gain = np.exp(np.array(alpha)[start] + score + np.array(beta)[end] - alpha[n]) * times
        uses.append((arc, gain))
    return alpha[n]


def sum_lattices(pieces: Pieces, scores: np.ndarray, words: list[str], times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural-log marginals of the words (one unit at least), and with ``times`` the expected uses [4, pieces] of every piece, each word so often."""
    table = _flat(scores)
    out = np.zeros(len(words))
    total = np.zeros(len(table)) if times is not None else None
    x, n = pieces.units(words)
    starts = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    alone = int(np.searchsorted(-n[order], -LONG))
    uses: list[tuple[np.ndarray, np.ndarray]] = []

    def collect() -> None:
        if uses:
            total[:] += np.bincount(np.concatenate([a for a, _ in uses]), weights=np.concatenate([g for _, g in uses]), minlength=len(table))
            uses.clear()

    for i in order[:alone]:
        out[i] = _long(pieces, table, x[starts[i] : starts[i] + n[i]], None if times is None else float(times[i]), uses)
        collect()
    at = alone
    while at < len(order):
        top = int(n[order[at]])
        part = order[at : at + max(1, CELLS // top)]
        # runs of units side by side; shorter words repeat their neighbours' units, which no arc of theirs meets
        units = x[np.minimum(starts[part] + np.arange(top)[:, None], len(x) - 1)].astype(np.uint64)
        out[part] = _block(pieces, table, units, n[part], None if times is None else times[part], uses)
        collect()
        at += len(part)
    return out, None if total is None else total.reshape(4, -1)[:, :-1]


def word_log10(pieces: Pieces, scores: np.ndarray, words: list[str]) -> np.ndarray:
    """Marginal log10 probability of each word over its segmentations into pieces."""
    return sum_lattices(pieces, scores, words)[0] / math.log(10)


def estimate(pieces: Pieces, uses: np.ndarray) -> np.ndarray:
    """New scores of expected uses; characters and bytes keep a little everywhere, so that every word has a probability."""
    uses = uses + np.where(pieces.single, SMOOTHING, 0.0)
    with np.errstate(divide="ignore"):
        starts, rest = uses[[WHOLE, FIRST]], uses[[INNER, LAST]]
        return np.log(np.stack([*(starts / starts.sum()), *(rest / rest.sum())]))


@lru_cache(maxsize=2)
def _pieces(name: str) -> Pieces:
    return Pieces.load(name)


# --- over a corpus ------------------------------------------------------------------


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space, A-Z lower-cased: each text's first word (one more entry than texts), and the words as indices of distinct ones."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten().dictionary_encode()
    words, at = flat.dictionary, flat.indices.to_numpy()
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)  # before or after white space
    real = ~empty[at]
    return np.concatenate([[0], np.cumsum(real)])[offsets], at[real], words


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def _key(word: Column) -> Column:
    """A word's bytes; of a long one its digest after a byte that starts no UTF-8 text."""
    return F.when(F.octet_length(word) <= KEY_BYTES, word.cast("binary")).otherwise(F.concat(F.lit(b"\xff"), F.unhex(F.sha2(word.cast("binary"), 256))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, uses in training, uses) of some texts at a time."""
    for part in common.grouped(batches, 1, GROUP_BYTES):
        starts, at, words = tokens(part.column(1))
        train = ~part.column(0).to_numpy(zero_copy_only=False)
        uses = np.bincount(at, minlength=len(words))
        in_train = np.bincount(at[np.repeat(train, np.diff(starts))], minlength=len(words))
        some = np.flatnonzero(uses)
        for i in range(0, len(some), 50_000):
            w = some[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([words.take(pa.array(w)), pa.array(in_train[w]), pa.array(uses[w])], ["word", "c", "uses"])


def _expect(pieces_name: str, scores: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(pieces_name)
        out = np.zeros(scores.shape)
        for part in common.grouped(batches, 0, GROUP_BYTES >> 3):
            out += sum_lattices(pieces, scores, part.column(0).to_pylist(), part.column(1).to_numpy().astype(float))[1]
        kind, piece = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(piece, pa.int32()), pa.array(out[kind, piece])], ["kind", "piece", "uses"])

    return run


def _word_scores(pieces_name: str, scores: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(pieces_name)
        for part in common.grouped(batches, 0, GROUP_BYTES >> 3):
            p = word_log10(pieces, scores, part.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(1, 4)), pa.array(p)], ["key", "c", "uses", "lattice"])

    return run


_TAIL = "array<struct<word:string,n:int>>"
_TAIL_ARROW = pa.struct([("word", pa.string()), ("n", pa.int32())])


def _score(head: pa.Table):
    """Sums over a text's frequent words, and its other words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        index = {w: i for i, w in enumerate(head["key"].to_pylist())}
        known, lattice = np.append(head["c"].to_numpy(), 0), np.append(head["lattice"].to_numpy(), 0.0)
        log_known = np.log10(known + 1.0)
        for part in common.grouped(batches, 3, GROUP_BYTES):
            starts, at, words = tokens(part.column(3))
            keys = words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
            keys = [w if len(w) <= KEY_BYTES else b"\xff" + hashlib.sha256(w).digest() for w in keys]
            entry = np.fromiter((index.get(w, -1) for w in keys), np.int64, len(keys))[at]  # -1 finds the zeros
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])
            in_tail = np.flatnonzero(entry < 0)
            row = np.searchsorted(starts, in_tail, side="right") - 1
            pair, n = np.unique(row * np.int64(len(words) + 1) + at[in_tail], return_counts=True)
            row, word = pair // (len(words) + 1), pair % (len(words) + 1)
            tail = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(n, pa.int32())], fields=list(_TAIL_ARROW))
            tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32()), tail)
            # sums of each text's own numbers, so that they don't depend on its neighbours
            sums = [np.array([x[a:b].sum() for a, b in zip(starts, starts[1:])]) for x in (log_known[entry], lattice[entry])]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(3)), pa.array(np.diff(starts)), pa.array(total(known[entry] > 0).astype(np.int64)), *(pa.array(x, pa.float64()) for x in sums), tails],
                ["row", "doc_id", "held_out", "n_words", "n_known", "log_counts", "lattice", "tail"],
            )

    return run


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, rounds: int = ROUNDS, head_words: int = HEAD_WORDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row, log10.

    Words and one end per text are the tokens; a null or empty text is its end. Documents
    whose crc32(id as text) mod 7 is 2 are held out of all estimates (a null id counts as
    the empty text). ``base_score`` is the add-one word unigram, ``score`` the lattice model.
    Rows that repeat are scored, and counted, as often as they stand there. With no training
    documents the prior scores are used, and the end has half the probability. A word of any
    length is one word; its lattice is summed in time linear in its length.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), common.text_or_empty(F.col(text_col).cast("string")).alias("text"))
    counted = rows.select("held_out", "text").mapInArrow(_count, "word string, c bigint, uses bigint")
    words = counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("uses").alias("uses"))
    words = common.keep(words.select("word", _key(F.col("word")).alias("key"), "c", "uses"), "words")
    ends = rows.filter(~F.col("held_out")).count()
    total = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_words = total.n or 0
    n, v = n_words + ends, (total.v or 0) + (ends > 0)

    pieces = _pieces(vocabulary)
    scores = pieces.prior()
    for _ in range(rounds if n_words else 0):
        uses = np.zeros(scores.shape)
        got = words.filter("c > 0").select("word", "c").mapInArrow(_expect(vocabulary, scores), "kind int, piece int, uses double").groupBy("kind", "piece").agg(F.sum("uses").alias("uses")).toArrow()  # at most 4 rows per piece
        uses[got["kind"].to_numpy(), got["piece"].to_numpy()] = got["uses"].to_numpy()
        scores = estimate(pieces, uses)
    # after the end of a word the text ends or a further word starts
    p_end = ends / n if n_words and ends else 0.5
    go_on = math.log10(1 - p_end)

    scored = common.keep(words.mapInArrow(_word_scores(vocabulary, scores), "key binary, c bigint, uses bigint, lattice double"), "word-scores")
    common.forget(words)
    head = scored.orderBy(F.desc("uses"), "key").limit(head_words).select("key", "c", "lattice").toArrow()  # head_words keys of at most KEY_BYTES
    least = F.monotonically_increasing_id().alias("row")
    texts = common.keep(rows.select(least, "*").mapInArrow(_score(head), f"row bigint, doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, n_words bigint, n_known bigint, log_counts double, lattice double, tail {_TAIL}"), "texts")
    tail = texts.select("row", F.explode("tail").alias("t")).select("row", _key(F.col("t.word")).alias("key"), "t.n").join(scored.select("key", "c", F.col("lattice").alias("p")), "key")
    tail = tail.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("l"), F.sum(F.col("n") * F.col("p")).alias("p"))
    per_token = math.log10(n + v + 1) if n else 0.0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_tokens = F.col("n_words") + 1
    base = F.col("log_counts") + zero("l") + math.log10(ends + 1) - n_tokens * F.lit(per_token)
    lattice = F.col("lattice") + zero("p") + F.col("n_words") * F.lit(go_on) + math.log10(p_end)
    return texts.drop("tail").join(tail, "row", "left").select("doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("n_known") + zero("k") + int(ends > 0)).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), base.alias("base_score"), lattice.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
