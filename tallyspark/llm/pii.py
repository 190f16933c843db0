"""Personal data by weak supervision.

Base rules find the certain spans. Looser rules propose whatever may be personal data,
much of which is not: numbers of a card's length that fail the checksum, dates, times,
versions, "hosted at example.com". Every span, base or proposed, is a candidate on which
labelers vote: its regular expression's shape, checks, gazetteers and the words around it.

Nobody says how reliable a labeler is. Spans made by rule (:func:`planted`: spellings of
addresses and numbers, and look-alikes) are known to be true or false; over them and the
counts of the corpus's vote patterns (their number is bounded, whatever the corpus)
expectation-maximisation estimates for every kind how often each labeler votes yes, no or
not at all on true and on false spans. The planted spans weigh as much as all of the
corpus, so they hold the two classes apart however large it is. Posteriors and planted
truth train the final classifier, which sees the span's own surface besides the votes: how
many characters and groups it has, what parts them, what stands next to it. Base spans stay
whatever it says; proposed ones are added where it says yes.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

KINDS = ["email", "ip", "card", "phone"]
LABELERS = ["shape", "check", "gazetteer", "context", "counter", "edges"]
ROUNDS, ACCEPT = 50, 0.5
#: Planted spans of each kind, half of them false.
PLANTED = 600
#: Characters of context on either side.
AROUND = 40

# The base rules.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Looser rules propose spans.
_AT, _DOT = r"(?: ?(?:@|&#64;|\(at\)|\[at\]|\{at\}) ?| at )", r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\[\.\]|\(\.\)) ?| dot )"
_EMAIL_SPELT = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9._%+-]{{1,64}}){{0,3}}{_AT}[A-Za-z0-9-]{{1,63}}(?:(?:{_DOT}|\.| \. )[A-Za-z0-9-]{{1,63}}){{1,4}}(?![A-Za-z0-9-])", re.I)
# "at" between blanks before a real dot is more often prose ("hosted at example.com")
_AT_PROSE = re.compile(r" at [A-Za-z0-9-]+ ?\.", re.I)
_IP_LOOSE = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}| ?\. ?[0-9]{1,3}){3}(?![0-9.])", re.I)
_IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?:(?<=:)[0-9]{1,3}(?:\.[0-9]{1,3}){3})?(?![\w:])|(?:(?<![\w:.\[])|(?<=//\[))::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}(?![\w:])")
_CARD_LOOSE = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:(?:[._/-]|  ?)?[0-9]{4,6}){2,3}(?:(?:[._/-]|  ?)[0-9]{1,5})?(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])")
# not the three groups of a social security number
_PHONE_LOOSE = re.compile(r"(?<![0-9A-Za-z+.])(?![0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))(?:(?:\+|00)[0-9]{1,3}[ ./-]?)?(?:\([0-9]{1,5}\)|[0-9]{2,5})(?:[ ./-]{1,2}[0-9]{2,5}){1,5}(?![0-9A-Za-z])|(?<![0-9A-Za-z+.])0[0-9]{7,13}(?![0-9A-Za-z])")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2}|[0-9]{1,2}[ ./-][0-9]{1,2}[ ./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2} ?[-/] ?(?:19|20)[0-9]{2}")

# Gazetteers and context words.
_TLDS = "com org net edu gov io co de fr es uk eu info biz us ca au ch at it nl be".split()
_CARD_HEADS = tuple("3456")
_CONTEXT = {
    "email": "mail email contact write address kontakt courriel correo adresse schreiben".split(),
    "ip": "ip host server address client login gateway network addr peer".split(),
    "card": "card visa mastercard amex credit debit payment karte carte tarjeta pay".split(),
    "phone": "phone call tel telephone mobile fax contact cell anruf telefon appel movil".split(),
}
_COUNTER = "version v chapter section isbn issn doi token key hash serial order invoice page build sha md5 uuid".split()
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; each kind leftmost and without overlaps."""
    out: list[tuple[str, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def proposed_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Looser spans that meet no base span, nor one proposed before them."""
    taken = [(s, e) for _, s, e in base]
    out = []

    def offer(kind: str, rule: re.Pattern, least: int = 0, most: int = 99) -> None:
        for m in rule.finditer(text):
            s, e = m.span()
            if least <= len(_digits(m.group())) <= most and all(e <= a or s >= b for a, b in taken):
                taken.append((s, e))
                out.append((kind, s, e))

    low = text.lower()
    if "at" in low or "@" in text or "&#64;" in text:
        offer("email", _EMAIL_SPELT)
    if ":" in text:
        offer("ip", _IP6, 1)  # words of a to f, too, stand around "::"
    if any(c in text for c in "0123456789"):
        offer("ip", _IP_LOOSE)
        offer("card", _CARD_LOOSE, 13, 19)
        offer("phone", _PHONE_LOOSE, 7, 15)
    return out


def _ip_holds(span: str) -> bool:
    """Whether a spelling is an address: four parts to 255, or IPv6."""
    if ":" not in span:
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    import ipaddress

    try:
        return ipaddress.ip_address(span).version == 6
    except ValueError:
        return False


def votes(text: str, kind: str, start: int, end: int) -> str:
    """One of + - 0 from each labeler."""
    span = text[start:end]
    digits = _digits(span)
    before = {w.lower() for w in _WORD.findall(text[max(0, start - AROUND) : start])}
    after = {w.lower() for w in _WORD.findall(text[end : end + AROUND])}
    strict = {
        "email": "@" in span and " " not in span,
        "ip": span.count(".") == 3 and " " not in span or "::" in span or span.count(":") == 7,
        "card": 16 <= len(digits) <= 19,
        "phone": span.startswith(("+", "00", "(")),
    }[kind]
    gazetteer, check = "0", "0"
    if kind == "card":
        check = "+" if luhn(digits) else "-"
        gazetteer = "+" if digits.startswith(_CARD_HEADS) else "-"
    elif kind == "phone":
        check = "-" if _DATE.search(span) or not 8 <= len(digits) <= 15 else "+" if len(digits) >= 9 else "0"
        gazetteer = "+" if digits.startswith("0") or span.startswith("+") else "-"
    elif kind == "ip":
        check = "+" if _ip_holds(span) else "-"
    else:
        gazetteer = "+" if re.split(r"[^A-Za-z]+", span.lower().rstrip(")]}"))[-1] in _TLDS else "-"
        check = "-" if _AT_PROSE.search(span) else "+"
    context = "+" if (before | after) & set(_CONTEXT[kind]) else "0"
    counter = "-" if before & set(_COUNTER) else "0"
    edge = lambda c: not (c.isalnum() or c in "@_")
    edges = "+" if (start == 0 or edge(text[start - 1])) and (end == len(text) or edge(text[end])) else "-"
    return ("+" if strict else "-") + check + gazetteer + context + counter + edges


def surface(text: str, kind: str, start: int, end: int) -> str:
    """What the span itself looks like, one character each: size, groups, what parts them, and its neighbours."""
    span = text[start:end]
    size = len(_digits(span)) if kind != "email" else len(span) // 2
    groups = len(re.findall(r"[^\W_]+", span))
    parting = {c for c in span if not c.isalnum()}
    parts = "n" if not parting else "m" if len(parting) > 1 else {" ": "s", "-": "d", ".": "p", ":": "c"}.get(parting.pop(), "o")
    near = lambda c: "s" if not c or c.isspace() else "a" if c.isalnum() else "p"
    return f"{min(size // 4, 5)}{min(groups, 6)}{parts}{near(text[start - 1 : start] if start else '')}{near(text[end : end + 1])}"


def candidates(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, pattern) of all spans, base ones first; a pattern is kind:votes:surface."""
    base = base_spans(text)
    return [(k, s, e, own, f"{k}:{votes(text, k, s, e)}:{surface(text, k, s, e)}") for own, spans in ((True, base), (False, proposed_spans(text, base))) for k, s, e in spans]


def _planted_texts(seed: int, each: int) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, text, span, true): ``each`` of every kind."""
    rng = random.Random(seed)
    pick = rng.choice
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8)))

    def card(true: bool) -> str:
        d = pick(_CARD_HEADS if true else "123456789") + digits(pick([12, 13, 14, 15, 15, 15, 18]))
        if true:  # of any other numbers one in ten holds by chance
            d = next(x for c in "0123456789" if luhn(x := d[:-1] + c))
        cut = pick([[4, 6], [4, 4, 4]]) if len(d) < 16 else [4, 4, 4]
        sep, parts = pick([".", "_", "/", "  ", "-", " ", ""]), []
        for n in cut:
            parts, d = [*parts, d[:n]], d[n:]
        return sep.join([*parts, d] if d else parts)

    def email(true: bool) -> str:
        if not true:
            return pick([f"{word()} at {word()}.{pick(_TLDS)}", f"{word()} at {word()}.{word()}", f"{word()}.{word()} at {word()}-{word()}.{pick(_TLDS)}"])
        dot = pick([" dot ", " (dot) ", "(dot)", "[dot]", " [dot] ", "[.]", " . ", "."])
        at = pick(["(at)", " (at) ", "[at]", " [at] ", " @ ", "&#64;", "{at}"] if "." in dot else [" at ", " (at) ", "[at]", " @ ", "@"])
        name = word() + pick(["", "", "." + word(), dot + word() if dot.strip() not in (".", "[.]") else ""])
        return dot.join([name + at + word(), *([word()] if rng.random() < 0.3 else []), pick(_TLDS)])

    def ip(true: bool) -> str:
        part = lambda: str(rng.randint(0, 255) if true else rng.randint(256, 999))
        four = pick(["[.]", " . ", "(dot)", "[dot]", "(.)"]).join([str(rng.randint(0, 255)), part(), str(rng.randint(0, 255)), part()])
        hexes = lambda n: ":".join(format(rng.randint(0, 0xFFFF), "x") for _ in range(n))
        if true:
            return pick([four, hexes(8), f"{hexes(rng.randint(1, 4))}::{hexes(rng.randint(1, 3))}"])
        return pick([four, ":".join(str(rng.randint(10, 59)) for _ in range(3)), ":".join(digits(2) for _ in range(rng.randint(4, 6)))])

    def phone(true: bool) -> str:
        if true:
            country, area = str(rng.randint(1, 99)), str(rng.randint(11, 999))
            return pick([f"(0{area}) {digits(3)} {digits(2)} {digits(2)}", f"00{country} {area} {digits(4)} {digits(3)}", f"0{area}-{digits(3)}-{digits(2)}-{digits(2)}", f"0{area}/{digits(3)} {digits(3)}", f"0{area}{digits(7)}", f"0{area}.{digits(3)}.{digits(3)}", f"({area}) {digits(3)}-{digits(4)}"])
        year, day = str(rng.randint(1900, 2035)), f"{rng.randint(1, 28):02}"
        return pick([f"{year}-{rng.randint(1, 12):02}-{day}", f"{day}.{rng.randint(1, 12):02}.{year}", f"{year}-{rng.randint(1900, 2035)}", f"{rng.randint(10, 99)} - {digits(7)[:5]}", f"978 {rng.randint(10, 99)} {digits(5)} {digits(3)}", f"{rng.randint(1, 9)}{digits(2)} {digits(3)} {digits(3)}", f"{digits(4)}-{digits(4)}"])

    for kind, make in (("email", email), ("ip", ip), ("card", card), ("phone", phone)):
        for i in range(each):
            true = i % 2 == 0
            span, draw = make(true), rng.random()
            lead = pick(_CONTEXT[kind]) if draw < (0.6 if true else 0.15) else pick(_COUNTER) if draw > (0.98 if true else 0.7) else word()
            yield kind, f"{word()} {lead}{pick(['', ':', ',', '', ''])} {span}{pick([' ', ', ', '. ', ''])}{word() if rng.random() < 0.8 else ''}", span, true


@lru_cache(maxsize=4)
def planted(seed: int = 1, each: int = PLANTED) -> dict[tuple[str, bool], int]:
    """How often each pattern occurs among proposed spans that are known to be true or false."""
    out: Counter = Counter()
    for kind, text, span, true in _planted_texts(seed, each):
        start = text.index(span)
        for k, s, e, own, pattern in candidates(text):
            if not own and k == kind and (s, e) == (start, start + len(span)):
                out[pattern, true] += 1
    return dict(out)


_VOTE = {"+": 0, "-": 1, "0": 2}


def aggregate(patterns: dict[str, int], known: dict[tuple[str, bool], int] | None = None) -> tuple[dict[str, float], dict[tuple[str, str], np.ndarray]]:
    """Posterior of each pattern, and for each kind and labeler the shares of +, - and 0 among true (row 0) and false spans.

    Votes are independent given the truth. The first shares are those of the ``known`` spans
    (:func:`planted` if not given); then the corpus's spans count by their posteriors, and
    the known ones of a kind as much as all of the corpus's, their own number at least. A
    kind's share of true spans is the corpus's own.
    """
    known = planted() if known is None else known
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    kind = np.array([KINDS.index(p.split(":")[0]) for p in names], int)
    code = lambda x: np.array([[_VOTE[c] for c in p.split(":")[1]] for p in x], int).reshape(len(x), len(LABELERS))
    v, fixed = code(names), sorted(known)
    fixed_v, fixed_kind = code([p for p, _ in fixed]), np.array([KINDS.index(p.split(":")[0]) for p, _ in fixed], int)
    fixed_true, fixed_n = np.array([t for _, t in fixed], bool), np.array([known[f] for f in fixed], float)
    p = np.zeros(len(names))
    share = np.full((len(KINDS), len(LABELERS), 2, 3), 1 / 3)
    for step in range(ROUNDS):
        log_odds = np.zeros(len(names))
        for k in range(len(KINDS)):
            own, sure = kind == k, fixed_kind == k
            total = n[own].sum() if step else 0.0
            weight = max(1.0, total / max(1.0, fixed_n[sure].sum()))
            true = ((n * p)[own].sum() + 1) / (n[own].sum() + 2) if step else 0.5
            log_odds[own] = np.log(true / (1 - true))
            for j in range(len(LABELERS)):
                for t in range(2):
                    w = n * (p if t == 0 else 1 - p) * (step > 0)
                    votes_ = np.bincount(v[own, j], weights=w[own], minlength=3)
                    votes_ = votes_ + weight * np.bincount(fixed_v[sure & (fixed_true == (t == 0)), j], weights=fixed_n[sure & (fixed_true == (t == 0))], minlength=3)
                    share[k, j, t] = (votes_ + 1) / (votes_.sum() + 3)
                log_odds[own] += np.log(share[k, j, 0] / share[k, j, 1])[v[own, j]]
        p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return dict(zip(names, p.tolist())), {(k, name): share[i, j] for i, k in enumerate(KINDS) for j, name in enumerate(LABELERS)}


def _features(pattern: str) -> list[str]:
    """The names of what holds of a pattern."""
    k, v, shape = pattern.split(":")
    return [k, *(f"{k}{j}{c}" for j, c in enumerate(v) if c != "0"), *(f"{k}s{j}{c}" for j, c in enumerate(shape))]


class Classifier:
    """Logistic regression on a span's kind, votes and surface, trained on the posteriors and on the known spans."""

    def __init__(self, patterns: dict[str, int], known: dict[tuple[str, bool], int] | None = None):
        known = planted() if known is None else known
        self.posterior, self.reliability = aggregate(patterns, known)
        names, fixed = sorted(patterns), sorted(known)
        every = [*names, *(p for p, _ in fixed)]
        self.columns = {f: i for i, f in enumerate(sorted({f for p in every for f in _features(p)}))}
        x = np.array([self._row(p) for p in every]).reshape(len(every), len(self.columns))
        y = np.array([*(self.posterior[p] for p in names), *(float(t) for _, t in fixed)])
        # what the base rules alone find must not drown the rare patterns
        n = np.sqrt(np.array([*(patterns[p] for p in names), *(known[f] for f in fixed)], float))
        w = np.zeros(x.shape[1])
        for _ in range(30 if every else 0):  # Newton steps with a small ridge
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (n * (y - q)) - 0.1 * w
            h = (x * (n * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
            w = w + np.linalg.solve(h, g)
        self.weights = w

    def _row(self, pattern: str) -> np.ndarray:
        out = np.zeros(len(self.columns))
        out[[self.columns[f] for f in _features(pattern) if f in self.columns]] = 1.0
        return out

    def accepts(self, pattern: str) -> bool:
        return bool(self.weights @ self._row(pattern) > np.log(ACCEPT / (1 - ACCEPT)))


def _sorted(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in _sorted(spans))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: its base spans joined, and its proposed spans with their patterns; all patterns."""
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            found = [candidates(t or "") for t in part.column(1).to_pylist()]
            base = [[c[:3] for c in f if c[3]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array([sum(b[0] == k for b in x) for x in base], pa.int64()) for k in KINDS), pa.array([_joined(x) for x in base]), pa.array([[f"{k}:{s}:{e};{p}" for k, s, e, own, p in f if not own] for f in found], pa.list_(pa.string())), pa.array([[c[4] for c in f] for f in found], pa.list_(pa.string()))],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base", "proposed", "patterns"],
            )


def _patterns(found: DataFrame) -> dict[str, int]:
    """Counts of patterns: kinds, votes and surfaces have a fixed number of values (in practice some hundred together)."""
    return {r.p: r.n for r in found.select(F.explode("patterns").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}


def find_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row.

    The counts and the digest are of base spans; ``spans`` holds them and the added ones as
    ``kind:start:end`` in code points, by kind, then start. A null text counts as empty.
    Rows that repeat are treated, and counted, one by one.
    """
    spark = docs.sparkSession
    common.ship(spark)
    kind = dict(docs.select(F.col(id_col).alias("d")).dtypes)["d"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = common.keep(rows.mapInArrow(_find, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, proposed array<string>, patterns array<string>"), "pii")
    patterns = _patterns(found)
    classifier = Classifier(patterns)
    yes = {p for p in patterns if classifier.accepts(p)}

    @F.pandas_udf("string")
    def all_spans(base: pd.Series, proposed: pd.Series) -> pd.Series:
        out = []
        for b, more in zip(base, proposed):
            added = [x.partition(";")[0] for x in more if x.partition(";")[2] in yes]
            if added:
                spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in [*filter(None, b.split(",")), *added])]
                b = _joined(spans)
            out.append(b)
        return pd.Series(out, dtype=object)

    spans = F.when(F.size("proposed") > 0, all_spans("base", "proposed")).otherwise(F.col("base"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))


def redact(text: str, yes: set[str]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    found = sorted((s, e, k) for k, s, e, own, p in candidates(text) if own or p in yes)
    out, at, i = [], 0, 0
    while i < len(found):
        start, end, kind = found[i]
        i += 1
        while i < len(found) and found[i][0] < end:
            end = max(end, found[i][1])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in the text and the length column brought up to date; a null text stays null."""
    spark = docs.sparkSession
    common.ship(spark)
    found = docs.select(F.lit(0).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_find, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, proposed array<string>, patterns array<string>")
    patterns = _patterns(found)
    classifier = Classifier(patterns)
    yes = {p for p in patterns if classifier.accepts(p)}

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact(t, yes) for t in texts], dtype=object)

    columns = docs.columns
    out = docs.withColumn(text_col, cleaned(F.col(text_col).cast("string")))
    if length_col and length_col in columns:
        out = out.withColumn(length_col, F.length(text_col).cast(dict(docs.dtypes)[length_col]))
    return out.select(columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
