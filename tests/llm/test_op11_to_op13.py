"""Alignment of two tokenizers, ranked search, license scans."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import alignment, common, licenses, ranking

# --- alignment ------------------------------------------------------------------------


def plain_alignment(rows):
    """Whole texts through both libraries, links by comparing byte ranges one by one."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(common.vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=common.vocabulary_path("piece_bpe_32k.model"))
    own = [x for x in range(256) if 33 <= x < 127 or 161 <= x and x != 173]
    level = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    docs, counts = [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ba = [bytes(level[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        if not text or b"".join(ba) != whole or b"".join(bb) != whole:
            docs.append((doc_id, [], [], []))
            continue
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        ea, eb = ends(ba), ends(bb)
        link = [(i, j) for i in range(len(ia)) for j in range(len(ib)) if max(ea[i] - len(ba[i]), eb[j] - len(bb[j])) < min(ea[i], eb[j])]
        both = sorted(set(ea) & set(eb))
        groups = [([ia[i] for i in range(len(ia)) if lo < ea[i] <= hi], [ib[j] for j in range(len(ib)) if lo < eb[j] <= hi]) for lo, hi in zip([0, *both], both)]
        docs.append((doc_id, ia, ib, groups, [(ia[i], ib[j]) for i, j in link]))
        counts.update(docs[-1][4])
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for d in docs:
        links, groups = (d[4] if len(d) > 4 else []), d[3]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d[0], len(d[1]), len(d[2]), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), text))
    return sorted(out, key=str)


def aligned(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, n_a string, groups string").repartition(3)
    return sorted((tuple(r) for r in alignment.align(df, **kw).collect()), key=str)


ODD = ["", None, " ", "  ", "a", "\n", "\n\n  x", "tabs\tand \t spaces ", "x <|endoftext|> y<s></s><unk><0x41>", "▁ here", "under▁score", "\x1c!\x1c\x1d ok", "nbsp   thin x 　 wide", "emoji 👩‍👩‍👧 éé ﬁ ǆ İ", "12345 6,789.01 it's they'LL", "漢字かな交じり文", "zero\x00byte \x00", "\r\nline\r\n\r\n", "{\r  x;\r\n}\r", "\r", "a\r \nb \r c\r", "end ", "end\n", " lead", " x  \x85 y", "﻿bom ​", "a" * 50 + " " * 40 + "b"]


@pytest.mark.parametrize("head", [alignment.HEAD, 20, 0])
def test_alignment_equals_comparing_byte_ranges(spark, head):
    rng = random.Random(4)
    rows = list(enumerate(ODD))
    alphabet = ["a", "\r", ";", "the", "ing", " ", "  ", "\n", "\t", "é", "漢", "!", "1", "'s", "\x1c", " ", "İ", "🙂", "▁", "."]
    rows += [(100 + i, "".join(rng.choices(alphabet[: rng.choice([6, 8, 12, 16, 18])], k=rng.randint(1, 40)))) for i in range(60)]
    rows += [(7, "the same words"), (7, "the same words"), (7, "other words"), (None, "the same words"), (None, None)]
    assert aligned(spark, rows, head=head) == plain_alignment(rows)


def test_long_texts_and_small_caches(spark, monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choices(["lorem", "ipsum", "dolor\nsit", "amet,", "x  y"], k=300))
    known = alignment.Encoder(alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    whole = known([text])
    for name in ("_PART", "_LABELS"):
        monkeypatch.setattr(alignment, name, 50)
    assert len(list(known.parts(text))) > 10 and known([text]) == whole
    known = alignment.Encoder(alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    assert known([text]) == whole and known.t.by_chunk
    rows = [(0, text), (1, "one " * 2000)]
    got = aligned(spark, rows)
    monkeypatch.undo()
    monkeypatch.setattr(alignment, "CACHE", 1)
    assert got == aligned(spark, rows) and got[1][4] >= 2000 and aligned(spark, []) == []


def test_labels_and_links():
    import numpy as np

    label = alignment.labels(np.array([2, 4, 6]), np.array([1, 4, 5, 6]))
    assert label == bytes([2, 1, 0, 3, 2, 3]) and [x.tolist() for x in alignment.groups(label)] == [[2, 1], [2, 2]]
    assert [(x >> 32, x & 0xFFFFFFFF) for x in alignment.links(label, np.array([7, 8, 9]), np.array([1, 2, 3, 4])).tolist()] == [(7, 1), (7, 2), (8, 2), (9, 3), (9, 4)]


def test_alignment_query(spark):
    from tallyspark.llm import queries

    got = queries.queries()["op11_token_alignment"](spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 100_000)).collect() if len(r[1] or "") < 1500]
    have = {r.doc_id: r for r in got.collect()}
    for doc_id, n_a, n_b, n_groups, n_links, _, _, text in plain_alignment(rows):
        r = have[doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (n_a, n_b, n_groups, n_links)
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "")


# --- ranked search --------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranking(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate(LOW))
    have = [(d, ts) for d, t in docs if d is not None and (ts := terms(t))]
    n_docs, n_words = len(have), sum(len(t) for _, t in have)
    df = Counter(x for _, t in have for x in set(t))
    out = []
    for item_id, text in items:
        scores = []
        for d, ts in have:
            tf, s = Counter(ts), 0
            m = 100 - 25 + (25 * len(ts) * n_docs) // n_words
            for x in terms(text):
                if tf[x]:
                    s += ranking.weight(df[x], n_docs) * ((1000000000 * tf[x]) // (1000 * tf[x] + 12 * m))
            if s > 0:
                scores.append((-s, d))
        if item_id is not None:
            out += [(item_id, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def made_up(rng, n_docs, n_items):
    words = ["W" + format(i, "x") for i in range(60)] + ["é", "É", "the", "The", "x-y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 10, 40])))) for i in range(n_docs)]
    docs += [(5000 + i, "copy of W1 w2 w3") for i in range(30)] + [(None, "w1 w2"), (6000, None), (6001, "... !"), (6002, "w1\x00w1@w1 " * 50), (3, "w5"), (3, "w5")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 12])))) for i in range(n_items)] + [(100, "copy w1 w2"), (101, None), (102, "nowhere"), (None, "w1"), (103, "w1 w1 w1 w2"), (103, "w9")]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"SHARD_DOCS": 40, "FAN": 3, "SEED_SHARDS": 1, "SEED_FROM": 1}, {"SHARD_ENTRIES": 60, "FAN": 2, "WAVE_BYTES": 600, "FILTER_BYTES": 10, "_PART": 16}])
def test_ranking_equals_scoring_all(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(ranking, name, value)
    docs, items = made_up(random.Random(6), 300, 20)
    d = spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id bigint, text string, rank int, score double").repartition(3)
    q = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, doc_id string")
    for k in (1, 7):
        assert sorted(tuple(r) for r in ranking.rank(d, q, k=k).collect()) == plain_ranking(docs, items, k)
    assert ranking.rank(d.limit(0), q).count() == 0 and ranking.rank(d, q.limit(0)).count() == 0


def test_tree_opens_few_nodes_and_equal_bounds():
    n, calls = 4096, []
    docs = [(f"t{i % 7} " + ("rare " * (i % 5 == 0 and i > 4000))).encode() for i in range(n)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([d.decode() for d in docs])], ["id", "text"])
    raw = list(ranking._shards(None)(iter([batch])))[0]
    rows = pa.RecordBatch.from_arrays([raw.column(i) for i in range(2, 8)], raw.schema.names[2:])
    tree = ranking.Tree(*(list(ranking._trees(n, 2 * n)(iter([rows])))[0].column(i)[0].as_py() for i in range(3)))
    plain = tree.children
    tree.children = lambda *a: calls.append(a[:2]) or plain(*a)
    found = tree.search({b"rare": 5, b"t1": 1}, 5, 1)
    best = sorted(((-s, d) for s, d in found))[:5]
    whole = plain(0, 0, n, __import__("numpy").array([tree.term[b"rare"], tree.term[b"t1"]]), __import__("numpy").array([5, 1]))
    assert best == sorted((-int(s), i) for i, s in enumerate(whole))[:5] and len(calls) < 20


def test_search_ties_go_to_smaller_ids(spark):
    docs = [(i, "same words here") for i in range(500, 0, -1)] + [(i, "others") for i in range(501, 1500)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = ranking.rank(d, spark.createDataFrame([(1, "same here")], "item_id bigint, text string"), k=5).collect()
    assert sorted((r["rank"], r.doc_id) for r in got) == [(i, i) for i in range(1, 6)]


# --- license scans --------------------------------------------------------------------


def plain_scan(rows, templates, threshold):
    out = []
    for doc_id, text in rows:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        starts = [(i, label) for p, label in licenses.PHRASES for pw in [p.split()] for i in range(len(ws)) if ws[i : i + len(pw)] == pw]
        more, score = set(), 0.0
        for label, t in templates:
            n = len(licenses.words_of(t))
            tw = set(licenses.words_of(t))
            w = next((c for c in licenses.CLASSES if c >= n), n)
            for i in range(0, len(ws), w):
                share = len(tw & set(ws[i : i + 2 * w]))
                if tw and 100 * share >= threshold * len(tw):
                    more.add(label)
                    score = max(score, share / len(tw))
        base = {label for _, label in starts}
        places = [i for i, _ in starts]
        out.append((doc_id, len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else score))
    return sorted(out, key=str)


def digest(df):
    starts = F.flatten(F.transform("places", lambda p: p["starts"]))
    return df.select("doc_id", "n_words", F.size(starts), F.array_min(starts), F.array_max(starts), F.array_join("base_labels", ","), F.array_join("labels", ","), "score")


@pytest.mark.parametrize("threshold", [50, 80, 100])
def test_scan_equals_comparing_all_blocks(spark, monkeypatch, threshold):
    rng = random.Random(7)
    texts = [t for _, t in licenses.TEMPLATES]
    pool = [w for t in texts for w in t.split()] + ["noise"] * 100 + ["é", "MİT", "worK", "Cc\nby-NC", "UNDER the MIT license!"]
    rows = [(i, " ".join(rng.choices(pool, k=rng.choice([0, 3, 30, 200])))) for i in range(40)]
    for i, t in enumerate(texts):
        words = t.split()
        kept = [w for w in words if rng.random() < 0.85]
        rows += [(100 + i, "word " * rng.randint(0, 40) + t + " word" * 30), (200 + i, " ".join(kept)), (300 + i, "\n * ".join(words)), (400 + i, t.upper())]
    rows += [(500, None), (500, ""), (501, "..."), (None, texts[0]), (1, texts[0]), (1, texts[0]), (502, "released under the MIT License " * 3), (503, "a " * 3000 + texts[4] + " b" * 3000), (504, "Apache License, Version 2 cc-by-nc CC BY NC")]
    df = spark.createDataFrame([(i, t, "l", 1) for i, t in rows], "doc_id bigint, text string, labels string, word int").repartition(3)
    extra = [*licenses.TEMPLATES, ("tiny", "a b"), ("none", "..."), ("long", " ".join(f"v{i}" for i in range(300)))]
    got = sorted((tuple(r) for r in digest(licenses.scan(df, templates=extra, threshold=threshold)).collect()), key=str)
    assert got == plain_scan(rows, extra, threshold)


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([(1, "under the MIT license")], "doc_id bigint, text string")
    assert licenses.scan(df.limit(0)).count() == 0
    row = licenses.scan(df, templates=[]).first()
    assert row.labels == ["mit"] and row.score == 1.0 and licenses.scan(df, phrases=[]).first().n_words == 4
    with pytest.raises(ValueError):
        licenses.scan(df, phrases=[("é", "x")])


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_license_scan"])
def test_queries_equal_their_sql(spark, name):
    from tallyspark.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = queries.queries()[name](spark, "/root/testdata/sf0.001")
    asked = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(asked, key=str)
