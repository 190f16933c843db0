"""Decontamination and the Jaccard join against plain versions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import common, decontaminate, graph, jaccard_join

WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def plain_tiles(x, y, least):
    free_x, free_y, tiles = [True] * len(x), [True] * len(y), []
    while True:
        best, most = [], least
        for i in range(len(x)):
            for j in range(len(y)):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n] and free_x[i + n] and free_y[j + n]:
                    n += 1
                if n > most:
                    best, most = [(i, j)], n
                elif n == most:
                    best.append((i, j))
        if not best:
            return tiles
        for i, j in best:
            if all(free_x[i : i + most]) and all(free_y[j : j + most]):
                for k in range(most):
                    free_x[i + k] = free_y[j + k] = False
                tiles.append((i, j, most))


def test_tiles_equal_plain_tiles():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x, y = (rng.integers(1, 4, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        assert decontaminate.tile(x, y, 3) == plain_tiles(x.tolist(), y.tolist(), 3)


def test_words_that_repeat():
    one, text = np.full(1000, 7, np.uint64), np.full(1_000_000, 7, np.uint64)
    assert decontaminate.tile(one, text) == [(0, 0, 1000)]
    item, words = " ".join(["a"] * 1000), " ".join(["a"] * 1_000_000)
    start = time.perf_counter()
    held = decontaminate.Items([(1, item), (2, "a b " * 300), (3, "a a a a b c d e f g h")])
    assert held.match(words) == [(1, 1.0, 1000, 1)]
    assert [m[0] for m in held.match("a b " * 200_000 + words)] == [1, 2]
    assert time.perf_counter() - start < 20


def test_decontamination(spark):
    rng = random.Random(1)
    item = text(rng, 30)
    half, other = item.split()[:15], item.split()[15:]
    docs = {
        1: f"{text(rng, 50)} {item.upper()} {text(rng, 50)}",  # whole, other case
        2: f"{' '.join(other)} {text(rng, 20)} {' '.join(half)}",  # reordered
        3: f"{text(rng, 20)} {' '.join(half[:10])} {text(rng, 20)}",  # a third only
        4: text(rng, 500),
        5: "",
        6: None,
        7: " ".join([item] * 200),  # very long
        8: f"{text(rng, 5)} tiny one {text(rng, 5)}",
    }
    d = spark.createDataFrame([(k, v, "x") for k, v in docs.items()] + [(None, item, "x")], "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame([(10, item), (11, None), (None, item), (12, ""), (13, "tiny one")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(1, 10), (2, 10), (7, 10), (None, 10), (8, 13)}
    left = decontaminate.drop_contaminated(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {3, 4, 5, 6}
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_portions_are_held_one_at_a_time(spark, monkeypatch):
    rng = random.Random(8)
    items = [text(rng, 12) for _ in range(9)] + ["tiny one", "tiny one", "solo"]
    docs = [(i, f"{text(rng, 9)} {items[i % len(items)]} {text(rng, 9)}", f"n{i}") for i in range(40)] + [(40, f"{items[0]} {items[5]} {items[8]}", None), (41, None, "z")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, matches string")
    b = spark.createDataFrame([(i // 2, t) for i, t in enumerate(items)], "item_id bigint, text string")
    whole = [sorted(map(tuple, decontaminate.contaminated(d, b).collect())), sorted((r.doc_id, r.m) for r in decontaminate.with_matches(d, b, into="m").collect()), sorted(r.doc_id for r in decontaminate.drop_contaminated(d, b).collect())]
    held, now = [], []
    take, let_go = decontaminate._Held.__init__, decontaminate._Held.let_go

    def counted(self, *args):
        held.append(len(now))
        take(self, *args)
        now.append(self)

    monkeypatch.setattr(decontaminate._Held, "__init__", counted)
    monkeypatch.setattr(decontaminate._Held, "let_go", lambda self: now.remove(self) or let_go(self))
    few = [sorted(map(tuple, decontaminate.contaminated(d, b, portion_bytes=300).collect())), sorted((r.doc_id, r.m) for r in decontaminate.with_matches(d, b, into="m", portion_bytes=300).collect()), sorted(r.doc_id for r in decontaminate.drop_contaminated(d, b, portion_bytes=300).collect())]
    assert few == whole and len(held) >= 9 and set(held) == {0} and not now


def test_components_of_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 5)
    test_components(spark)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {n: root(n) for n in up}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_least_matches_follow_the_posterior():
    for n, m in jaccard_join.least_matches():
        x = np.linspace(0, 1, 20001)
        density = lambda k: x**k * (1 - x) ** (n - k)
        above = lambda k: density(k)[x >= 0.8].sum() / density(k).sum()
        assert above(m) >= jaccard_join.TOLERANCE * 0.9 and (m == 0 or above(m - 1) < jaccard_join.TOLERANCE * 1.1)


def plain_join(docs):
    """(class, links) by all pairs."""
    sets = {i: set(common.shingle_set(t).tolist()) for i, t in docs}
    ids = sorted(sets)
    links, up = {i: 0 for i in ids}, {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (root(i), links[i]) for i in ids}


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(11)
    docs, n = [], 0
    for _ in range(25):
        base = text(rng, rng.randint(4, 150)).split()
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.randint(0, max(0, len(w) // 60))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            docs.append((n, " ".join(w)))
            n += 1
    return docs + [(n, ""), (n + 1, None), (n + 2, "!!"), (n + 3, "!!"), (n + 4, "one two"), (n + 5, "One, two.")]


@pytest.mark.parametrize("chunk", [256, 7])
def test_join_equals_all_pairs(spark, copies, chunk, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_TEXTS", chunk)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in copies], "doc_id bigint, text string, class_id string, n int")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(df).collect()}
    assert got == plain_join(copies)


def test_chains_are_blocked_by_bucket(spark, monkeypatch):
    """Texts of which each is like the next alone hang together in one group; their buckets are blocked one by one, and nothing is lost or counted twice."""
    monkeypatch.setattr(jaccard_join, "CHUNK_TEXTS", 2)
    seen = []
    place = jaccard_join._place
    monkeypatch.setattr(jaccard_join, "_place", lambda *a: seen.append(place(*a)) or seen[-1])
    rng = random.Random(2)
    long = [f"{rng.choice(WORDS)}{i}" for i in range(8 * 260 + 120)]
    docs = [(i, " ".join(long[8 * i : 8 * i + 120])) for i in range(260)] + [(300 + i, " ".join(long[8 * i : 8 * i + 120])) for i in range(0, 260, 9)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(df).collect()}
    assert got == plain_join(docs)
    assert seen[0].filter("band >= 0").count() > 0


def test_one_row_of_each_class_stays(spark, copies):
    df = spark.createDataFrame([(i, t, "x") for i, t in copies], "doc_id bigint, text string, source string")
    kept = jaccard_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in plain_join(copies).values()})
    odd = spark.createDataFrame([(1, "a b c d e f", "p"), (1, "a b c d e f", "p"), (None, "q r s t u v w", "p"), (None, "q r s t u v w", "p"), (3, None, "p")], "doc_id bigint, text string, source string")
    assert sorted(str(r.doc_id) for r in jaccard_join.keep_one_of_each(odd).collect()) == ["1", "3", "None"]
    assert jaccard_join.keep_one_of_each(odd.limit(0)).count() == 0


def test_token_hashes_are_those_of_single_words():
    t = "Hello, wörld… a1_b " * 3
    h = common.token_hashes(t)
    assert len(h) == 9 or len(h) == 12
    assert h[0] == common.token_hashes("hello")[0] and (h[: len(h) // 3] == h[len(h) // 3 : 2 * len(h) // 3]).all()
    long = "word " * 300_000
    assert len(np.unique(common.token_hashes(long))) == 1 and len(common.token_hashes(long)) == 300_000
    assert len(common.token_hashes("x" * 3_000_000)) == 1
