"""The pipeline against a plain version of every stage."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import common, importance, pii

cp = pytest.importorskip("corpus_pipeline")
WORDS = [f"w{i}" for i in range(500)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(17)
    docs, labels = [], []
    say = lambda n: " ".join(rng.choices(WORDS, k=n))
    bench = [say(30) for _ in range(5)]
    for i in range(400):
        kind = i % 10
        t = say(rng.randint(30, 90))
        if kind == 0:
            t = " ".join(w if k % 7 else "slur" for k, w in enumerate(t.split()))
        if kind == 1:
            t = " ".join(f"{w}%%%" for w in t.split())
        if kind == 2 and i > 20:
            t = docs[23 if i > 30 else 3][1] + " tail"
        if kind == 3 and i % 3 == 0:
            half = rng.choice(bench).split()
            t = f"{t} {' '.join(half[15:])} {say(5)} {' '.join(half[:15])}"
        if kind == 4:
            t += f" a{i}@mail.example.com and +1 (017) 555-{1000 + i}"
        docs.append((i, t, "en", "src0", len(t)))
        if rng.random() < 0.6:
            labels.append((i, int(kind != 1), int(kind == 0)))
    docs += [(400, None, "en", "s", None), (401, "", "en", None, 0), (402, docs[5][1], "en", "s", 1), (403, say(5000), "en", "s", 1)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    return d, bench


def plain_ratios(raw, target):
    out = np.zeros(len(raw), np.float32)
    for i, (n, pseudo) in enumerate(importance.PSEUDO.items()):
        part = slice(i << importance.BITS, (i + 1) << importance.BITS)
        share = target[part].sum() / max(1, raw[part].sum())
        expected = raw[part] * share + pseudo
        r = np.log((target[part] + pseudo) / expected)
        out[part] = np.sign(r) * np.maximum(0.0, np.abs(r) - importance.SURE[n] / np.sqrt(expected))
    return out


def plain_quality(rows, labels):
    good = {i: q == 1 and t == 0 for i, q, t in labels}
    counts = np.zeros((2, len(importance.PSEUDO) << importance.BITS))
    fold = lambda i: folds[i]
    folds = rows["folds"]
    for i, t in rows["docs"]:
        for b in importance.buckets(t):
            np.add.at(counts[0], b, 1)
            if good.get(i) and not fold(i):
                np.add.at(counts[1], b, 1)
    ratios = plain_ratios(*counts)
    weights = {i: importance.log_weight(ratios, t) for i, t in rows["docs"]}
    checked = [i for i in good if fold(i)]
    threshold = importance.keeping_threshold(np.array([weights[i] for i in checked]), np.array([good[i] for i in checked]))
    k = sum(w >= threshold for w in weights.values())
    keys = {i: weights[i] + rows["noise"][i] for i in weights}
    least = sorted(keys.values(), reverse=True)[k - 1]
    return {i for i, x in keys.items() if x >= least}


def plain_keepers(docs):
    sets = {i: set(common.shingle_set(t).tolist()) for i, t in docs}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i for i in ids if root(i) == i}


def covered(item, text, least=4):
    """Words of an item that greedy tiles cover, by trying all pairs of positions."""
    x, y = item.split(), text.split()
    free_x, free_y, total = [True] * len(x), [True] * len(y), 0
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
            return total
        for i, j in best:
            if all(free_x[i : i + most]) and all(free_y[j : j + most]):
                free_x[i : i + most] = free_y[j : j + most] = [False] * most
                total += most


def test_stages(spark, tables):
    from pyspark.sql import functions as F

    d, bench = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    labels = [tuple(r) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    text = {}
    for name, stage in cp.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        text[name] = dict(rows)
        path = common.new_path(spark, f"test-{name}")
        stage(spark, docs, d).write.parquet(path)
        extra = docs
        docs = spark.read.parquet(path)
        if name == "packing":
            break
        assert docs.columns == columns and sorted(docs.dtypes) == sorted(extra.dtypes)
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            noise = {r.doc_id: r.g for r in extra.select("doc_id", importance.gumbel(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), common.text_or_empty("text")).alias("g")).collect()}
            folds = {r.doc_id: r.f == 0 for r in extra.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(importance.FOLDS)).alias("f")).collect()}
            want = plain_quality({"docs": rows, "noise": noise, "folds": folds}, labels)
            assert set(got) == want
            assert not any(i % 10 in (0, 1) for i in got if i < 400) and sum(i % 10 > 2 for i in got) > 250
        elif name == "near_duplicates":
            assert set(got) == plain_keepers(rows)
        elif name == "decontamination":
            assert set(got) == {i for i, t in rows if not any(covered(b, t or "") >= 15 for b in bench)}
        elif name == "redaction":
            patterns = Counter(c[4] for _, t in rows for c in pii.candidates(t or ""))
            classifier = pii.Classifier(patterns)
            yes = {p for p in patterns if classifier.accepts(p)}
            assert got == {i: None if t is None else pii.redact(t, yes) for i, t in rows}
            assert not any("@mail" in (t or "") for t in got.values()) and sum("[EMAIL]" in (t or "") for t in got.values()) > 20
    pieces = Counter((r.doc_id, r.start, r.length) for r in docs.collect())
    expected = Counter()
    for i, t in rows:
        n = len((t or "").split()) + 1
        expected.update((i, k, min(2048, n - k)) for k in range(0, n, 2048))
    assert pieces == expected
    run = cp.run(spark, d)
    assert run.columns == docs.columns and sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))


def test_stages_on_empty_tables(spark, tables, tmp_path):
    d, _ = tables
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "redaction", "packing"]
    assert os.path.dirname(os.path.abspath(cp.__file__)) == os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
