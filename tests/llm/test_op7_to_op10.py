"""Top-k, token files, archives and URL verdicts."""

import base64
import gzip
import hashlib
import io
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import common, token_store, top_k, url_filter, warc

# --- top-k --------------------------------------------------------------------------


def plain_top(rows, asks, k):
    vec = {i: np.floor(256 * np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    return {(q, r + 1, c, -s) for q in vec if asks(q) for r, (s, c) in enumerate(sorted((-int(vec[q] @ vec[c]), c) for c in vec if c != q and len(vec[c]) == len(vec[q]))[:k])}


@pytest.mark.parametrize("wave_bytes", [1 << 20, 200])
def test_top_k_equals_sorting(spark, wave_bytes):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(120)] + [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]
    rows += [(300, None), (301, [None, 1.0, 1.0, 1.0]), (305, [float("nan")] * 4), (310, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (315, [1.0, 2.0]), (320, [2.0, 1.0]), (-5, [1.0] * 4), (325, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, score int").repartition(5)
    got = {tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 5 == 0, wave_bytes=wave_bytes).collect()}
    assert got == plain_top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], lambda i: i % 5 == 0, 5)


def test_top_k_with_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in top_k.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 65536)]
    assert top_k.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0 and top_k.top_k(df, F.lit(False)).count() == 0


def test_small_blocks_and_huge_components(spark, monkeypatch):
    for name, value in (("_QUERIES", 3), ("_ROWS", 7), ("WAVE_QUERIES", 10)):
        monkeypatch.setattr(top_k, name, value)
    test_top_k_equals_sorting(spark, 1 << 20)
    df = spark.createDataFrame([(1, [1e30, 1.0]), (2, [1e30, 0.0]), (3, [-1e30, 0.0]), (4, [0.0, 1.0]), (1, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.top_k(df, F.col("vec_id") == 2).collect()]
    # scores beyond 64 bits count as the nearest number; rows that share an id are candidates each
    assert [g[3] for g in sorted(got, key=lambda g: g[1])] == [top_k.MOST - 1, 0, 0, top_k.LEAST + 1] and {g[2] for g in got} == {1, 3, 4}


# --- token files --------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000, 49_408])
def test_codes_round_trip(n):
    rng = np.random.default_rng(n)
    counts = np.zeros(n, int)
    k = max(1, n // 2)
    counts[rng.choice(n, k, replace=False)] = (1e6 / np.arange(1, k + 1) ** 2 + 1).astype(int)
    lengths = token_store.code_lengths(counts)
    assert lengths.max() <= token_store.MAX_BITS and ((lengths > 0) == (counts > 0)).all()
    assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    codes = token_store.canonical(lengths)
    ids = rng.choice(np.flatnonzero(counts), 3001).astype("u4")
    data, at = token_store.pack(ids, lengths, codes)
    table = token_store.decode_table(lengths, codes)
    assert (token_store.unpack(data, len(ids), at, table) == ids).all()
    assert len(at) == -(-len(ids) // token_store.STEP)


def test_length_limited_codes_are_optimal():
    """Against all complete codes of few symbols."""
    import itertools

    rng = np.random.default_rng(7)
    for _ in range(30):
        counts = rng.integers(1, 200, 5)
        best = min(sum(c * x for c, x in zip(counts, ls)) for ls in itertools.product(range(1, 4), repeat=5) if sum(2.0**-x for x in ls) <= 1)
        assert (token_store.code_lengths(counts, 3) * counts).sum() == best


@pytest.mark.parametrize("vocabulary, by_chunks", [(token_store.VOCABULARY, True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_tokenizer(vocabulary, by_chunks):
    e = token_store.Encoder(vocabulary)
    assert (e.split is not None) == by_chunks
    rng = random.Random(5)
    letters = list("abcXYZÉéßİΣςÀ'sdmltvre,.!-_<|>09²½ªº ­\x85\x1c\x1d\x00\x7f \n\t\r\x0b\x0c　́e ﬁ漢字اǅʼn")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(5000)] + ["<|endoftext|>x", "a<|startoftext|> b", "", "don't I'LL", " lead and trail \n"]
    texts += ["<|ENDOFTEXT|>", "x <|StartOfText|>y", "<|endoftext|", "<|EndOfText|><|endoftext|>", "A<|startoftext|><|STARTOFTEXT|>É"]
    assert e(pa.array(texts)) == [np.array(x.ids, e.dtype).tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e(pa.array(["q", *texts])).pop(1) == e(pa.array(texts[:1]))[0] and e(pa.array([], pa.string())) == []


def test_token_store(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["Some", "words,", "und", "mehr", "naïve"], k=rng.randint(0, 60)))) for i in range(200)]
    docs += [(5, "again"), (5, "again"), (None, "no id"), (300, None), (301, "long " * 5000), (-4, "")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, start int").repartition(7)
    monkeypatch.setattr(token_store, "BLOCK_IDS", 500)
    path = common.new_path(spark, "test-store")
    token_store.write_ids(df, path)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.id_digests(spark, path).collect()))
    tok = token_store.Encoder(token_store.VOCABULARY).tokenizer
    at, expected = 0, []
    encoded = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in docs]
    for i, ids in sorted(encoded, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].astype("<u2").tobytes()))):
        expected.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == expected
    empty = common.new_path(spark, "test-store")
    token_store.write_ids(df.limit(0), empty)
    assert token_store.id_digests(spark, empty).count() == 0


# --- archives -----------------------------------------------------------------------


def archive_rows():
    return [
        SimpleNamespace(record_id=str(i), record_type="revisit" if i % 3 == 1 else "response", target_uri=None if i == 4 else f"http://x/é\n{i}", refers_to="0" if i % 3 == 1 else None, payload_digest=f"D{i}", payload_bytes=i * 1000, payload=None if i % 3 == 1 else (b"ab\r\n\r\n" * i * 200)[: i * 1000])
        for i in range(30)
    ]


def test_plain_skippable_and_foreign_archives_read_alike():
    rows = archive_rows()
    plain = b"".join(map(warc.record_bytes, rows))
    members = b"".join(warc.gzip_member(warc.record_bytes(r)) for r in rows)
    foreign = b"".join(gzip.compress(warc.record_bytes(r)) for r in rows)
    assert gzip.decompress(members) == plain
    for accepts in (lambda f: True, lambda f: f["record_type"] == "revisit", lambda f: f["record_id"] in ("3", "29")):
        for payload in (True, False):
            read = [list(warc.read_archive(io.BufferedReader(io.BytesIO(x)), accepts, payload)) for x in (plain, members, foreign)]
            assert read[0] == read[1] == read[2]
            for r in read[0]:
                o = rows[int(r[0])]
                assert r[5] == o.payload_bytes and (r[6] == o.payload if payload and o.record_type == "response" else r[6] is None)


def test_skipped_payloads_are_not_inflated():
    record = warc.record_bytes(SimpleNamespace(record_id="1", record_type="response", target_uri="u", refers_to=None, payload_digest="D", payload_bytes=3_000_000, payload=random.Random(0).randbytes(3_000_000)))

    class Counting(io.BytesIO):
        n = 0

        def read(self, *a):
            data = super().read(*a)
            Counting.n += len(data)
            return data

    assert list(warc.read_archive(Counting(warc.gzip_member(record) * 3), lambda f: False)) == []
    assert Counting.n < 100_000


def test_pages_round_trip(spark):
    docs = [(i, f"http://h/{i}", "<p>é</p>" if i % 4 == 0 else f"page {i}") for i in range(60)] + [(60, None, None), (61, "u", ""), (None, "u", "<p>é</p>"), (56, "twin", "<p>é</p>"), (62, "u", "x\r\n\r\nWARC/1.1\r\n" * 1000)]
    df = spark.createDataFrame([(*r, "x") for r in docs], "page_id bigint, url string, html string, payload string")
    path = common.new_path(spark, "test-warc")
    warc.write_pages(df, path)
    got = sorted(map(tuple, warc.read_pages(spark, path).collect()), key=str)
    expected = []
    for i, _, html in docs:
        b = (html or "").encode()
        ids = [x for x, _, h in docs if (h or "") == (html or "")]
        first = max((x for x in ids if x is not None), default=None)
        expected.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(expected, key=str)
    warc.register(spark)
    rows = spark.read.format("warc").load(path)
    revisits = rows.filter("record_type = 'revisit' AND refers_to IS NOT NULL")
    assert revisits.count() == sum(r[3] == "revisit" for r in expected)
    assert rows.filter("target_uri = 'http://h/3'").select("payload").first().payload == b"page 3"
    assert spark.read.format("warc").option("payload", "false").load(path).filter("payload IS NOT NULL").count() == 0
    small = common.new_path(spark, "test-warc")
    warc.write_pages(df, small, least_bytes=9)
    assert warc.read_pages(spark, small).filter("record_type = 'revisit' AND payload_bytes < 9").count() == 0
    empty = common.new_path(spark, "test-warc")
    warc.write_pages(df.limit(0), empty)
    assert warc.read_pages(spark, empty).count() == 0


def test_later_writes_add_or_replace(spark):
    page = lambda *ids: spark.createDataFrame([(i, f"u{i}", f"text {i}") for i in ids], "page_id bigint, url string, html string")
    ids = lambda: sorted(r.page_id for r in warc.read_pages(spark, path).collect())
    path = common.new_path(spark, "test-warc")
    warc.write_pages(page(1, 2), path)
    warc.write_pages(page(3, 4), path)
    assert ids() == [1, 2, 3, 4]
    warc.write_pages(page(5), path, mode="overwrite")
    assert ids() == [5]
    warc.write_pages(page(6), path)
    assert ids() == [5, 6]
    warc.write_pages(page(7).limit(0), path, mode="overwrite")
    assert ids() == []
    files = [f for f in __import__("os").listdir(path.removeprefix("file://")) if not f.startswith(".")]
    assert not [f for f in files if f.startswith("part-")] and len([f for f in files if f.startswith("MANIFEST")]) == 1


# --- URL verdicts -------------------------------------------------------------------


def test_rules(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "HTTP://A.Example.NET/en/1?q": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "https://example.com/fr/": ("example.com", "/fr/", None, "allow"),
        "http://w.org/fr/x#y": ("w.org", "/fr/x", "org/fr/", "allow"),
        "http://x.net": ("x.net", "", None, "allow"),
        "http://notnet/": ("notnet", "/", None, "allow"),
        "http://casino.example.com/en": ("casino.example.com", "/en", None, "block"),
        "http://casino.org/fr/": ("casino.org", "/fr/", "org/fr/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "a?x://b.c/d://e": ("b.c", "/d://e", None, "allow"),
        "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*cases, None])], "page_id int, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, url_filter.listed_words(F.col("host"))).collect()}
    assert got == dict(enumerate([*cases.values(), ("", "", None, "allow")]))
    assert url_filter.judge_urls(df.limit(0), F.lit(False)).count() == 0


@pytest.mark.parametrize(("listed", "others"), [(300, 30_000), (0, 50), (50, 0), (20_000, 100)])
def test_cascade_is_exact(spark, listed, others):
    df = spark.range(listed + others).select(F.concat(F.lit("host"), "id").alias("key"), (F.col("id") < listed).alias("listed"))
    df = df.unionByName(df.limit(10)).unionByName(spark.createDataFrame([(None, True)], "key string, listed boolean"))
    c = url_filter.build_cascade(df)
    assert len(c.levels) >= 1 + (listed > 0 and others > 1000)
    wrong = df.filter("key IS NOT NULL").withColumn("got", c.column(F.col("key"))).filter("got <> listed").count()
    assert wrong == 0
    assert df.filter("key IS NULL").select(c.column(F.col("key"))).first()[0] is False


def test_several_cascades_and_a_list_table(spark, monkeypatch):
    """A list as a table, with keys parted into cascades of a small bound: the same verdicts as one cascade and as plain membership."""
    hosts = [f"H{i % 700}.example{i % 3}.org" for i in range(1500)]
    pages = spark.createDataFrame([(i, f"http://{h}/{i}", True) for i, h in enumerate(hosts)] + [(1, f"http://{hosts[1]}/1", False), (2000, None, True)], "page_id bigint, url string, listed boolean")
    names = sorted({h.lower() for h in hosts[::5]}) + ["elsewhere.net"]
    table = spark.createDataFrame([(n.upper(), 1) for n in names] + [(names[0], 2), (None, 3)], "name string, x int")
    built = []
    plain = url_filter._build
    monkeypatch.setattr(url_filter, "_build", lambda keys: built.append(plain(keys)) or built[-1])
    many = sorted(map(tuple, url_filter.judge_urls(pages, table, rules=[], max_bytes=400).select("page_id", "host", "verdict", "listed").collect()), key=str)
    assert len(built) >= 3 and max(c.nbytes() for c in built) <= 2 * 400
    one = sorted(map(tuple, url_filter.judge_urls(pages, table, rules=[]).select("page_id", "host", "verdict", "listed").collect()), key=str)
    known = set(names)
    assert one == many and all(r[3] == (r[1] in known) and r[2] == ("block" if r[3] else "allow") for r in one) and len(one) == 1502
    assert url_filter.judge_urls(pages, table.limit(0)).filter("listed").count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([(1, "http://" + "a" * 200_000 + "/x")], "page_id int, url string"), table).first().verdict == "allow"
