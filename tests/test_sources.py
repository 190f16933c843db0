"""Readers, writers and contract records."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import frame, records
from tallyspark.sources import listings, readers, versions, writers


def test_json_records(spark, tmp_path):
    for name, body in {"0002": {"doc_id": "x2", "n": 1}, "0001": {"n": 2}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    assert sorted(map(tuple, readers.json_records(spark, str(tmp_path), "doc_id string, n int").collect())) == [("0001", 2), ("x2", 1)]
    (tmp_path / "0003.json").write_text("{bad")
    with pytest.raises(Exception):  # noqa: B017
        readers.json_records(spark, str(tmp_path), "doc_id string, n int").collect()


def test_texts_and_selection(spark, tmp_path):
    for i in ("0001", "0002", "0003"):
        (tmp_path / f"{i}.txt").write_text(f"text {i}\nzwei\n", encoding="utf-8")
    t = readers.texts(spark, str(tmp_path))
    assert {(r.doc_id, r.text) for r in t.collect()} == {(i, f"text {i}\nzwei\n") for i in ("0001", "0002", "0003")}
    gold = spark.createDataFrame([("0003",), ("0001",)], "doc_id string")
    assert sorted(r.doc_id for r in readers.discover(t, gold).collect()) == ["0001", "0003"]
    assert [r.doc_id for r in readers.select_docs(t, ["0003", "0001", "0002"], 2).collect()] == ["0003", "0001"]
    with pytest.raises(ValueError):
        readers.select_docs(t, ["0009"])
    with pytest.raises(ValueError):
        readers.require_complete(t, gold)
    readers.require_complete(gold, t, gold)


def test_cells_round_trip(spark, tmp_path):
    rows = [("1", "", None), ("2", 'a "b", c\nd', "null"), ("3", "ü", "")]
    path = str(tmp_path / "cells")
    df = spark.createDataFrame(rows, "k string, a string, b string")
    writers.write_cells(df, path)
    assert sorted(map(tuple, readers.cell_table(spark, path, df.schema).collect())) == rows
    with pytest.raises(Exception):  # noqa: B017
        writers.write_audit(df, path)
    writers.write_audit(df.limit(1), path, force=True)
    with pytest.raises(ValueError):
        writers.write_audit(df, "/x/data/audit")


def test_reports(spark, tmp_path):
    m = spark.createDataFrame([("a", 1, 2, 0.5)], "metric string, num int, den int, value double")
    path = str(tmp_path / "r.json")
    for _ in range(2):
        writers.write_json(writers.metric_report(m), path, spark)
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": {"num": 1, "den": 2, "value": 0.5}}
    assert writers.text_table(m, ["metric", "num"]).splitlines()[-1] == "a       1"
    assert writers.markdown_table(m, ["metric"]) == "| metric |\n| --- |\n| a |"
    assert {(r.x, r.n) for r in writers.zero_filled(spark.createDataFrame([("a", 3)], "x string, n int"), ["a", "b"], "x").collect()} == {("a", 3), ("b", 0)}


def test_listings(spark):
    html = '<div class="entry" id="e1" data-number="N-1"><a href="/1">First <b>x</b></a></div><p>2 Treffer</p><div class="entry big" id="e2"><span> HR01-22 </span><a href="/2">Second</a><a href="/3">Third</a></div>'
    df = spark.createDataFrame([("zh_2026-08-18.html", html)], "file string, html string")
    assert [(r.position, r.id, r.publication_number, r.url) for r in listings.listing_entries(df).collect()] == [(1, "e1", "N-1", "/1"), (2, "e2", "HR01-22", "/2")]
    assert df.select(readers.reported_total(F.col("html"))).first()[0] == 2
    assert tuple(df.select(*readers.listing_name(F.col("file"))).first()) == ("ZH", "2026-08-18")
    with pytest.raises(Exception):  # noqa: B017
        spark.createDataFrame([("x.html",)], "file string").select(*readers.listing_name(F.col("file"))).collect()


def test_nested_and_broken_listings():
    parse = lambda html, entry="entry": list(listings.parse_listing(html, entry))
    nested = '<div class="list-entry x" id="a"><div class="list-col"><div>01.02.2026 - ZH-7 - Blatt &amp; Co</div><br><img src="i"></div><div><a>no link</a><a href="/a"><i>T</i>itle\n two</a></div><div class="entry"><a href="/in">In</a></div><span>AB1</span></div><div class="entrys"></div>'
    assert parse(nested) == [(1, "a", "ZH-7", "Title two", "/a", "2026-02-01", "Blatt & Co"), (2, None, None, "In", "/in", None, None)]
    assert parse(None) == parse("") == parse("<p>none</p>") == [] and len(parse('<div class="entry">' * 500)) == 500


def test_versions(spark, tmp_path):
    path, df = f"file://{tmp_path}/t", lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    read = lambda v=None: sorted(r.i for r in versions.as_of(spark, path, v).collect())
    with pytest.raises(ValueError):
        read()
    assert [versions.commit(df(1, 2), path), versions.commit(df(3), path)] == [1, 2]
    assert read(1) == [1, 2] and read(2) == read() == [1, 2, 3]
    assert versions.commit(df(9), path, replace=True) == 3 and versions.commit(df(8), path) == 4
    assert read() == [8, 9] and read(3) == [9] and read(2) == [1, 2, 3]
    (tmp_path / "t" / "_log" / "000000000005.json").write_text('{"folder": "none", "replace": true}')  # another writer's
    assert versions.commit(df(7), path) == 6
    with pytest.raises(ValueError):
        read(7)


def test_counters_and_swaps(spark):
    pages = spark.createDataFrame([(1, 2), (2, 1), (3, None), (4, 0)], "k int, total int")
    entries = spark.createDataFrame([(1,), (1,), (2,), (2,)], "k int")
    checks = frame.count_checks(pages, entries, "k", "total")
    assert {(r.k, r.n, r.status) for r in checks.collect()} == {(1, 2, "ok"), (2, 2, "incomplete"), (3, 0, "no_counter"), (4, 0, "ok")}
    frame.require_counts(checks.filter("k IN (1, 4)"), "k")
    with pytest.raises(ValueError, match="2 .incomplete: 2.*3"):
        frame.require_counts(checks, "k")
    owners = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 5), (5, 6), (6, 4), (7, None)], "p int, o int")
    assert {r.p for r in frame.swapped(owners, "p", "o").filter("swapped").collect()} == {1, 2}


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "j string").select(expr.alias("x")).first().x


def test_tags_come_from_the_source(spark):
    got = one(spark, '{"a": "1", "b": 1, "c": 1.0, "d": true, "e": null, "f": [1], "g": {"h": 2}, "i": "true"}', records.tagged_entries(F.col("j")))
    assert {k: v.t for k, v in got.items()} == {"a": "str", "b": "int", "c": "float", "d": "bool", "e": "null", "f": "list", "g": "dict", "i": "str"}
    assert got["a"].s == "1"
    assert one(spark, "[1]", records.tagged_entries(F.col("j"))) == {} and one(spark, None, records.tagged_entries(F.col("j"))) == {}


def test_lists_and_entries(spark):
    items, kind = records.coerce_list(F.col("j"))
    assert one(spark, '{"name": "A"}', items) == ['{"name": "A"}'] and one(spark, '{"name": "A"}', kind) == "dict"
    assert one(spark, "none", items) == [] and one(spark, None, items) == []
    objects, issues = records.project_entries(items, ["name", "role"])
    text = '[{"name": "A", "role": null, "x": 1}, "B", {"name": "C"}]'
    assert one(spark, text, objects) == [{"name": "A", "role": None}, {"name": "C"}]
    assert one(spark, text, issues) == ["0: extra: x", "1: not an object", "2: missing: role"]


def test_extras_and_contract(spark):
    kept, nulls, odd = records.clean_extras(F.col("j"), ["a"])
    text = '{"a": "1", "b": null, "c": 2}'
    assert one(spark, text, kept) == {"a": "1", "c": "2"} and one(spark, text, nulls) == ["b"] and one(spark, text, odd) == ["c"]
    r = records.to_contract(spark.createDataFrame([("d", '{"b": 1, "z": 2}')], "id string, j string"), "j", ["a", "b"]).first()
    assert (r.id, r.a, r.b, r.missing_keys, r.extra_keys) == ("d", None, "1", ["a"], ["z"])
    assert records.registry_from_markdown("- `a`, `b` — uses `c`\ntext `d`\n* `a` — x") == ["a", "b"]


def test_tables_leave_no_rows_out(spark):
    rows = spark.range(201).withColumnRenamed("id", "n")
    for table in (writers.text_table, writers.markdown_table):
        with pytest.raises(ValueError):
            table(rows, ["n"])
        assert len(table(rows.limit(200), ["n"]).splitlines()) == 202 == len(table(rows, ["n"], most=201).splitlines()) - 1
