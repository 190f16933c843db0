"""Renderings, address lines, and literal cross-checks of a record's own fields."""

from pyspark.sql import functions as F

from tallyspark.functions import formats
from tallyspark.operators import crosscheck


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("x")).first().x


def test_renderings(spark):
    v = F.col("v")
    assert one(spark, "2024-08-29", formats.renderings("date", v)) == ["2024-08-29", "29.08.2024"]
    assert one(spark, "soon", formats.renderings("date", v)) == ["soon"]
    assert one(spark, 1000000, formats.renderings("int", v), "bigint") == ["1000000", "1'000'000"]
    assert one(spark, 223, formats.renderings("int", v), "bigint") == ["223"]
    assert one(spark, 189123.5, formats.renderings("number", v), "double") == ["189123.5", "189'123.50"]
    assert one(spark, None, formats.renderings("str", v)) == []


def test_address_lines(spark):
    v = F.col("v")
    text = "Muster AG\nc/o Eva Rot\nWeg 1\n8000 Zürich\n\n3000 Bern\nBisher\nGasse 2 \n 8001 Zürich\nEnde"
    assert one(spark, text, formats.join_address_lines(v)) == "Muster AG\nc/o Eva Rot, Weg 1, 8000 Zürich\n\n3000 Bern\nBisher\nGasse 2 , 8001 Zürich\nEnde"
    assert one(spark, "", formats.join_address_lines(v)) == "" and one(spark, None, formats.join_address_lines(v)) is None


def test_small_texts(spark):
    v = F.col("v")
    assert one(spark, "Mutation  X\tAG\r\nmore", formats.first_line(v)) == "Mutation X AG"
    assert one(spark, "a {t} b", formats.fill_template(v, {"{t}": F.lit("$1")})) == "a $1 b"
    df = spark.createDataFrame([("deep-infra/fp8", "DeepInfra"), ("a", "b"), (None, "b")], "p string, s string")
    assert [r[0] for r in df.select(formats.provider_mismatch(F.col("p"), F.col("s"))).collect()] == [False, True, None]


def test_crosscheck_fields(spark):
    text = "Muster AG\nWeg 1\n8000 Zürich\n\nMuster AG, Kapital CHF 100'000.00 vom 29.08.2024."
    df = spark.createDataFrame([("1", text, "Muster AG", "2024-08-29", 100000.0, "Weg 1, 8000 Zürich", "ZH", None), ("2", None, "X", None, None, None, None, None)], "doc_id string, text string, name string, date string, capital double, address string, canton string, none string")
    out = crosscheck.crosscheck_fields(df, ["doc_id"], {"name": "str", "date": "date", "capital": "number", "address": "str", "canton": "str", "none": "str"}, expected_missing=("canton",))
    assert {(r.doc_id, r.field, r.n, r.status, r.expected) for r in out.collect()} == {("1", "name", 2, "ambiguous", False), ("1", "date", 1, "unique", False), ("1", "capital", 1, "unique", False), ("1", "address", 1, "unique", False), ("1", "canton", 0, "missing", True), ("2", "name", 0, "missing", False)}
