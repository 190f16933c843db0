"""Header fields of notices."""

from tallyspark.operators import extract

BLANK = "  " * 7
# An invented notice: a company that moves from one canton to another, told in every optional part.
MOVE = f"""Mutation Testwerk Nordstern GmbH, Wolfwil, neu Muri AG
Testwerk Nordstern GmbH (Northstar Testing Ltd) (Etoile du Nord Essais Sàrl)
c/o Treuhand Sonnenblick
Am Probeplatz 700
5630 Muri AG
Bisher
Musterallee 88b
4628 Wolfwil
{BLANK}
Testwerk Nordstern GmbH in Liquidation (Northstar Testing Ltd), bisher in Wolfwil, CHE-900.800.700, Gesellschaft mit beschränkter Haftung (SHAB Nr. 3 vom 04.01.2021, Publ. 42). Neuer Sitz: Muri AG.
{BLANK}
Tagesregister-Nr. 77 vom 31.12.2021
{BLANK}
Vorangehende Publikation im SHAB: Nr. 3, Datum: 04.01.2021
{BLANK}
Kontaktstelle: Handelsregisteramt des Kantons Aargau"""
NEW = f"""Neueintragung Haus + Co, die Bauer, Visp
Haus + Co, die Bauer
Dorfstrasse 7b
3930 Visp

Haus + Co, die Bauer, in Visp, CHE-111.222.333, Dorfstrasse 7b, 3930 Visp, schweizerische Zweigniederlassung (Neueintragung). Zweck: Bau.

Kontaktstelle: Handelsregister Oberwallis"""
CORRECTION = "Mutation X\nX\n\nBerichtigung des im SHAB vom 11.11.2025 publizierten Eintrags Nr. 4 vom 06.11.2025 Eck AG, in Zug, CHE-111.222.333, Aktiengesellschaft (SHAB Nr. 1 vom 02.01.2025, Publ. 7)."
BROKEN = "Mutation X\nX\n\nBerichtigung eines Eintrags Eck AG, in Zug, CHE-111.222.333, Aktiengesellschaft (SHAB Nr. 1 vom 02.01.2025, Publ. 7)."


def fields(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return [r.asDict() for r in extract.notice_fields(df).orderBy("doc_id").collect()]


def test_relocation(spark):
    (r,) = fields(spark, MOVE)
    assert {k: v for k, v in r.items() if k not in ("doc_id", "text")} == {
        "language": "de", "act_type": "mutation", "company_name_full": "Testwerk Nordstern GmbH in Liquidation", "company_name_base": "Testwerk Nordstern GmbH", "status_suffix": "in Liquidation",
        "alternative_names": ["Northstar Testing Ltd", "Etoile du Nord Essais Sàrl"], "uid": "CHE-900.800.700", "legal_form": "GmbH", "seat_municipality": "Wolfwil", "seat_canton": "SO",
        "address_care_of": "Treuhand Sonnenblick", "address_street": "Am Probeplatz 700", "address_postcode": "5630", "address_municipality": "Muri AG", "tagesregister_nr": "77",
        "tagesregister_date": "2021-12-31", "prior_publication_shab_nr": 3, "prior_publication_date": "2021-01-04", "prior_publication_id": "42", "authority": "Handelsregisteramt des Kantons Aargau",
    }


def test_first_registration_and_commas_in_names(spark):
    (r,) = fields(spark, NEW)
    assert (r["act_type"], r["company_name_full"], r["legal_form"], r["seat_municipality"], r["seat_canton"]) == ("neueintragung", "Haus + Co, die Bauer", "Zweigniederlassung", "Visp", "VS")
    assert (r["prior_publication_id"], r["status_suffix"], r["address_street"], r["address_postcode"]) == (None, None, "Dorfstrasse 7b", "3930")


def test_corrections_give_whole_names_or_none(spark):
    a, b = fields(spark, CORRECTION, BROKEN)
    assert a["company_name_full"] == "Eck AG" and b["company_name_full"] is None and b["uid"] == "CHE-111.222.333"


def test_texts_without_notice(spark):
    for r in fields(spark, "", None, "nothing\n\nhere", "\n\n"):
        assert r["uid"] is None and r["company_name_full"] is None and r["authority"] is None and not r["alternative_names"]


def test_the_plan_splits_a_text_once(spark):
    df = extract.notice_fields(spark.createDataFrame([("x",)], "text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 25 and len(plan) < 40_000


def test_tables(spark):
    assert [r[0] for r in spark.createDataFrame([("Amt Unterwallis",), ("Kanton Bern",), ("Basel-Stadt",), ("x",)], "a string").select(extract.canton_of(spark_col("a"))).collect()] == ["VS", "BE", "BS", None]
    assert [r[0] for r in spark.createDataFrame([("4556",), ("6052",), ("6053",), (None,)], "p string").select(extract.canton_of_postcode(spark_col("p"))).collect()] == ["SO", "NW", None, None]


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)
