"""Consistency rules: one notice that breaks none, then one change for each rule."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import gold_rules

PERSON = "struct<name:string,nationality:string,heimatort:string,domicile:string,role:string,signature:string,uid:string,stammanteile:bigint>"
CHANGE = "struct<name_new:string,name_previous:string,domicile_new:string,domicile_previous:string,role_new:string,role_previous:string,signature_new:string,signature_previous:string,nationality_new:string,nationality_previous:string,heimatort_new:string,heimatort_previous:string,stammanteile_new:bigint,stammanteile_previous:bigint>"
SCHEMA = (
    "doc_id string, text string, schema_version string, act_type string, act_subtypes array<string>, alternative_names array<string>, act_date string, tagesregister_date string, prior_publication_date string, "
    f"canton_previous string, canton_new string, domicile_new string, domicile_previous string, persons_added array<{PERSON}>, persons_removed array<{PERSON}>, persons_changed array<{CHANGE}>, extras map<string,string>, uncertain array<string>, _verified boolean"
)
TEXT = "Mutation Muster AG\nMuster AG\nWeg 1\n8000 Zürich\n\nMuster AG, in Zürich, CHE-111.222.333, Aktiengesellschaft (SHAB Nr. 3 vom 01.02.2020, S. 12). {body}\n"
GOOD = {
    "doc_id": "1", "text": TEXT.format(body="Zweck neu."), "schema_version": "1.0", "act_type": "mutation", "act_subtypes": [], "alternative_names": [], "act_date": "2025-01-01", "tagesregister_date": "2025-01-02",
    "prior_publication_date": "2024-01-01", "canton_previous": None, "canton_new": None, "domicile_new": None, "domicile_previous": None, "persons_added": [], "persons_removed": [], "persons_changed": [],
    "extras": {"prior_publication_page": "12"}, "uncertain": [], "_verified": True,
}


def person(**k):
    return {f.split(":")[0]: None for f in PERSON[7:-1].split(",")} | k


def change(**k):
    return {f.split(":")[0]: None for f in CHANGE[7:-1].split(",")} | k


def findings(spark, **changes):
    body = changes.pop("body", None)
    r = GOOD | changes | ({"text": TEXT.format(body=body)} if body else {})
    return {(x.rule, x.field) for x in gold_rules.sweep_gold(spark.createDataFrame([r], SCHEMA)).collect()}


def test_a_consistent_record_has_no_findings(spark):
    assert findings(spark) == set()


@pytest.mark.parametrize(
    ("changes", "expected"),
    [
        ({"extras": {}}, {("prior_publication_page", "extras.prior_publication_page")}),
        ({"extras": {}, "uncertain": ["extras"]}, set()),
        ({"body": "Domizil neu: Gasse 2, 8001 Zürich."}, {("domicile", "domicile_new")}),
        ({"body": "Domizil neu: x. [bisher: Gasse 2, 8001 Zürich]."}, {("domicile", "domicile_new"), ("domicile", "domicile_previous")}),
        ({"body": "Weitere Adressen: x [bisher: Gasse 2, 8001 Zürich]."}, set()),
        ({"domicile_new": "x"}, {("domicile", "domicile_new")}),
        ({"persons_added": [person(name="A, B", nationality="deutsche")]}, {("nationality", "persons_added[A, B].nationality")}),
        ({"extras": {"prior_publication_page": "12", "loeschung_reason": "nicht da"}}, {("loeschung_reason", "extras.loeschung_reason")}),
        ({"extras": {"prior_publication_page": "12", "mitteilungen": "Mitteilungen per Brief"}}, {("mitteilungen", "extras.mitteilungen")}),
        ({"body": "Sitz neu: Bern."}, {("sitzverlegung", "act_subtypes")}),
        ({"act_subtypes": ["sitzverlegung"]}, {("sitzverlegung", "act_subtypes")}),
        ({"body": "Es wird auf eine eingeschränkte Revision verzichtet."}, {("revision", "extras.revision")}),
        ({"body": "100 Namenaktien zu CHF 10."}, {("nominal_value_chf", "extras.nominal_value_chf")}),
        ({"body": "Eingetragene Personen neu oder mutierend: Rot, Eva, deutsche Staatsangehörige, in Bern [bisher: x; y]; Blau, Max, in Chur.", "persons_changed": [change(name_new="Rot, Eva"), change(name_new="Blau, Max")]}, {("persons_changed", "persons_changed[Rot, Eva].nationality_new")}),
    ],
)
def test_each_rule(spark, changes, expected):
    assert findings(spark, **changes) == expected


def test_entries_split_outside_brackets(spark):
    df = spark.createDataFrame([("a [x; y]; b; ; c [z]",), ("",)], "s string")
    assert [r[0] for r in df.select(gold_rules.split_entries(F.col("s"))).collect()] == [["a [x; y]", "b", "c [z]"], []]


@pytest.mark.parametrize(
    ("changes", "expected"),
    [
        ({}, set()),
        ({"prior_publication_date": "2025-01-02"}, {"prior_publication_date"}),
        ({"act_date": "2025-01-03"}, {"act_date"}),
        ({"act_date": "2025-02-30"}, set()),
        ({"act_type": "loeschung", "persons_added": [person(name="A")]}, {"persons_added"}),
        ({"persons_removed": [person(name="A")]}, {"act_subtypes"}),
        ({"act_subtypes": ["organaenderung"]}, {"act_subtypes"}),
        ({"canton_new": "BE"}, {"canton_previous"}),
        ({"canton_new": "BE", "uncertain": ["canton_previous"]}, set()),
        ({"uncertain": ["nonsense"]}, {"uncertain"}),
        ({"alternative_names": ["fusion"]}, {"alternative_names"}),
        ({"schema_version": "0.9"}, {"schema_version"}),
        ({"_verified": None}, {"_verified"}),
    ],
)
def test_coherence(spark, changes, expected):
    df = spark.createDataFrame([GOOD | changes], SCHEMA)
    out = gold_rules.coherence(df, ["canton_previous", "extras"], ["fusion", "organaenderung"], version="1.0", verified=True)
    assert {r.field for r in out.collect()} == expected
