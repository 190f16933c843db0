"""Every query with SQL equals that SQL on the smallest tables."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import DataFrame

from tallyspark.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(x):
    if x is None or x != x or str(x) in ("<NA>", "NaT"):
        return None
    if isinstance(x, float):
        return round(x, 7)
    return x.item() if hasattr(x, "item") else x


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(str([plain(v) for v in r]) for r in pdf[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(name, spark, duck):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(name, spark):
    out = catalog.QUERIES[name](spark, SF)
    assert isinstance(out, DataFrame) and out.count() > 0


def test_order_of_partitions_does_not_matter(spark, tmp_path):
    """The same result from one and from many input files."""
    for n in (1, 17):
        for t in ("orders", "lineitem", "labels", "documents"):
            spark.read.parquet(f"{SF}/{t}.parquet").repartition(n).write.parquet(f"{tmp_path}/{n}/{t}.parquet")
    for name in ("ordinal_match", "bootstrap_ci", "consensus_candidates", "trivial_mode"):
        one, many = (rows(catalog.QUERIES[name](spark, f"{tmp_path}/{n}").toPandas()) for n in (1, 17))
        assert one == many, name


def test_headline_metrics_have_every_family(spark):
    got = {(r.run_id, r.metric): r for r in catalog.QUERIES["headline_metrics"](spark, SF).collect()}
    one = catalog.QUERIES["list_prf"](spark, SF).first()
    assert got["-", "parts_found_f1"].value == one.f1 and got["-", "parts_attribute_accuracy"].value == one.attribute_accuracy
    assert got["-", "labels_micro_f1"].value == catalog.QUERIES["label_micro_macro"](spark, SF).filter("label = '(micro)'").first().f1
    keys = catalog.QUERIES["map_key_prf"](spark, SF).groupBy().sum("tp", "fp", "fn").first()
    assert (got["-", "extras_key_f1"].num, got["-", "extras_key_f1"].den) == (2 * keys[0], 2 * keys[0] + keys[1] + keys[2])
    assert got["-", "extras_value_accuracy"].value == catalog.QUERIES["map_value_accuracy"](spark, SF).filter("name = 'k'").first().value_accuracy
    for run in ("r1", "r5"):
        assert 0 < got[run, "parse_failure_rate"].value < 0.1
        parts = [got[run, f"{f}_null_accuracy_normalized"] for f in ("status", "priority")]
        assert got[run, "group_coded_null_accuracy_normalized"].den == sum(p.den for p in parts)


def test_no_ids_are_left_out(spark):
    docs, labels = ({r[0] for r in spark.read.parquet(f"{SF}/{t}.parquet").select("doc_id").collect()} for t in ("documents", "labels"))
    assert tuple(catalog.QUERIES["split_sets"](spark, SF).first()) == (len(docs & labels), len(docs | labels))
    cells = catalog.QUERIES["score_cells"](spark, SF).filter("outcome_normalized <> 'no_output'")
    keys = {run: {tuple(r) for r in cells.filter(f"run_id = '{run}'").select("doc_id", "field").collect()} for run in ("r1", "r2")}
    sides = {r[0]: r[1] for r in catalog.QUERIES["before_after"](spark, SF).groupBy("side").sum("n").collect()}
    assert sides == {"both": len(keys["r1"] & keys["r2"]), "left_only": len(keys["r1"] - keys["r2"]), "right_only": len(keys["r2"] - keys["r1"])}


def test_intervals_rest_on_10_000_draws(spark, duck):
    """Both bootstrap queries against brute force with the number of draws of the reference."""
    n_draws, seed = 10_000, 20261011
    bucket = lambda kind, i: int(hashlib.md5(f"{kind}|{i}".encode()).hexdigest()[:4], 16) % 100
    labels = duck.sql("SELECT doc_id, quality, toxic FROM labels").fetchall()
    docs = sorted(labels, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
    terms = np.array([[bucket("a", i) < 80, 1, t == 1 and bucket("b", i) < 70, t == 1] for i, _, t in docs], float)
    idx = np.array([[int(hashlib.md5(f"{seed}|{b}|{k}".encode()).hexdigest()[:8], 16) % len(docs) for k in range(len(docs))] for b in range(n_draws)])
    a_num, a_den, b_num, b_den = terms[idx].sum(axis=1).T
    assert (b_den > 0).all()
    for v, metric in ((a_num / a_den, "a"), (b_num / b_den, "b")):
        r = catalog.QUERIES["bootstrap_ci"](spark, SF).filter(f"metric = '{metric}'").first()
        assert (r.n_valid, r.ci_low, r.ci_high) == (n_draws, *(pytest.approx(x, abs=1e-8) for x in np.percentile(v, [2.5, 97.5])))
    low, high = np.percentile(a_num / a_den - b_num / b_den, [2.5, 97.5])
    r = catalog.QUERIES["paired_bootstrap"](spark, SF).first()
    assert (r.n_valid, r.ci_low, r.ci_high, r.includes_zero) == (n_draws, pytest.approx(low, abs=1e-8), pytest.approx(high, abs=1e-8), low <= 0 <= high)


@pytest.mark.parametrize("name", ["consensus_candidates", "audit_methods", "unanimous_cells", "subset_rescore", "perfect_docs"])
def test_cells_of_a_document_are_grouped_where_they_are_made(name, spark):
    """Records are shuffled, their cells are not; nor are cells joined."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(o_orderkey" in plan and "hashpartitioning(doc_id" not in plan
    assert name == "perfect_docs" or "Join" not in plan
