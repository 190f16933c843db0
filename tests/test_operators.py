"""Semantics of the operators on small hand-made cases."""

import math
import random
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import values
from tallyspark.operators import cells, corrections, crosscheck, frame, match, metrics, repair, report, resample, rules, stats, vote


def column(spark, schema, data, expr):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


@pytest.mark.parametrize(("gold", "pred", "expected"), [(None, None, "correct_null"), (None, "a", "hallucination"), ("a", None, "omission"), ("a", "a", "correct"), ("a", "b", "wrong")])
def test_five_outcomes(spark, gold, pred, expected):
    g, p = F.col("g"), F.col("p")
    assert column(spark, "g string, p string", [(gold, pred)], cells.classify(g, p, g == p)) == [expected]


def test_no_output_and_uncertain(spark):
    g, p = F.col("g"), F.col("p")
    out = column(spark, "g string, p string, n boolean, u boolean", [("a", None, True, False), ("a", None, True, True), ("a", "a", False, False)], cells.outcome(g, p, g == p, F.col("n"), F.col("u")))
    assert out == ["no_output", "excluded_uncertain", "correct"]


def test_normalization(spark):
    texts = ["Straße  12", " A\tB\n", "Zürich", "ÉCOLE", None, ""]
    exact = column(spark, "t string", [(t,) for t in texts], values.normalize_exact("t"))
    assert exact == ["strasse 12", "a b", "zürich", "école", None, ""]
    native = column(spark, "t string", [(t,) for t in texts if t != "Zürich"], values.normalize(F.col("t")))
    assert native == [e for e in exact if e != "zürich"]


@pytest.mark.parametrize(
    ("g", "p", "exact", "normalized"),
    [
        (("int", "100000"), ("float", "100000.0"), False, True),
        (("bool", "true"), ("int", "1"), False, False),
        (("int", "5"), ("str", "5"), False, True),
        (("int", "1000"), ("str", "1'000"), False, False),
        (("str", "007"), ("str", "7"), False, False),
        (("str", "AG "), ("str", "ag"), False, True),
        (("str", "x"), ("str", "x"), True, True),
    ],
)
def test_typed_equality(spark, g, p, exact, normalized):
    c = [F.col(x) for x in ("gt", "gs", "pt", "ps")]
    df = spark.createDataFrame([(*g, *p)], "gt string, gs string, pt string, ps string")
    assert tuple(df.select(values.equal_exact(*c), values.equal_normalized(*c)).first()) == (exact, normalized)


def test_tags(spark):
    texts = ["1", "1.0", "1e3", "12345678901234567890123", "true", "null", '"a"', "[1]", "{}"]
    assert column(spark, "t string", [(t,) for t in texts], values.tag_json(F.col("t"))) == ["int", "float", "float", "int", "bool", "null", "str", "list", "dict"]


def test_matchers(spark):
    long = "a" * 150
    g, p = F.col("g"), F.col("p")
    pairs = [(long, long[:120] + "…"), (long, long[:50]), ("short", "short"), ("short", "sho"), ("short", "short and more"), ("abc", "x")]
    assert column(spark, "g string, p string", pairs, values.prefix_match(g, p)) == [True, False, True, False, True, False]
    pairs = [("abc", "b"), ("b", "ABC"), ("", "abc"), ("", ""), ("x", "y")]
    assert column(spark, "g string, p string", pairs, values.containment_match(g, p)) == [True, True, False, True, False]


def test_sets_occurrences_snippets(spark):
    g, p = F.col("g"), F.col("p")
    assert column(spark, "g array<string>, p array<string>", [(["a", "b"], ["b", "a", "a"]), ([], None), (["a"], [])], cells.set_outcome(g, p)) == ["correct", "correct_null", "omission"]
    assert column(spark, "g string, p string", [("aaaa", "aa"), ("abc", ""), ("abc", "x")], values.occurrences(g, p)) == [2, 0, 0]
    assert column(spark, "g string, p string", [("one  two three", "two"), ("a", "b")], values.snippet(g, p, 4)) == ["ne two thr", None]


def test_ordinal_match_keeps_namesakes_apart(spark):
    s = "d int, name string, pos int, v string"
    gold = spark.createDataFrame([(1, "x", 0, "a"), (1, "x", 1, "b"), (1, None, 2, "c"), (1, "y", 3, "d")], s)
    pred = spark.createDataFrame([(1, "x", 5, "p"), (1, None, 6, "q"), (1, "z", 7, "r")], s)
    got = {(r.name, r.gold_v, r.pred_v, r.status) for r in match.ordinal_match(gold, pred, ["d"], "name", ["pos"]).collect()}
    assert got == {("x", "a", "p", "matched"), ("x", "b", None, "missed"), (None, "c", None, "missed"), (None, None, "q", "spurious"), ("y", "d", None, "missed"), ("z", None, "r", "spurious")}


def test_unregistered_shared_key_counts_twice(spark):
    g = spark.createDataFrame([(1, "a", "1"), (1, "odd", "2"), (1, "gone", "3")], "d int, name string, value string")
    p = spark.createDataFrame([(1, "a", "1"), (1, "odd", "2"), (1, "new", "3")], "d int, name string, value string")
    c = match.map_counts(match.key_match(g, p, ["d"]), ["d"], F.col("name").isin("a", "gone")).first()
    assert (c.tp, c.fp, c.fn, c.fp_unregistered) == (1, 2, 2, 2)


def test_ratio_without_denominator(spark):
    assert column(spark, "n int, d int", [(1, 0), (1, 2)], metrics.ratio(F.col("n"), F.col("d"))) == [None, 0.5]


def test_documents_of_a_value_and_short_texts(spark):
    df = spark.createDataFrame([(3, "a", "x" * 200), (1, "a", "short"), (2, None, ""), (4, "b", None)], "k int, v string, t string")
    assert sorted(map(tuple, stats.documents_of(df, F.col("v"), "k").collect())) == [("(null)", 1, 2), ("a", 2, 1), ("a", 2, 3), ("b", 1, 4)]
    assert sorted(map(tuple, stats.short_texts(df, "k", F.col("t")).collect())) == [(1, 5), (2, 0)]


def test_bootstrap_invariants(spark):
    same = spark.createDataFrame([(i, 1, 2) for i in range(20)], "k int, m_num int, m_den int")
    r = resample.bootstrap(same, "k", ["m"], iterations=30, seed=1).first()
    assert (r.n_valid, r.ci_low, r.ci_high) == (30, 0.5, 0.5)
    mixed = spark.createDataFrame([(i, i % 2, 1) for i in range(20)], "k int, m_num int, m_den int")
    a, b = (resample.bootstrap(mixed.repartition(n), "k", ["m"], iterations=30, seed=1).first() for n in (1, 5))
    assert a == b and a.ci_low < a.ci_high
    none = spark.createDataFrame([(1, 0, 0)], "k int, m_num int, m_den int")
    assert resample.bootstrap(none, "k", ["m"], iterations=5, seed=1).first().ci_low is None


def test_exact_intervals():
    low, high = resample.clopper_pearson_bounds(105, 105)
    assert low == pytest.approx(0.025 ** (1 / 105), abs=1e-9) and high == 1
    assert resample.clopper_pearson_bounds(0, 100, alpha=0.1)[1] == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    low, high = resample.clopper_pearson_bounds(47, 50)
    assert (round(low, 4), round(high, 4)) == (0.8345, 0.9875)


def test_exact_intervals_of_whole_arrays(spark):
    def cdf(k, n, p):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))

    pairs = [(k, n) for n in (1, 2, 7, 60, 311) for k in range(n + 1)]
    low, high = resample.clopper_pearson_bounds(*np.array(pairs).T)
    for (k, n), a, b in zip(pairs, low.tolist(), high.tolist()):
        assert a == 0 if k == 0 else abs(1 - cdf(k - 1, n, a) - 0.025) < 1e-9
        assert b == 1 if k == n else abs(cdf(k, n, b) - 0.025) < 1e-9
    big = 10**9
    low, high = resample.clopper_pearson_bounds(np.array([0, big, big // 2]), big)
    assert high[0] == pytest.approx(1 - 0.025 ** (1 / big), rel=1e-6) and 1 - low[1] == pytest.approx(1 - 0.025 ** (1 / big), rel=1e-6)
    assert high[2] - 0.5 == pytest.approx(1.959964 * 0.5 / big**0.5, rel=1e-4) and low[2] + high[2] == pytest.approx(1, abs=1e-12)
    rows = [(47, 50), (47, 50), (None, 5), (0, 0), (6, 5)]
    got = [r.ci for r in spark.createDataFrame(rows, "k long, n long").select(resample.clopper_pearson("k", "n").alias("ci")).collect()]
    assert got[0] == got[1] and (got[3].low, got[3].high) == (0, 1) and got[2].low is None and got[4].high is None


def test_split_draws_add_up():
    ends = np.cumsum([5, 0, 7, 1, 30])
    parts = np.array([resample.split_draws(ends, p, 4000, 3) for p in range(5)])
    assert (parts.sum(axis=0) == 43).all() and (parts[1] == 0).all()
    assert np.allclose(parts.mean(axis=1), [5, 0, 7, 1, 30], atol=0.2)
    assert np.allclose(np.cov(parts[0], parts[4])[0, 1], -43 * 5 / 43 * 30 / 43, atol=0.5)  # as of one multinomial draw


def test_split_bootstrap_equals_plain_loops(spark):
    rng = random.Random(2)
    rows = [(i, run, rng.randint(0, 3), 3, rng.randint(0, 1), rng.randint(0, 1)) for i in range(90) for run in ("r1", "r2") if (i, run) != (4, "r2")]
    rows += [(90, "r1", None, 1, 0, 0)]
    df = spark.createDataFrame(rows, "doc long, run_id string, a_num int, a_den int, b_num int, b_den int")
    ask = lambda d: sorted(map(tuple, resample.split_bootstrap(d, "doc", ["a", "b"], "run_id", iterations=400, seed=5, portion_docs=20).collect()))
    got = ask(df.repartition(3))
    assert got == ask(df.repartition(7))
    n = df.select("doc").distinct().agg(F.approx_count_distinct(F.col("doc").cast("string"))).first()[0]
    portions = -(-n // 20)
    of = {r.doc: r.p for r in df.select("doc", F.pmod(F.xxhash64(F.col("doc").cast("string")), F.lit(portions)).alias("p")).distinct().collect()}
    docs = [sorted((d for d in of if of[d] == p), key=str) for p in range(portions)]
    ends = np.cumsum([len(x) for x in docs])
    cells = {(d, run): x for d, run, *x in rows}
    sums = [{run: [0] * 4 for run in ("r1", "r2")} for _ in range(400)]
    for p, members in enumerate(docs):
        own, draws = np.random.default_rng([5, 1, p]), resample.split_draws(ends, p, 400, 5)
        for b in range(400):
            for i in own.integers(0, len(members), size=draws[b]):
                for run in ("r1", "r2"):
                    for c, x in enumerate(cells.get((members[i], run), [0] * 4)):
                        sums[b][run][c] += x or 0
    for run, metric, num, den, n_valid, low, high in got:
        c = 2 * (metric == "b")
        v = [s[run][c] / s[run][c + 1] for s in sums if s[run][c + 1]]
        assert n_valid == len(v) and (low, high) == pytest.approx(tuple(np.quantile(v, [0.025, 0.975])))
        assert (num, den) == tuple(sum(x[2 + c + k] or 0 for x in rows if x[1] == run) for k in range(2))


def test_samples(spark):
    df = spark.range(50)
    a = [r.id for r in resample.seeded_sample(df, "id", 10, 7).collect()]
    assert len(a) == 10 and a == [r.id for r in resample.seeded_sample(df.repartition(7), "id", 10, 7).collect()]
    more = resample.extend_sample(resample.seeded_sample(df, "id", 10, 7), df, "id", 15, 8)
    assert more.count() == more.distinct().count() == 15
    with pytest.raises(ValueError):
        resample.checked_sample(df, "id", 51, 1)


def test_votes(spark):
    s = "cell int, run string, gold string, v string"
    v = spark.createDataFrame([(1, r, "g", x) for r, x in zip("abcde", "xxxgg")] + [(2, r, "g", x) for r, x in zip("abcde", "xxgyy")] + [(3, r, "g", None) for r in "abc"] + [(4, r, "g", "g") for r in "abcde"], s)
    c = vote.consensus_against_gold(v, ["cell"], F.col("v"), F.col("gold"), "run")
    assert {(r.cell, r.value, r.n_agree) for r in c.collect()} == {(1, "x", 3), (3, None, 3)}
    assert [r.cell for r in vote.unanimous(v, ["cell"], F.col("v").eqNullSafe(F.col("gold")), 5).collect()] == [4]
    wide = {r.cell: r for r in vote.pivot_votes(v, ["cell"], list("abcde"), "v", "run").collect()}
    assert (wide[3].a, wide[3].e) == ("null", "")
    same = lambda a, b: a is not None and b is not None and (a.startswith(b) or b.startswith(a))
    assert vote.greedy_clusters(["ab", "abc", "abd", "x"], same) == [[0, 1, 2], [3]]
    p = spark.createDataFrame([(1, r, "zz", x) for r, x in zip("abcd", ["ab", "abc", "abd", "x"])], s)
    assert [tuple(r) for r in vote.greedy_consensus(p, ["cell"], "v", "gold", "run", same).collect()] == [(1, "ab", 3)]


def test_mode_needs_support(spark):
    v = spark.createDataFrame([("f", "b"), ("f", "a"), ("f", "a"), ("f", "b"), ("g", "x"), ("h", None), ("h", None)], "field string, v string")
    assert [tuple(r) for r in stats.most_frequent(v, ["field"], "v").collect()] == [("f", "a", 2)]


def test_rules_and_checks(spark):
    df = spark.createDataFrame([(1, "", "2025-02-30"), (2, None, "2025-02-28"), (3, "x", None)], "k int, s string, d string")
    got = {tuple(r) for r in rules.violations(df, ["k"], {"s": rules.check_str(F.col("s"), nullable=False), "d": rules.check_date(F.col("d"))}).collect()}
    assert got == {(1, "s", "empty string"), (2, "s", "required"), (1, "d", "not a date")}
    rs = [rules.Rule("empty", "s", F.col("s") == "", F.lit("e")), rules.Rule("never", "s", F.lit(False), F.lit("e"))]
    assert {(r.rule, r.n) for r in rules.rule_counts(rules.sweep(df, ["k"], rs), rs).collect()} == {("empty", 1), ("never", 0)}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('{"a": 1}', ("ok", '{"a": 1}', False, False, 0, [])),
        ('```json\n{"a": 1}\n```', ("ok", '{"a": 1}', True, False, 0, [])),
        ('Sure: {"a": "}"} done', ("ok", '{"a": "}"}', False, True, 0, [])),
        ('{"a": [1, 2,], }', ("ok", '{"a": [1, 2]}', False, False, 2, [])),
        ('{"a": 1, "a": 2}', ("ok", '{"a": 2}', False, False, 0, ["a"])),
        ('{"a": {"b": 1', ("failed", None, False, False, 0, [])),
        ("  ", ("no_response", None, False, False, 0, [])),
        (None, ("no_response", None, False, False, 0, [])),
    ],
)
def test_json_repair(text, expected):
    r = repair.repair(text)
    assert (r["status"], r["json"], r["fence"], r["extracted"], r["trailing_commas"], r["duplicate_keys"]) == expected


def test_contract_keys(spark):
    missing, extra = repair.contract_keys(F.col("j"), ["a", "b"])
    assert tuple(spark.createDataFrame([('{"a": 1, "c": 2}',)], "j string").select(missing, extra).first()) == (["b"], ["c"])


def test_literal_hits(spark):
    docs = spark.createDataFrame([(1, "aba aba ababa"), (2, ""), (3, None)], "doc_id int, text string")
    items = spark.createDataFrame([(1, "aba"), (2, "zz"), (3, ""), (4, "aba")], "item_id int, value string")
    assert {(r.doc_id, r.item_id, r.n, r.position) for r in crosscheck.literal_hits(docs, items).collect()} == {(1, 1, 3, 1), (1, 4, 3, 1)}


def test_frames(spark):
    a = spark.createDataFrame([(1, "u"), (2, None), (3, None)], "p int, number string")
    b = spark.createDataFrame([(4, "u"), (5, "v")], "p int, number string")
    u = frame.first_occurrences(frame.union_listings([a, b]), "number", ["listing", "p"])
    assert {(r.p, r.is_first, r.first_listing) for r in u.collect()} == {(1, True, 0), (2, True, 0), (3, False, 0), (4, False, 0), (5, True, 1)}
    pop = spark.createDataFrame([("n1", "t1"), ("n2", "t2")], "number string, title string")
    assert [r.number for r in frame.exclude(pop, spark.createDataFrame([("n1", "t1")], "number string, title string"), "number", "title").collect()] == ["n2"]
    with pytest.raises(ValueError):
        frame.exclude(pop, spark.createDataFrame([("n1", "t2")], "number string, title string"), "number", "title")
    assert column(spark, "i int", [(0,), (9879,)], frame.numbered_ids(F.col("i"), 121)) == ["0121", "10000"]


def test_exclusions_that_disagree_and_assignment(spark):
    s = "number string, title string"
    pop = spark.createDataFrame([("n1", "t1"), ("n2", "t2"), (None, "t3")], s)
    assert [r.number for r in frame.disagreement(pop, spark.createDataFrame([("n1", "t1"), ("n9", "t2")], s), "number", "title").collect()] == ["n2"]
    records = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, title string")
    present = spark.createDataFrame([("b", "0001")], "title string, doc_id string")
    free = spark.createDataFrame([("0003",), ("0002",)], "doc_id string")
    got = {(r.k, r.doc_id, r.kept) for r in frame.assign(records, present, "title", "k", free, "doc_id").collect()}
    assert got == {(1, "0002", False), (2, "0001", True), (3, "0003", False)}


def test_digest_sees_every_change(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "k int, t string")
    d = lambda x: stats.corpus_digest(x, "k", F.col("t")).first()
    assert d(df) == d(df.repartition(3)) and d(df).n == 3
    assert d(df) != d(df.withColumn("t", F.when(F.col("k") == 1, "b").otherwise(F.col("t")))) and d(df) != d(df.withColumn("k", F.col("k") + 1))


def test_corrections(spark):
    cells_ = spark.createDataFrame([(1, "f", "a"), (1, "g", None)], "d int, field string, v string")
    fixes = lambda rows: spark.createDataFrame(rows, "d int, field string, expected_old string, new string")
    good = corrections.plan(cells_, fixes([(1, "f", "a", "b"), (1, "g", None, "c")]), ["d", "field"], "v")
    assert {r.v for r in corrections.apply_all(cells_, good, ["d", "field"], "v").collect()} == {"b", "c"}
    bad = corrections.plan(cells_, fixes([(1, "f", "a", "b"), (1, "g", "x", "c"), (9, "f", "a", "b")]), ["d", "field"], "v")
    assert sorted(r.status for r in bad.collect()) == ["apply", "conflict", "conflict"]
    with pytest.raises(ValueError):
        corrections.apply_all(cells_, bad, ["d", "field"], "v")
    assert corrections.parse_path("persons[name=A. B].role") == [("persons", "name", "A. B"), ("role", None, None)]
    with pytest.raises(ValueError):
        corrections.parse_path("persons[name=A]")


def test_passes(spark):
    ev = spark.createDataFrame([(1, "2025-01-01 00:00:00"), (2, "2025-01-01 00:59:00"), (3, "2025-01-01 02:00:00")], "e int, t string").withColumn("ts", F.col("t").cast("timestamp_ntz")).withColumn("u", F.lit(1))
    assert [r["pass"] for r in report.passes(ev, ["u"], "ts", 3600, ["e"]).orderBy("e").collect()] == [1, 1, 2]


def test_closed_form_agrees(spark):
    assert column(spark, "n int", [(105,), (0,)], resample.zero_error_bound(F.col("n"))) == [pytest.approx(math.pow(0.025, 1 / 105)), None]


def test_corrections_of_one_cell_follow_one_another(spark):
    from tallyspark.operators import corrections

    cells = spark.createDataFrame([("a", "x", "1"), ("a", "y", "5"), ("b", "x", None)], "doc_id string, field string, value string")
    asked = spark.createDataFrame([(2, "a", "x", "2", "3"), (1, "a", "x", "1", "2"), (3, "b", "x", None, "9"), (4, "a", "y", "4", "5")], "ord int, doc_id string, field string, expected_old string, new string")
    planned = corrections.plan(cells, asked, ["doc_id", "field"], "value", "ord")
    assert {r.ord: (r.current, r.status, r.turn) for r in planned.collect()} == {1: ("1", "apply", 1), 2: ("2", "apply", 2), 3: (None, "apply", 1), 4: ("5", "already_ok", 1)}
    out = corrections.apply_all(cells, planned, ["doc_id", "field"], "value")
    assert sorted(map(tuple, out.collect())) == [("a", "x", "3"), ("a", "y", "5"), ("b", "x", "9")]
    with pytest.raises(ValueError):
        corrections.apply_all(cells, corrections.plan(cells, asked.filter("ord = 2"), ["doc_id", "field"], "value", "ord"), ["doc_id", "field"], "value")


def test_bootstrap_by_class_agrees_with_drawing_documents(spark):
    from tallyspark.operators import resample

    docs = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 5 < 3).cast("int").alias("a_num"), F.lit(1).alias("a_den"), F.lit(0).alias("z_num"), F.lit(0).alias("z_den"))
    ways = [{r.metric: (r.n_valid, r.ci_low, r.ci_high) for r in resample.bootstrap(docs, "doc_id", ["a", "z"], iterations=600, seed=5, by_class=w).collect()} for w in (True, False)]
    assert ways[0]["a"][0] == ways[1]["a"][0] == 600
    assert ways[0]["a"][1:] == pytest.approx(ways[1]["a"][1:], abs=0.02) and ways[0]["a"][1] < 0.6 < ways[0]["a"][2]
    assert ways[0].get("z", (0,))[0] == ways[1].get("z", (0,))[0] == 0
    whole = {r.b: (r.a_num, r.a_den) for r in resample.class_sums(docs, ["a_num", "a_den"], iterations=3, seed=1).collect()}
    assert all(den == 400 for _, den in whole.values()) and whole == {r.b: (r.a_num, r.a_den) for r in resample.class_sums(docs.repartition(7), ["a_num", "a_den"], iterations=3, seed=1).collect()}


def test_numbers_follow_the_order(spark):
    from tallyspark.operators import frame

    rows = spark.createDataFrame([(f"k{(i * 37) % 101:03d}",) for i in range(101)], "k string").repartition(6)
    assert [r.rn for r in frame.numbered(rows, "k").orderBy("k").collect()] == list(range(1, 102))
    assert frame.numbered(rows.limit(0), "k").count() == 0


def test_paths_lead_to_one_value_or_an_error(spark):
    record = '{"a": {"b": 1, "n": null}, "people": [{"name": "Eva", "age": 3}, {"name_new": "Eva Rot", "age": 4}, {"name": "Max"}, {"name": "Max"}, 7, {"name": 5, "x": 1}], "t": "x.y", "odd": [{"k": "v.w", "z": "q"}]}'
    cases = {
        "t": ("x.y", True, None), "a.b": ("1", True, None), "a.n": (None, True, None), "a.none": (None, False, None), "people[name=Eva].age": ("3", True, None), "people[name=Eva Rot].age": ("4", True, None),
        "people[name=Max].age": (None, False, "[name=Max] matches 2"), "people[name=5].x": (None, False, "[name=5] matches 0"), "people[age=3].name": (None, False, "[age=3] matches 0"), "odd[k=v.w].z": ("q", True, None),
        "a[name=x].y": (None, False, "a is no list"), "a.b.c": (None, False, "the parent of c is no object"), "x.y": (None, False, "no key x"), "people.name": (None, False, "the parent of name is no object"),
        "people[name=Eva]": (None, False, "bad path"), "": (None, False, "bad path"), "a..b": (None, False, "bad path"), "a.b\n": (None, False, "bad path"),
    }
    df = spark.createDataFrame([(record, p) for p in cases], "r string, p string").repartition(3)
    got = df.withColumn("x", corrections.resolve(F.parse_json("r"), F.col("p"))).select("p", F.try_variant_get("x.value", "$", "string").alias("v"), "x.found", "x.error").collect()
    assert {r.p: (r.v, r.found, r.error) for r in got} == cases
    for path in cases:  # the same paths are good in both readings
        good = cases[path][2] != "bad path"
        try:
            corrections.parse_path(path.removesuffix("\n") + ("!" if path.endswith("\n") else ""))
            assert good
        except ValueError:
            assert not good


def test_literals_are_found_by_their_rarest_word_or_gram(spark):
    rng = random.Random(3)
    words = ["aa", "ab", "b", "aab", "c\nd", "éa", ""]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(60)] + [(100, None), (101, "aaaa"), (101, "aaaa"), (None, "aa ab b")]
    items = [(i, rng.choice([" ", "", "a"]).join(rng.choices(words, k=rng.randint(1, 5)))) for i in range(60)] + [(70, None), (71, "a"), (72, " "), (73, "aa"), (73, "aa"), (74, " aa "), (75, "zz")]
    docs, values = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, value string")
    want = sorted(str((d, t, i, t.count(v), t.index(v) + 1)) for d, t in texts if t for i, v in items if v and v in t)
    assert sorted(str(tuple(r)) for r in crosscheck.literal_hits(docs, values).collect()) == want
    assert crosscheck.literal_hits(docs, values.limit(0)).count() == 0 and crosscheck.literal_hits(docs.limit(0), values).count() == 0


def test_ordered_digest(spark):
    import hashlib

    rows = [(i, f"t{i % 7}") for i in range(40)] + [(3, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    level = [h for _, h in sorted((k, sha(f"{k}|{sha(t or '')}")) for k, t in rows)]
    while True:
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        if len(level) == 1:
            break
    asked = lambda d: tuple(stats.ordered_digest(d, "k", F.col("t"), fan=3).first())
    assert asked(df) == asked(df.repartition(5)) == (41, level[0])
    assert asked(df.withColumn("k", 100 - F.col("k")))[1] != level[0] and asked(df.limit(0)) == (0, sha(""))


def test_consensus_of_known_runs_equals_that_of_lists(spark):
    rng = random.Random(5)
    rows = [(c, run, rng.choice(["a", "b", None]), gold) for c in range(300) for gold in [rng.choice(["a", "b", None])] for run in ("r1", "r2", "r3", "r4", "r5") if rng.random() < 0.9]
    v = spark.createDataFrame(rows, "cell int, run string, v string, gold string")
    for least in (1, 2, 3):
        a, b = (sorted(map(str, vote.consensus_against_gold(v, ["cell"], F.col("v"), F.col("gold"), "run", least, runs).collect())) for runs in (None, ["r1", "r2", "r3", "r4", "r5"]))
        assert a == b and a


def test_nested_report(spark):
    import json

    rows = [("r1", "f", "correct", "correct"), ("r1", "f", "wrong", "correct"), ("r1", "g", "omission", "omission"), ("r1", "h", "excluded_uncertain", "excluded_uncertain"), ("r2", "h", "excluded_uncertain", "excluded_uncertain")]
    df = spark.createDataFrame(rows, "run_id string, field string, outcome_exact string, outcome_normalized string")
    got = {r.run_id: json.loads(r.report) for r in report.nested_report(df, {"both": ["f", "g"]}, cells.OUTCOMES).collect()}
    assert got["r1"]["overall"]["exact"]["accuracy"] == "0.333333" and got["r1"]["groups"]["both"]["normalized"]["accuracy"] == "0.666667"
    assert list(got["r1"]["fields"]) == ["f", "g", "h"] and got["r1"]["fields"]["f"]["exact"]["wrong"] == 1 and got["r2"]["overall"]["exact"]["accuracy"] is None and got["r2"]["groups"] == {}


def test_first_of_groups(spark):
    rows = [("a", 3, "x"), ("a", 1, None), ("b", None, "y"), ("b", 9, "z"), (None, 2, "q"), ("c", None, "w"), ("a", 1, "b")]
    df = spark.createDataFrame(rows, "g string, k int, v string").repartition(3)
    assert sorted(map(str, report.first_of_groups(df, ["g"], "k").collect())) == sorted(map(str, spark.createDataFrame([("a", 1, None), ("b", 9, "z"), (None, 2, "q"), ("c", None, "w")], df.schema).collect()))
    assert report.first_of_groups(df.limit(0), ["g"], "k").count() == 0
    plan = report.first_of_groups(df, ["g"], "k")._jdf.queryExecution().optimizedPlan().toString()
    assert " IN (" in plan or "INSET" in plan  # only rows with a lowest key are compared whole


def test_extended_sample_reads_its_pool_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    pool = spark.range(0, 60, 1, 3).select(counted.asNondeterministic()("id").alias("id"))
    more = resample.extend_sample(resample.seeded_sample(pool, "id", 10, 7), pool, "id", 25, 8)
    assert more.count() == more.distinct().count() == 25 and seen.value == 120
    with pytest.raises(ValueError):
        resample.extend_sample(resample.seeded_sample(pool, "id", 10, 7), pool, "id", 61, 8)


def test_consensus_groups_only_votes_against_gold(spark):
    rows = [(1, r, "g", "g") for r in ("r1", "r2")] + [(1, r, "x", "g") for r in ("r3", "r4", "r5")] + [(2, "r1", None, "g"), (2, "r2", None, "g"), (2, "r3", "y", "g"), (2, "r4", "y", "g")]
    v = spark.createDataFrame(rows, "cell int, run string, v string, gold string")
    got = vote.consensus_against_gold(v, ["cell"], F.col("v"), F.col("gold"), "run", 2, ["r1", "r2", "r3", "r4", "r5"])
    assert sorted(map(tuple, got.collect())) == [(1, "g", "x", 3), (2, "g", None, 2)]
    assert got._jdf.queryExecution().executedPlan().toString().count("HashAggregate") >= 2  # votes are counted without a sort


def test_class_bootstrap_draws_documents(spark):
    """Against drawing documents one by one, with values, counts and resamples without a denominator."""
    rng = random.Random(4)
    docs = [(i, run, rng.randint(0, d), d, int(i == 7), int(i == 7)) for i in range(60) for run in ("r1", "r2") for d in [rng.randint(0, 3)]]
    df = spark.createDataFrame([*docs, (60, "r1", None, None, 0, 0), (60, "r2", 1, 1, 0, 0)], "doc long, run string, a_num int, a_den int, z_num int, z_den int")
    ask = lambda d, **k: {(r.run, r.metric): r for r in resample.class_bootstrap(d, ["a", "z"], "run", iterations=4000, seed=3, **k).collect()}
    got = ask(df.repartition(5))
    assert got == ask(df.repartition(2)) and len(got) == 4
    gen = np.random.default_rng(1)
    for run in ("r1", "r2"):
        x = np.array([[v or 0 for v in r[2:]] for r in df.filter(F.col("run") == run).collect()], float)
        sums = np.array([x[gen.integers(0, len(x), len(x))].sum(axis=0) for _ in range(4000)])
        for m, c in (("a", 0), ("z", 2)):
            r, ok = got[run, m], sums[:, c + 1] > 0
            assert (r.num, r.den) == tuple(x[:, c : c + 2].sum(axis=0)) and abs(r.n_valid - ok.sum()) < 150
            assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.quantile(sums[ok, c] / sums[ok, c + 1], [0.025, 0.975])), abs=0.02)
    halves = df.groupBy("run", "a_num", "a_den", "z_num", "z_den").agg(F.count("*").alias("n"))
    assert ask(halves, weight="n") == got


def test_alike_documents_keep_all_terms(spark):
    rng = random.Random(6)
    rows = [(run, doc, f, rng.choice(cells.OUTCOMES), rng.choice([None, "value"])) for run in ("r1", "r2") for doc in range(40) for f in ("f", "g") if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "run_id string, doc_id int, field string, o string, gold string")
    ratios = {"m": (F.col("o") == "correct", F.col("gold").isNotNull()), "f": (F.col("gold").isNull(), F.col("field") == "f")}
    names = [f"{m}_{p}" for m in ratios for p in ("num", "den")]
    want = metrics.document_terms(df, ratios, ["run_id", "doc_id"]).groupBy("run_id", *names).count()
    kinds = metrics.alike(df, "run_id", "doc_id", ["f", "g"], {"o": cells.OUTCOMES, "gold": ["value"]})
    got = metrics.document_terms(kinds, ratios, ["run_id", "kind", "documents"]).groupBy("run_id", *names).agg(F.sum("documents").alias("count"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_draws_over_arrays_are_those_of_rows(spark, monkeypatch):
    import hashlib

    for prefix, start, n in (("20261011|9|", 0, 10), ("20261011|9999|", 99_000, 1000), ("a" * 54, 5, 4), ("a" * 53, 10, 40), ("", 1_234_567_890, 20)):
        assert resample.md5_heads(prefix, start, n).tolist() == [int(hashlib.md5(f"{prefix}{k}".encode()).hexdigest()[:8], 16) for k in range(start, start + n)]
    rng = random.Random(8)
    rows = [(i, rng.choice([None, 0, 1, 5]), rng.choice([1, 2]), None if i else 3.5) for i in range(1203)]
    df = spark.createDataFrame(rows, "k int, x int, y int, z double")
    monkeypatch.setattr(resample, "_UNIT", 500)
    monkeypatch.setattr(resample, "_PACK", 100)
    ask = lambda d: sorted(map(tuple, resample.drawn_sums(d, "k", ["x", "y", "z"], 6, 11).collect()))
    got = ask(df)
    order = sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
    for b, *sums in got:
        drawn = [order[int(hashlib.md5(f"11|{b}|{k}".encode()).hexdigest()[:8], 16) % len(order)] for k in range(len(order))]
        assert sums == [sum(x) if (x := [r[c] for r in drawn if r[c] is not None]) else None for c in (1, 2, 3)]
    assert len(got) == 6 and got == ask(df.repartition(3)) and ask(df.limit(0)) == []
    monkeypatch.setattr(resample, "DRAWN_BYTES", 0)
    assert ask(df) == got


def test_hashes_of_numbers_with_other_digits():
    import hashlib

    at_all_offsets = [("p" * i, start, n) for i in range(57) for start, n in ((0, 1), (7, 1), (0, 1200), (95, 10), (1_230, 40))]
    for prefix, start, n in (*at_all_offsets, ("20261011|12|", 0, 50_000), ("20261011|9|", 99_990, 20), ("", 9_999_999_990, 20), ("\u00e9|", 8, 5)):
        assert resample.md5_heads(prefix, start, n).tolist() == [int(hashlib.md5(f"{prefix}{k}".encode()).hexdigest()[:8], 16) for k in range(start, start + n)]


def test_many_documents_of_few_classes_travel_with_the_draws(spark, monkeypatch):
    """What counts are the bytes that travel: 1,203 documents of 4 columns were 48 kB as doubles and are 6 kB as classes."""
    df = spark.range(1203).selectExpr("id AS k", "int(id % 3 = 0) AS x", "1 AS y", "IF(id % 5 = 0, NULL, 1) AS z", "2 AS u")
    monkeypatch.setattr(resample, "_PACK", 400)
    monkeypatch.setattr(resample, "_DRAWS", 70)
    want = sorted(map(tuple, resample.drawn_sums(df, "k", ["x", "y", "z", "u"], 5, 11).collect()))
    joined = resample.draws
    monkeypatch.setattr(resample, "draws", None)
    monkeypatch.setattr(resample, "DRAWN_BYTES", 6_000)
    assert sorted(map(tuple, resample.drawn_sums(df, "k", ["x", "y", "z", "u"], 5, 11).collect())) == want and len(want) == 5
    monkeypatch.setattr(resample, "draws", joined)
    monkeypatch.setattr(resample, "DRAWN_BYTES", 5_000)
    assert sorted(map(tuple, resample.drawn_sums(df, "k", ["x", "y", "z", "u"], 5, 11).collect())) == want


def test_paths_of_one_record_parse_it_once(spark):
    parsed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(x):
        parsed.add(1)
        return f'{{"a": {x}, "l": [{{"k": "v", "z": 1}}]}}'

    paths = ["a", "b", "l[k=v].z", "l[k=w].z", "a..b"]
    df = spark.range(0, 3, 1, 1).withColumn("r", text("id")).select("id", F.explode(corrections.resolve_all(F.parse_json("r"), F.array(*map(F.lit, paths)))).alias("x"))
    got = df.select("id", "x.path", F.try_variant_get("x.value", "$", "string").alias("v"), "x.found", "x.error").collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(id=i, path=p, v=v, found=v is not None, error=e)) for i in range(3) for p, v, e in zip(paths, (str(i), None, "1", None, None), (None, None, None, "[k=w] matches 0", "bad path")))
    assert parsed.value == 3
