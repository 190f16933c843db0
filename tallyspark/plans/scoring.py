"""Scoring queries: cells, outcomes, metrics, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.values import hash_bucket, normalize, normalize_exact
from tallyspark.operators import match, metrics, report, resample
from tallyspark.operators.cells import OUTCOMES, classify, melt_map
from tallyspark.plans.bindings import CELLS_SQL, FIELDS, GOLD_SQL, RUNS, bucket_sql, cells, gold_cells, normalize_sql, outcomes, predicted, table
from tallyspark.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.add
_SCORED = "(" + ", ".join(f"'{o}'" for o in OUTCOMES) + ")"
_BY = ["run_id", "field"]


def _r(c, name: str):
    return F.round(c, 9).alias(name)


@query(CELLS_SQL + " SELECT * FROM cells")
def score_cells(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d)


@query(CELLS_SQL + f""" SELECT run_id, field,
  count(*) FILTER (outcome_normalized IN ('correct', 'correct_null'))::BIGINT AS correct, count(*) FILTER (outcome_normalized IN {_SCORED})::BIGINT AS scored,
  round(count(*) FILTER (outcome_normalized IN ('correct', 'correct_null'))::DOUBLE / nullif(count(*) FILTER (outcome_normalized IN {_SCORED}), 0), 9) AS accuracy,
  round(count(*) FILTER (outcome_exact IN ('correct', 'correct_null'))::DOUBLE / nullif(count(*) FILTER (outcome_exact IN {_SCORED}), 0), 9) AS accuracy_exact
FROM cells GROUP BY ALL""")
def score_accuracy(spark: SparkSession, d: str) -> DataFrame:
    num, den = metrics.accuracy(F.col("outcome_normalized"))
    num_x, den_x = metrics.accuracy(F.col("outcome_exact"))
    return cells(spark, d).groupBy(*_BY).agg(num.alias("correct"), den.alias("scored"), _r(metrics.ratio(num, den), "accuracy"), _r(metrics.ratio(num_x, den_x), "accuracy_exact"))


@query(CELLS_SQL + f""" SELECT run_id,
  round(count(*) FILTER (gold IS NOT NULL AND outcome_normalized = 'correct')::DOUBLE / nullif(count(*) FILTER (gold IS NOT NULL AND outcome_normalized IN {_SCORED}), 0), 9) AS value_accuracy,
  round(count(*) FILTER (gold IS NULL AND outcome_normalized = 'correct_null')::DOUBLE / nullif(count(*) FILTER (gold IS NULL AND outcome_normalized IN {_SCORED}), 0), 9) AS null_accuracy
FROM cells GROUP BY ALL""")
def value_null_accuracy(spark: SparkSession, d: str) -> DataFrame:
    o, g = F.col("outcome_normalized"), F.col("gold")
    return cells(spark, d).groupBy("run_id").agg(_r(metrics.ratio(*metrics.value_accuracy(o, g)), "value_accuracy"), _r(metrics.ratio(*metrics.null_accuracy(o, g)), "null_accuracy"))


@query(CELLS_SQL + " SELECT run_id, field, " + ", ".join(f"count(*) FILTER (outcome_normalized = '{o}')::BIGINT AS {o}" for o in OUTCOMES) + " FROM cells GROUP BY ALL")
def outcome_pivot(spark: SparkSession, d: str) -> DataFrame:
    return metrics.outcome_counts(cells(spark, d), _BY, "outcome_normalized")


@query(CELLS_SQL + """ SELECT run_id, count(*) FILTER (outcome_exact = 'no_output')::BIGINT AS no_output, count(*) FILTER (outcome_exact = 'excluded_uncertain')::BIGINT AS excluded,
  count(*) FILTER (outcome_exact = 'no_output' AND gold IS NULL)::BIGINT AS no_output_null, count(DISTINCT doc_id) FILTER (outcome_exact = 'no_output')::BIGINT AS docs_without FROM cells GROUP BY ALL""")
def score_no_output_uncertain(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("outcome_exact")
    return cells(spark, d).groupBy("run_id").agg(F.count_if(o == "no_output").alias("no_output"), F.count_if(o == "excluded_uncertain").alias("excluded"), F.count_if((o == "no_output") & F.col("gold").isNull()).alias("no_output_null"), F.count_distinct(F.when(o == "no_output", F.col("doc_id"))).alias("docs_without"))


@query(f"""WITH t AS (SELECT doc_id, source, text AS gold, CASE WHEN doc_id % 3 = 0 THEN '  ' || upper(text) ELSE text END AS pred FROM documents)
SELECT source, count(*)::BIGINT AS n, count(*) FILTER (gold = pred)::BIGINT AS exact, count(*) FILTER ({normalize_sql('gold')} = {normalize_sql('pred')})::BIGINT AS normalized FROM t GROUP BY ALL""")
def exact_vs_normalized(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("source", F.col("text").alias("gold"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  "), F.upper("text"))).otherwise(F.col("text")).alias("pred"))
    return t.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("exact"), F.count_if(normalize(F.col("gold")) == normalize(F.col("pred"))).alias("normalized"))


@query(f"""SELECT lang, count(*)::BIGINT AS n, sum(length({normalize_sql('text')}))::BIGINT AS chars FROM documents GROUP BY ALL""")
def normalized_text_exact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("lang", normalize_exact("text").alias("t")).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"))


# --- lists, maps, labels ------------------------------------------------------------

_LINES = f"""WITH g AS (SELECT l_orderkey AS doc_id, l_partkey AS part, l_linenumber AS ln, l_suppkey AS supp, l_quantity AS qty, l_extendedprice AS price FROM lineitem),
p AS (SELECT doc_id, part, ln, supp, CASE WHEN {bucket_sql("'qty'", 'doc_id', 'part', 'ln', 'supp')} < 20 THEN qty + 1 ELSE qty END AS qty, price FROM g WHERE {bucket_sql("'drop'", 'doc_id', 'part', 'ln', 'supp')} >= 15),
gr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY ln, supp, qty, price) AS rn FROM g),
pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY ln, supp, qty, price) AS rn FROM p),
m AS (SELECT coalesce(gr.doc_id, pr.doc_id) AS doc_id, coalesce(gr.part, pr.part) AS part, coalesce(gr.rn, pr.rn)::INTEGER AS rn, gr.qty AS gold_qty, pr.qty AS pred_qty,
  CASE WHEN gr.doc_id IS NOT NULL AND pr.doc_id IS NOT NULL THEN 'matched' WHEN gr.doc_id IS NOT NULL THEN 'missed' ELSE 'spurious' END AS status
  FROM gr FULL JOIN pr ON gr.doc_id = pr.doc_id AND gr.part = pr.part AND gr.rn = pr.rn)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("ln"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))
    key = [F.col(c) for c in ("doc_id", "part", "ln", "supp")]
    p = g.filter(hash_bucket("drop", *key) >= 15).withColumn("qty", F.when(hash_bucket("qty", *key) < 20, F.col("qty") + 1).otherwise(F.col("qty")))
    return match.ordinal_match(g, p, ["doc_id"], "part", ["ln", "supp", "qty", "price"]).select("doc_id", "part", "rn", "gold_qty", "pred_qty", "status")


@query(_LINES + " SELECT * FROM m")
def ordinal_match(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)


@query(_LINES + """, c AS (SELECT count(*) FILTER (status = 'matched') AS tp, count(*) FILTER (status = 'spurious') AS fp, count(*) FILTER (status = 'missed') AS fn, count(*) FILTER (status = 'matched' AND gold_qty = pred_qty) AS ok FROM m)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / (tp + fn), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9)::DOUBLE AS f1, round(ok::DOUBLE / tp, 9) AS attribute_accuracy FROM c""")
def list_prf(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    c = _lines(spark, d).agg(F.count_if(s == "matched").alias("tp"), F.count_if(s == "spurious").alias("fp"), F.count_if(s == "missed").alias("fn"), F.count_if((s == "matched") & (F.col("gold_qty") == F.col("pred_qty"))).alias("ok"))
    return c.select("tp", "fp", "fn", *[_r(v, k) for k, v in metrics.prf(F.col("tp"), F.col("fp"), F.col("fn")).items()], _r(metrics.ratio(F.col("ok"), F.col("tp")), "attribute_accuracy"))


_MAP = f"""WITH e AS (SELECT event_id AS doc_id, event_type AS typ, json_extract_string(props, '$.k') AS k FROM events),
g AS (SELECT doc_id, typ, unnest(['k', 'type']) AS name, unnest([k, typ]) AS value FROM e),
p AS (SELECT doc_id, typ, CASE WHEN {bucket_sql("'name'", 'doc_id', 'name')} < 10 THEN name || '_' ELSE name END AS name, CASE WHEN {bucket_sql("'val'", 'doc_id', 'name')} < 20 THEN value || '0' ELSE value END AS value FROM g WHERE {bucket_sql("'gone'", 'doc_id', 'name')} >= 15),
m AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.name, p.name) AS name, g.value AS gold, p.value AS pred, CASE WHEN g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL THEN 'shared' WHEN g.doc_id IS NOT NULL THEN 'gold_only' ELSE 'pred_only' END AS status
  FROM (SELECT * FROM g WHERE value IS NOT NULL) g FULL JOIN (SELECT * FROM p WHERE value IS NOT NULL) p ON g.doc_id = p.doc_id AND g.name = p.name)"""


def _map(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type")).alias("extras"))
    g = melt_map(e, ["doc_id"], F.col("extras"))
    key = (F.col("doc_id"), F.col("name"))
    p = g.filter(hash_bucket("gone", *key) >= 15).select("doc_id", F.when(hash_bucket("name", *key) < 10, F.concat("name", F.lit("_"))).otherwise(F.col("name")).alias("name"), F.when(hash_bucket("val", *key) < 20, F.concat("value", F.lit("0"))).otherwise(F.col("value")).alias("value"))
    return match.key_match(g, p, ["doc_id"])


@query(_MAP + """, c AS (SELECT name, count(*) FILTER (status = 'shared' AND name = 'k') AS tp, count(*) FILTER (status = 'pred_only' OR (status = 'shared' AND name <> 'k')) AS fp,
  count(*) FILTER (status = 'gold_only' OR (status = 'shared' AND name <> 'k')) AS fn, count(*) FILTER ((status = 'pred_only' OR status = 'shared') AND name <> 'k') AS fpu FROM m GROUP BY name)
SELECT name, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, fpu::BIGINT AS fp_unregistered, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9)::DOUBLE AS f1 FROM c""")
def map_key_prf(spark: SparkSession, d: str) -> DataFrame:
    c = match.map_counts(_map(spark, d), ["name"], F.col("name").isin("k"))
    return c.select("name", "tp", "fp", "fn", "fp_unregistered", _r(metrics.prf(F.col("tp"), F.col("fp"), F.col("fn"))["f1"], "f1"))


@query(_MAP + " SELECT name, count(*)::BIGINT AS shared, count(*) FILTER (gold = pred)::BIGINT AS equal, round(count(*) FILTER (gold = pred)::DOUBLE / count(*), 9) AS value_accuracy FROM m WHERE status = 'shared' GROUP BY name")
def map_value_accuracy(spark: SparkSession, d: str) -> DataFrame:
    same = F.count_if(F.col("gold") == F.col("pred"))
    return _map(spark, d).filter("status = 'shared'").groupBy("name").agg(F.count("*").alias("shared"), same.alias("equal"), _r(metrics.ratio(same, F.count("*")), "value_accuracy"))


_LABELS = f"""WITH g AS (SELECT DISTINCT d.doc_id, unnest(CASE WHEN l.toxic = 1 THEN [d.lang, 'toxic'] ELSE [d.lang] END) AS label FROM documents d JOIN labels l USING (doc_id)),
p AS (SELECT DISTINCT d.doc_id, unnest(CASE WHEN {bucket_sql("'tox'", 'd.doc_id')} < 12 THEN [CASE WHEN {bucket_sql("'lang'", 'd.doc_id')} < 8 THEN 'en' ELSE d.lang END, 'toxic'] ELSE [CASE WHEN {bucket_sql("'lang'", 'd.doc_id')} < 8 THEN 'en' ELSE d.lang END] END) AS label FROM documents d JOIN labels l USING (doc_id)),
m AS (SELECT coalesce(g.label, p.label) AS label, CASE WHEN g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL THEN 'tp' WHEN g.doc_id IS NOT NULL THEN 'fn' ELSE 'fp' END AS status FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.label = p.label),
c AS (SELECT label, count(*) FILTER (status = 'tp') AS tp, count(*) FILTER (status = 'fp') AS fp, count(*) FILTER (status = 'fn') AS fn FROM m GROUP BY label)
SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp::DOUBLE / nullif(tp + fp, 0), 9) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9)::DOUBLE AS f1 FROM c
UNION ALL SELECT '(micro)', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, round(sum(tp)::DOUBLE / nullif(sum(tp) + sum(fp), 0), 9), round(sum(tp)::DOUBLE / nullif(sum(tp) + sum(fn), 0), 9), round(2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 9)::DOUBLE FROM c
UNION ALL SELECT '(macro)', 0, 0, 0, round(avg(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)), 9), round(avg(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)), 9), round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 9)::DOUBLE FROM c"""


def _label_match(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "toxic")
    g = docs.select("doc_id", F.explode(F.when(F.col("toxic") == 1, F.array("lang", F.lit("toxic"))).otherwise(F.array("lang"))).alias("label"))
    lang = F.when(hash_bucket("lang", F.col("doc_id")) < 8, "en").otherwise(F.col("lang"))
    p = docs.select("doc_id", F.explode(F.when(hash_bucket("tox", F.col("doc_id")) < 12, F.array(lang, F.lit("toxic"))).otherwise(F.array(lang))).alias("label"))
    return match.label_match(g, p, ["doc_id"], "label")


@query(_LABELS)
def label_micro_macro(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    c = _label_match(spark, d).groupBy("label").agg(F.count_if(s == "tp").alias("tp"), F.count_if(s == "fp").alias("fp"), F.count_if(s == "fn").alias("fn"))
    names = ["precision", "recall", "f1"]
    by = metrics.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    each = c.select("label", "tp", "fp", "fn", *[_r(by[n], n) for n in names])
    micro = c.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).select(F.lit("(micro)").alias("label"), "tp", "fp", "fn", *[_r(by[n], n) for n in names])
    none = F.lit(0).cast("bigint")
    macro = c.agg(*[F.avg(F.coalesce(by[n], F.lit(0.0))).alias(n) for n in names]).select(F.lit("(macro)").alias("label"), none.alias("tp"), none.alias("fp"), none.alias("fn"), *[_r(F.col(n), n) for n in names])
    return each.unionByName(micro).unionByName(macro)


# --- registry, intervals ------------------------------------------------------------


GROUPS = {"coded": ["status", "priority"], "measured": ["price", "odate"]}


def _headline_sql() -> str:
    parts = []
    for mode in ("exact", "normalized"):
        o = f"outcome_{mode}"
        scored, ok = f"{o} IN {_SCORED}", f"{o} IN ('correct', 'correct_null')"
        rows = [(f"accuracy_{mode}", ok, scored), (f"value_accuracy_{mode}", f"{o} = 'correct'", f"{scored} AND gold IS NOT NULL"), (f"null_accuracy_{mode}", f"{o} = 'correct_null'", f"{scored} AND gold IS NULL")]
        for name, own in [*((f, f"field = '{f}'") for f in FIELDS), *((f"group_{g}", "(" + " OR ".join(f"field = '{f}'" for f in m) + ")") for g, m in GROUPS.items())]:
            rows += [(f"{name}_accuracy_{mode}", ok, f"{scored} AND {own}"), (f"{name}_value_accuracy_{mode}", f"{o} = 'correct'", f"{scored} AND {own} AND gold IS NOT NULL"), (f"{name}_null_accuracy_{mode}", f"{o} = 'correct_null'", f"{scored} AND {own} AND gold IS NULL")]
        parts += [f"SELECT run_id, '{n}' AS metric, count(*) FILTER ({a})::BIGINT AS num, count(*)::BIGINT AS den, round(count(*) FILTER ({a})::DOUBLE / count(*), 9) AS value FROM cells WHERE {b} GROUP BY run_id" for n, a, b in rows]
    parts += [f"SELECT run_id, 'parse_failure_rate', count(*) FILTER ({bucket_sql('run_id', 'o_orderkey')} < 3)::BIGINT, count(*)::BIGINT, round(count(*) FILTER ({bucket_sql('run_id', 'o_orderkey')} < 3)::DOUBLE / count(*), 9) FROM orders, (SELECT unnest(['r1', 'r2', 'r3', 'r4', 'r5']) AS run_id) GROUP BY run_id"]
    f1 = lambda tp, fp, fn: (f"2 * count(*) FILTER ({tp})", f"2 * count(*) FILTER ({tp}) + count(*) FILTER ({fp}) + count(*) FILTER ({fn})")
    matched = lambda x: (f"count(*) FILTER ({x})", "count(*)")
    labels = _LABELS[: _LABELS.index(",\nc AS (SELECT label")]
    for name, source, (num, den) in [
        ("parts_found_f1", _LINES + " SELECT * FROM m", f1("status = 'matched'", "status = 'spurious'", "status = 'missed'")),
        ("parts_attribute_accuracy", _LINES + " SELECT * FROM m WHERE status = 'matched'", matched("gold_qty = pred_qty")),
        ("labels_micro_f1", labels + " SELECT * FROM m", f1("status = 'tp'", "status = 'fp'", "status = 'fn'")),
        ("extras_key_f1", _MAP + " SELECT * FROM m", f1("status = 'shared' AND name = 'k'", "status = 'pred_only' OR (status = 'shared' AND name <> 'k')", "status = 'gold_only' OR (status = 'shared' AND name <> 'k')")),
        ("extras_value_accuracy", _MAP + " SELECT * FROM m WHERE status = 'shared' AND name = 'k'", matched("gold = pred")),
    ]:
        parts += [f"SELECT '-', '{name}', ({num})::BIGINT, ({den})::BIGINT, round(({num})::DOUBLE / ({den}), 9) FROM ({source}) HAVING ({den}) > 0"]
    return CELLS_SQL + " " + " UNION ALL ".join(parts)


@query(_headline_sql())
def headline_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every ratio of the registry by run; those of lists, labels and extras, which have one set of predictions, under ``-``."""
    terms = metrics.metric_terms(cells(spark, d), metrics.headline_registry(FIELDS, GROUPS), ["run_id"])
    docs = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(*[F.lit(r) for r in RUNS])).alias("run_id"))
    failed = hash_bucket(F.col("run_id"), F.col("o_orderkey")) < 3
    terms = terms.unionByName(metrics.sum_terms(docs, {"parse_failure_rate": (F.count_if(failed), F.count("*"))}, ["run_id"]))
    s, one = F.col("status"), lambda df: df.withColumn("run_id", F.lit("-"))
    n = lambda x: F.count_if(s == x)
    same, known = F.count_if((s == "matched") & (F.col("gold_qty") == F.col("pred_qty"))), F.col("name") == "k"
    keys = match.map_counts(one(_map(spark, d)), ["run_id"], known).select("run_id", "tp", "fp", "fn")
    shared = (s == "shared") & known
    for rows, ratios in (
        (one(_lines(spark, d)), {"parts_found_f1": metrics.f1_terms(n("matched"), n("spurious"), n("missed")), "parts_attribute_accuracy": (same, n("matched"))}),
        (one(_label_match(spark, d)), {"labels_micro_f1": metrics.f1_terms(n("tp"), n("fp"), n("fn"))}),
        (keys, {"extras_key_f1": metrics.f1_terms(F.sum("tp"), F.sum("fp"), F.sum("fn"))}),
        (one(_map(spark, d)), {"extras_value_accuracy": (F.count_if(shared & (F.col("gold") == F.col("pred"))), F.count_if(shared))}),
    ):
        terms = terms.unionByName(metrics.sum_terms(rows, ratios, ["run_id"]))
    return terms.withColumn("value", F.round(metrics.ratio(F.col("num"), F.col("den")), 9))


ITERATIONS, SEED = 10_000, 20261011
_PER_DOC = f"""WITH per_doc AS (SELECT l.doc_id, (CASE WHEN {bucket_sql("'a'", 'l.doc_id')} < 80 THEN l.quality ELSE 1 - l.quality END = l.quality)::INT AS a_num, 1 AS a_den,
  CASE WHEN l.toxic = 1 THEN ({bucket_sql("'b'", 'l.doc_id')} < 70)::INT ELSE 0 END AS b_num, (l.toxic = 1)::INT AS b_den FROM labels l),
docs AS (SELECT *, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS idx, count(*) OVER () AS n FROM per_doc),
draws AS (SELECT b, ('0x' || substr(md5('{SEED}|' || b || '|' || k), 1, 8))::BIGINT % (SELECT count(*) FROM per_doc) AS idx FROM range({ITERATIONS}) t(b), (SELECT unnest(range((SELECT count(*) FROM per_doc))) AS k)),
sums AS (SELECT b, sum(a_num)::DOUBLE AS a_num, sum(a_den)::DOUBLE AS a_den, sum(b_num)::DOUBLE AS b_num, sum(b_den)::DOUBLE AS b_den FROM draws JOIN docs USING (idx) GROUP BY b)"""


def _per_doc(spark: SparkSession, d: str) -> DataFrame:
    q, t, i = F.col("quality"), F.col("toxic"), F.col("doc_id")
    hit = (F.when(hash_bucket("a", i) < 80, q).otherwise(1 - q) == q).cast("int")
    return table(spark, d, "labels").select("doc_id", hit.alias("a_num"), F.lit(1).alias("a_den"), F.when(t == 1, (hash_bucket("b", i) < 70).cast("int")).otherwise(0).alias("b_num"), (t == 1).cast("int").alias("b_den"))


def _report_sql() -> str:
    def block(mode: str) -> str:
        o = f"outcome_{mode}"
        counts = ", ".join(f"'{x}': count(*) FILTER ({o} = '{x}')" for x in (*OUTCOMES, "excluded_uncertain"))
        return f"'{mode}': {{{counts}, 'accuracy': (count(*) FILTER ({o} IN ('correct', 'correct_null'))::DOUBLE / nullif(count(*) FILTER ({o} IN {_SCORED}), 0))::DECIMAL(9,6)::VARCHAR}}"

    blocks = f"{{{block('exact')}, {block('normalized')}}} AS b"
    groups = "CASE " + " ".join(f"WHEN field IN ({', '.join(repr(f) for f in fs)}) THEN '{g}'" for g, fs in GROUPS.items()) + " END"
    return CELLS_SQL + f""", o AS (SELECT run_id, {blocks} FROM cells GROUP BY run_id),
g AS (SELECT run_id, map_from_entries(list((name, b) ORDER BY name)) AS m FROM (SELECT run_id, {groups} AS name, {blocks} FROM cells GROUP BY ALL) WHERE name IS NOT NULL GROUP BY run_id),
f AS (SELECT run_id, map_from_entries(list((field, b) ORDER BY field)) AS m FROM (SELECT run_id, field, {blocks} FROM cells GROUP BY ALL) GROUP BY run_id)
SELECT run_id, to_json({{'overall': o.b, 'groups': g.m, 'fields': f.m}})::VARCHAR AS report FROM o JOIN g USING (run_id) JOIN f USING (run_id)"""


@query(_report_sql())
def nested_report(spark: SparkSession, d: str) -> DataFrame:
    return report.nested_report(cells(spark, d), GROUPS, OUTCOMES)


@query()
def headline_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Value, counts and interval of every ratio of :func:`headline_metrics`.

    Each family's documents are resampled: orders for cells and lines, documents for labels,
    events for extras, each ratio's by its own pairs of sums. The draws are a generator's, so
    there is no SQL; tests compare the intervals with plain loops.
    """
    registry = metrics.headline_registry(FIELDS, GROUPS)
    s, known, one = F.col("status"), F.col("name") == "k", F.lit("-").alias("run_id")
    n = lambda x: F.count_if(s == x)
    shared = (s == "shared") & known
    spurious, lacking = (s == "pred_only") | ((s == "shared") & ~known), (s == "gold_only") | ((s == "shared") & ~known)

    def terms(rows: DataFrame, ratios: dict) -> tuple[DataFrame, list[str]]:
        sums = [c.alias(f"{name}_{k}") for name, pair in ratios.items() for k, c in zip(("num", "den"), pair)]
        return rows.groupBy("doc_id").agg(*sums).withColumn("run_id", one), list(ratios)

    facts = {k: [*OUTCOMES, "excluded_uncertain"] for k in outcomes()} | {"gold": ["value"], "no_output": [True]}
    kinds = metrics.alike(predicted(spark, d).withColumns(outcomes()).withColumn("gold", F.when(F.col("gold").isNotNull(), "value")), "run_id", "doc_id", FIELDS, facts)
    first = F.col("field") == FIELDS[0]
    per_run = metrics.document_terms(kinds, registry | {"parse_failure_rate": (first & F.coalesce("no_output", F.lit(False)), first)}, ["run_id", "kind", "documents"])
    out = None
    for per_doc, names in (
        (per_run, [*registry, "parse_failure_rate"]),
        terms(_lines(spark, d), {"parts_found_f1": metrics.f1_terms(n("matched"), n("spurious"), n("missed")), "parts_attribute_accuracy": (F.count_if((s == "matched") & (F.col("gold_qty") == F.col("pred_qty"))), n("matched"))}),
        terms(_label_match(spark, d), {"labels_micro_f1": metrics.f1_terms(n("tp"), n("fp"), n("fn"))}),
        terms(_map(spark, d), {"extras_key_f1": metrics.f1_terms(F.count_if(shared), F.count_if(spurious), F.count_if(lacking)), "extras_value_accuracy": (F.count_if(shared & (F.col("gold") == F.col("pred"))), F.count_if(shared))}),
    ):
        part = resample.class_bootstrap(per_doc, names, "run_id", iterations=ITERATIONS, seed=SEED, weight="documents" if per_doc is per_run else None)
        out = part if out is None else out.unionByName(part)
    whole = [F.col(c).cast("bigint").alias(c) for c in ("num", "den")]
    return out.select("run_id", "metric", *whole, _r(metrics.ratio(F.col("num"), F.col("den")), "value"), "n_valid", _r(F.col("ci_low"), "ci_low"), _r(F.col("ci_high"), "ci_high"))


@query(_PER_DOC + """ SELECT metric, count(v)::BIGINT AS n_valid, round(quantile_cont(v, 0.025), 9) AS ci_low, round(quantile_cont(v, 0.975), 9) AS ci_high
FROM (SELECT 'a' AS metric, a_num / nullif(a_den, 0) AS v FROM sums UNION ALL SELECT 'b', b_num / nullif(b_den, 0) FROM sums) GROUP BY metric""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return resample.bootstrap(_per_doc(spark, d), "doc_id", ["a", "b"], iterations=ITERATIONS, seed=SEED).select("metric", "n_valid", _r(F.col("ci_low"), "ci_low"), _r(F.col("ci_high"), "ci_high"))


@query(_PER_DOC + """, x AS (SELECT a_num / nullif(a_den, 0) - b_num / nullif(b_den, 0) AS d FROM sums)
SELECT count(d)::BIGINT AS n_valid, round(quantile_cont(d, 0.025), 9) AS ci_low, round(quantile_cont(d, 0.975), 9) AS ci_high, quantile_cont(d, 0.025) <= 0 AND quantile_cont(d, 0.975) >= 0 AS includes_zero FROM x WHERE d IS NOT NULL""")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return resample.paired_bootstrap(_per_doc(spark, d), "doc_id", "a", "b", iterations=ITERATIONS, seed=SEED).select("n_valid", _r(F.col("ci_low"), "ci_low"), _r(F.col("ci_high"), "ci_high"), "includes_zero")


@query("SELECT quality, count(*)::BIGINT AS n, round(pow(0.025, 1.0 / count(*)), 9) AS zero_error_low, round(1 - 3.0 / count(*), 9)::DOUBLE AS rule_of_three FROM labels GROUP BY quality")
def zero_error_interval(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    return table(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n")).select("quality", "n", _r(resample.zero_error_bound(n), "zero_error_low"), _r(resample.rule_of_three(n), "rule_of_three"))


@query("""WITH RECURSIVE c AS (SELECT quality, sum(toxic)::BIGINT AS k, count(*)::BIGINT AS n FROM labels GROUP BY quality),
b AS (SELECT quality, k, n, side, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i FROM c, (SELECT unnest(['low', 'high']) AS side)
  UNION ALL SELECT quality, k, n, side, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END, i + 1 FROM (
    SELECT *, CASE WHEN side = 'low' THEN tail < 0.025 ELSE tail > 0.025 END AS up FROM (
      SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(CASE WHEN side = 'low' THEN range(k, n + 1) ELSE range(0, k + 1) END,
        lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln((lo + hi) / 2) + (n - x) * ln(1 - (lo + hi) / 2)))) AS tail FROM b WHERE i < 50))),
f AS (SELECT * FROM b WHERE i = 50)
SELECT quality, k, n, round(max(CASE WHEN side = 'low' THEN CASE WHEN k = 0 THEN 0 ELSE lo END END), 7) AS low, round(max(CASE WHEN side = 'high' THEN CASE WHEN k = n THEN 1 ELSE hi END END), 7) AS high FROM f GROUP BY quality, k, n""")
def clopper_pearson(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "labels").groupBy("quality").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    return k.withColumn("ci", resample.clopper_pearson("k", "n")).select("quality", "k", "n", F.round("ci.low", 7).alias("low"), F.round("ci.high", 7).alias("high"))


# --- reports over cells -------------------------------------------------------------


@query(CELLS_SQL + """, a AS (SELECT doc_id, field, outcome_normalized AS before FROM cells WHERE run_id = 'r1' AND outcome_normalized <> 'no_output'), b AS (SELECT doc_id, field, outcome_normalized AS after FROM cells WHERE run_id = 'r2' AND outcome_normalized <> 'no_output'),
j AS (SELECT before, after, CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN a.doc_id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.field = b.field)
SELECT side, CASE WHEN before = after THEN 'same' WHEN before NOT IN ('correct', 'correct_null') AND after IN ('correct', 'correct_null') THEN 'fixed' WHEN before IN ('correct', 'correct_null') AND after NOT IN ('correct', 'correct_null') THEN 'broken' ELSE 'other' END AS change, count(*)::BIGINT AS n FROM j GROUP BY ALL""")
def before_after(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d, ["r1", "r2"]).select("run_id", "doc_id", "field", F.col("outcome_normalized").alias("o"))
    # a run has no cells of documents without output, so that all sides occur
    c = c.filter("o <> 'no_output'")
    return report.before_after(c.filter("run_id = 'r1'"), c.filter("run_id = 'r2'"), ["doc_id", "field"], "o").groupBy("side", "change").agg(F.count("*").alias("n"))


@query(CELLS_SQL + """, t AS (SELECT CASE WHEN GROUPING(run_id) = 1 THEN 'All' ELSE run_id END AS run_id, CASE WHEN GROUPING(outcome_normalized) = 1 THEN 'All' ELSE outcome_normalized END AS outcome, count(*)::BIGINT AS n FROM cells GROUP BY CUBE (run_id, outcome_normalized)) SELECT * FROM t""")
def crosstab_margins(spark: SparkSession, d: str) -> DataFrame:
    return report.crosstab(cells(spark, d).select("run_id", F.col("outcome_normalized").alias("outcome")), "run_id", "outcome")


_FAILED = "outcome_normalized IN ('wrong', 'omission', 'hallucination', 'no_output')"


@query(CELLS_SQL + f" SELECT field, count(*)::BIGINT AS n_failures, min(doc_id) AS first_key FROM cells WHERE {_FAILED} GROUP BY field ORDER BY n_failures DESC, field LIMIT 3")
def top_failing(spark: SparkSession, d: str) -> DataFrame:
    return report.first_failures(cells(spark, d).filter(_FAILED), "field", "doc_id", 3)


@query(CELLS_SQL + f", f AS (SELECT *, row_number() OVER (PARTITION BY run_id, field ORDER BY doc_id) AS r FROM cells WHERE {_FAILED}) SELECT run_id, field, doc_id, gold, prediction, outcome_normalized FROM f WHERE r = 1")
def first_failure(spark: SparkSession, d: str) -> DataFrame:
    f = cells(spark, d).filter(_FAILED).select("run_id", "field", "doc_id", "gold", "prediction", "outcome_normalized")
    return report.first_of_groups(f, ["run_id", "field"], "doc_id")


@query(CELLS_SQL + " , p AS (SELECT run_id, doc_id, bool_and(outcome_normalized IN ('correct', 'correct_null', 'excluded_uncertain')) AS perfect FROM cells GROUP BY ALL) SELECT run_id, count(*)::BIGINT AS docs, count(*) FILTER (perfect)::BIGINT AS perfect FROM p GROUP BY run_id")
def perfect_docs(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return report.perfect(c, c, ["run_id", "doc_id"], "outcome_normalized").groupBy("run_id").agg(F.count("*").alias("docs"), F.count_if(F.col("perfect")).alias("perfect"))


@query(CELLS_SQL + f""", answered AS (SELECT doc_id FROM cells WHERE run_id IN ('r1', 'r2') GROUP BY doc_id HAVING count(*) FILTER (outcome_exact = 'no_output') = 0)
SELECT run_id, count(*) FILTER (outcome_normalized IN ('correct', 'correct_null'))::BIGINT AS correct, count(*) FILTER (outcome_normalized IN {_SCORED})::BIGINT AS scored FROM cells WHERE run_id IN ('r1', 'r2') AND doc_id IN (SELECT doc_id FROM answered) GROUP BY run_id""")
def subset_rescore(spark: SparkSession, d: str) -> DataFrame:
    runs = ["r1", "r2"]
    o = F.col("outcome_normalized")
    own = lambda x, r: F.when(F.col("run_id") == r, x)
    sums = [c.alias(f"{r}_{k}") for r in runs for k, c in zip(("correct", "scored"), metrics.accuracy(own(o, r)))]
    # a document's sums and its cells without output come from one aggregate; no cell is joined or sorted
    docs = cells(spark, d, runs).groupBy("doc_id").agg(F.count_if(F.col("outcome_exact") == "no_output").alias("n"), *[F.count_if(F.col("run_id") == r).alias(f"{r}_cells") for r in runs], *sums).filter("n = 0")
    each = docs.agg(*[F.sum(f"{r}_{k}").alias(f"{r}_{k}") for r in runs for k in ("cells", "correct", "scored")])
    rows = F.array(*[F.struct(F.lit(r).alias("run_id"), *[F.col(f"{r}_{k}").alias(k) for k in ("cells", "correct", "scored")]) for r in runs])
    return each.select(F.explode(rows).alias("r")).select("r.*").filter("cells > 0").drop("cells")


@query(f"""WITH {GOLD_SQL}, x AS (SELECT *, CASE field WHEN 'price' THEN TRY_CAST(gold AS DOUBLE) END AS num FROM gold)
SELECT field, count(*)::BIGINT AS n, count(gold)::BIGINT AS n_values, round(sum(num), 2) AS total FROM x GROUP BY field""")
def gold_melt(spark: SparkSession, d: str) -> DataFrame:
    g = gold_cells(spark, d)
    return g.groupBy("field").agg(F.count("*").alias("n"), F.count("gold").alias("n_values"), F.round(F.sum(F.when(F.col("field") == "price", F.col("gold").try_cast("decimal(15,2)"))).cast("double"), 2).alias("total"))


@query("""WITH o AS (SELECT o_orderkey AS doc_id, o_orderstatus AS gold FROM orders), l AS (SELECT l_orderkey AS doc_id, min(l_linestatus) AS a, max(l_linestatus) AS b FROM lineitem GROUP BY 1),
p AS (SELECT o.doc_id, gold, CASE WHEN a IS NULL THEN NULL WHEN a = b THEN a ELSE 'P' END AS pred FROM o LEFT JOIN l USING (doc_id))
SELECT CASE WHEN gold IS NULL AND pred IS NULL THEN 'correct_null' WHEN gold IS NULL THEN 'hallucination' WHEN pred IS NULL THEN 'omission' WHEN gold = pred THEN 'correct' ELSE 'wrong' END AS outcome, count(*)::BIGINT AS n FROM p GROUP BY 1""")
def derived_status(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min("l_linestatus").alias("a"), F.max("l_linestatus").alias("b"))
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("gold")).join(lines, "doc_id", "left")
    pred = F.when(F.col("a") == F.col("b"), F.col("a")).when(F.col("a").isNotNull(), "P")
    return p.groupBy(classify(F.col("gold"), pred, F.col("gold") == pred).alias("outcome")).agg(F.count("*").alias("n"))
