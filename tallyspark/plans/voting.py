"""Votes, audits, corrections and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.values import hash_bucket, normalize
from tallyspark.operators import corrections, report, resample, stats, vote
from tallyspark.operators.cells import unusable
from tallyspark.plans.bindings import CELLS_SQL, GOLD_SQL, RUNS, bucket_sql, cells, gold_cells, normalize_sql, predicted, table
from tallyspark.plans.registry import Registry
from tallyspark.shared import keep

REGISTRY = Registry()
query = REGISTRY.add
CELL = ["doc_id", "field"]

#: Runs without output for a document abstain there; fields left out as uncertain are not audited.
_VOTES = CELLS_SQL + f""", votes AS (SELECT run_id, doc_id, field, gold, prediction, {normalize_sql('gold')} AS g, {normalize_sql('prediction')} AS p FROM cells WHERE outcome_exact NOT IN ('no_output', 'excluded_uncertain'))"""


def votes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("prediction")
    same = F.when(p == F.col("gold"), F.col("g")).otherwise(normalize(p))  # most need no second normalisation
    return predicted(spark, d).filter("NOT no_output AND NOT uncertain").select("run_id", "doc_id", "field", "gold", "prediction", "g", same.alias("p"))


@query(_VOTES + """, c AS (SELECT doc_id, field, g, p, count(*) AS n_agree, min(run_id) AS first_run FROM votes GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY n_agree DESC, first_run) AS r FROM c WHERE n_agree >= 3 AND g IS DISTINCT FROM p)
SELECT doc_id, field, g AS gold_value, p AS consensus_value, n_agree::BIGINT AS n_agree FROM r WHERE r = 1""")
def consensus_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = vote.consensus_against_gold(votes(spark, d), CELL, F.col("p"), F.col("g"), "run_id", runs=RUNS)
    return c.select("doc_id", "field", F.col("gold_key").alias("gold_value"), F.col("value").alias("consensus_value"), "n_agree")


_UNANIMOUS = _VOTES + f""", u AS (SELECT doc_id, field FROM votes GROUP BY ALL HAVING count(*) = {len(RUNS)} AND bool_and(g IS NOT DISTINCT FROM p))"""


def _unanimous(spark: SparkSession, d: str) -> DataFrame:
    return vote.unanimous(votes(spark, d), CELL, F.col("g").eqNullSafe(F.col("p")), len(RUNS))


@query(_UNANIMOUS + " SELECT field, count(*)::BIGINT AS n FROM u GROUP BY field")
def unanimous_cells(spark: SparkSession, d: str) -> DataFrame:
    return _unanimous(spark, d).groupBy("field").agg(F.count("*").alias("n"))


@query(_VOTES + " SELECT doc_id, field, " + ", ".join(f"coalesce(max(coalesce(prediction, 'null')) FILTER (run_id = '{r}'), '') AS {r}" for r in RUNS) + " FROM votes GROUP BY doc_id, field")
def vote_pivot(spark: SparkSession, d: str) -> DataFrame:
    return vote.pivot_votes(votes(spark, d), CELL, RUNS, "prediction")


_SAMPLED = "(SELECT *, row_number() OVER (ORDER BY md5('{seed}|' || {key}), {key}) AS r FROM {pool})"


@query(_UNANIMOUS + """, k AS (SELECT doc_id, field, doc_id || '/' || field AS key FROM u) SELECT doc_id, field, key FROM """ + _SAMPLED.format(seed=20261013, key="key", pool="k") + " WHERE r <= 30")
def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    return resample.seeded_sample(_unanimous(spark, d).withColumn("key", F.concat_ws("/", "doc_id", "field")), "key", 30, 20261013)


@query(_UNANIMOUS + """, k AS (SELECT doc_id, field, doc_id || '/' || field AS key FROM u), a AS (SELECT doc_id, field, key FROM """ + _SAMPLED.format(seed=20261013, key="key", pool="k") + """ WHERE r <= 30),
rest AS (SELECT * FROM k WHERE key NOT IN (SELECT key FROM a)) SELECT * FROM a UNION ALL SELECT doc_id, field, key FROM """ + _SAMPLED.format(seed=20261015, key="key", pool="rest") + " WHERE r <= 20")
def extend_sample(spark: SparkSession, d: str) -> DataFrame:
    pool = keep(_unanimous(spark, d), "unanimous").withColumn("key", F.concat_ws("/", "doc_id", "field"))
    return resample.extend_sample(resample.seeded_sample(pool, "key", 30, 20261013), pool, "key", 50, 20261015)


@query(_VOTES + """, flagged AS (SELECT doc_id, field, count(*) FILTER (p IS DISTINCT FROM g) AS against FROM votes GROUP BY ALL), f AS (SELECT doc_id, field, against >= 3 AS by_vote, field = 'price' AND """ + bucket_sql("'rule'", "doc_id") + """ < 5 AS by_rule FROM flagged)
SELECT CASE WHEN GROUPING(by_rule) = 1 THEN 'All' ELSE by_rule::VARCHAR END AS by_rule, CASE WHEN GROUPING(by_vote) = 1 THEN 'All' ELSE by_vote::VARCHAR END AS by_vote, count(*)::BIGINT AS n FROM f WHERE by_vote OR by_rule GROUP BY CUBE (by_rule, by_vote)""")
def audit_methods(spark: SparkSession, d: str) -> DataFrame:
    against, rule = ~F.col("p").eqNullSafe(F.col("g")), F.when(F.col("field") == "price", hash_bucket("rule", F.col("doc_id")) < 5).otherwise(False)
    # votes that neither method asks about are not grouped
    v = votes(spark, d).select(*CELL, against.alias("against"), rule.alias("by_rule")).filter("against OR by_rule")
    f = v.groupBy(*CELL, "by_rule").agg(F.count_if("against").alias("against")).select((F.col("against") >= 3).alias("by_vote"), "by_rule")
    return report.crosstab(f.filter("by_vote OR by_rule"), "by_rule", "by_vote")


@query(f"WITH {GOLD_SQL}, c AS (SELECT field, gold AS value, count(*) AS n FROM gold WHERE gold IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM c WHERE n >= 2) SELECT field, value, n::BIGINT AS n FROM r WHERE r = 1")
def trivial_mode(spark: SparkSession, d: str) -> DataFrame:
    return stats.most_frequent(gold_cells(spark, d), ["field"], "gold").withColumnRenamed("gold", "value")


_CORRECTIONS = f"""WITH c AS (SELECT doc_id, 'quality' AS field, quality::VARCHAR AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic::VARCHAR FROM labels),
k AS (SELECT doc_id, field, CASE WHEN {bucket_sql("'old'", 'doc_id')} < 90 THEN value ELSE '9' END AS expected_old, CASE WHEN {bucket_sql("'new'", 'doc_id')} < 20 THEN value ELSE '2' END AS new FROM c WHERE {bucket_sql("'pick'", 'doc_id', 'field')} < 15),
p AS (SELECT k.*, c.value AS current, CASE WHEN c.value IS NOT DISTINCT FROM k.new THEN 'already_ok' WHEN c.value IS NOT DISTINCT FROM k.expected_old THEN 'apply' ELSE 'conflict' END AS status FROM k LEFT JOIN c USING (doc_id, field))
SELECT doc_id, field, expected_old, new, current, status FROM p"""


@query(_CORRECTIONS)
def correction_status(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    c = labels.select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic")).unpivot(["doc_id"], ["quality", "toxic"], "field", "value")
    i = F.col("doc_id")
    k = c.filter(hash_bucket("pick", i, F.col("field")) < 15).select("doc_id", "field", F.when(hash_bucket("old", i) < 90, F.col("value")).otherwise("9").alias("expected_old"), F.when(hash_bucket("new", i) < 20, F.col("value")).otherwise("2").alias("new"))
    return corrections.plan(c, k, ["doc_id", "field"], "value").select("doc_id", "field", "expected_old", "new", "current", "status")


# --- runs: responses, passes, costs -------------------------------------------------


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE NOT (event_type = 'error' OR value IS NULL) AND event_id NOT IN (SELECT event_id FROM events WHERE value > 50) GROUP BY event_type")
def resume_todo(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    usable = e.filter(~unusable(F.col("event_type"), F.col("value").cast("string")))
    return usable.join(e.filter("value > 50").select("event_id"), "event_id", "left_anti").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)")
def split_discovery(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id")


@query("SELECT count(*)::BIGINT AS n, (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels))::BIGINT AS n_union FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def split_sets(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    both = docs.intersect(labels).agg(F.count("*").alias("n"))
    either = docs.union(labels).distinct().agg(F.count("*").alias("n_union"))
    return both.join(F.broadcast(either))  # one row each


_GAPS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS pass FROM g)"""


@query(_GAPS + " SELECT user_id, pass::BIGINT AS pass, count(*)::BIGINT AS n, min(event_id) AS first_event FROM p GROUP BY user_id, pass")
def gap_passes(spark: SparkSession, d: str) -> DataFrame:
    return report.passes(table(spark, d, "events"), ["user_id"], "ts", 12 * 3600, ["event_id"]).groupBy("user_id", "pass").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT event_type, count(value)::BIGINT AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(median(value), 9) AS median, round(quantile_cont(value, 0.9), 9) AS p90 FROM events GROUP BY event_type")
def cost_latency(spark: SparkSession, d: str) -> DataFrame:
    t = report.describe(table(spark, d, "events"), ["event_type"], F.col("value"))
    return t.select("event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), F.round("median", 9).alias("median"), F.round("p90", 9).alias("p90"))


@query(CELLS_SQL + """, m AS (SELECT run_id, round(count(*) FILTER (outcome_normalized IN ('correct', 'correct_null'))::DOUBLE / count(*) FILTER (outcome_normalized <> 'excluded_uncertain'), 9) AS accuracy FROM cells GROUP BY run_id),
c AS (SELECT 'r' || (event_id % 5 + 1) AS run_id, round(avg(value), 6) AS mean_cost FROM events GROUP BY 1) SELECT run_id, accuracy, mean_cost FROM m JOIN c USING (run_id)""")
def cost_accuracy(spark: SparkSession, d: str) -> DataFrame:
    from tallyspark.operators import metrics

    m = cells(spark, d).groupBy("run_id").agg(F.round(metrics.ratio(*metrics.accuracy(F.col("outcome_normalized"))), 9).alias("accuracy"))
    c = table(spark, d, "events").groupBy(F.concat(F.lit("r"), (F.col("event_id") % 5 + 1).cast("string")).alias("run_id")).agg(F.round(F.avg("value"), 6).alias("mean_cost"))
    return m.join(c, "run_id").select("run_id", "accuracy", "mean_cost")
