"""Gold and predicted relations over the test tables, in Spark and as SQL.

Gold is ``orders`` with some values removed; every run is a perturbation of gold that an
md5 of (run, key, field) decides, so that all outcomes occur and any engine agrees on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.values import hash_bucket, normalize
from tallyspark.operators.cells import melt, outcome
from tallyspark.shipping import ship

RUNS = ["r1", "r2", "r3", "r4", "r5"]
FIELDS = ["status", "priority", "price", "odate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents of a portion of :func:`predicted`, at most about.
PORTION_DOCS = 250_000


def _gold(orders: DataFrame, also: list[str]) -> DataFrame:
    """doc_id, field, gold and further columns of the records."""
    fields = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "price": F.col("o_totalprice").cast("decimal(15,2)"), "odate": F.col("o_orderdate").cast("date")}
    cells = melt(orders.withColumnRenamed("o_orderkey", "doc_id"), ["doc_id", *also], fields, "raw")
    return cells.select("doc_id", "field", *also, F.when(hash_bucket("gold", F.col("doc_id"), F.col("field")) >= 10, F.col("raw")).alias("gold"))


def gold_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, field, gold."""
    return _gold(table(spark, sf_dir, "orders"), [])


def predicted(spark: SparkSession, sf_dir: str, runs: list[str] = RUNS) -> DataFrame:
    """run_id, doc_id, field, gold, g (gold normalised), prediction, no_output, uncertain.

    Records are dealt by doc_id once, before they are multiplied, so what is grouped by
    documents later needs no shuffle of cells. Buckets are made inside the generators: what
    filters on outcomes ask for is not pushed below them and computed anew.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    portions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-orders.count() // PORTION_DOCS))
    failed = F.array(*[hash_bucket(F.lit(r), F.col("o_orderkey")) < 3 for r in runs])
    c = _gold(orders.repartition(portions, "o_orderkey").withColumn("failed", failed), ["failed"])
    c = c.withColumns({"uncertain": hash_bucket("unc", F.col("doc_id"), F.col("field")) < 4, "g": normalize(F.col("gold"))})
    own = [F.struct(F.lit(r).alias("run_id"), hash_bucket(F.lit(r), F.col("doc_id"), F.col("field")).alias("b"), F.get("failed", F.lit(i)).alias("no_output")) for i, r in enumerate(runs)]
    c = c.select("doc_id", "field", "gold", "g", "uncertain", F.explode(F.array(*own)).alias("r")).select("doc_id", "field", "gold", "g", "uncertain", "r.*")
    gold, b = F.col("gold"), F.col("b")
    invented = F.when(gold.isNull(), F.when(b >= 90, F.lit("invented")))
    prediction = F.when(F.col("no_output"), None).otherwise(
        F.when(gold.isNull(), invented).when(b < 10, None).when(b < 18, F.concat(gold, F.lit("x"))).when(b < 24, F.concat(F.lit("  "), F.upper(gold), F.lit(" "))).otherwise(gold)
    )
    return c.select("run_id", "doc_id", "field", "gold", "g", prediction.alias("prediction"), "no_output", "uncertain")


def outcomes() -> dict[str, Column]:
    """outcome_exact and outcome_normalized of :func:`predicted`."""
    gold, p, flags = F.col("gold"), F.col("prediction"), (F.col("no_output"), F.col("uncertain"))
    return {"outcome_exact": outcome(gold, p, gold == p, *flags), "outcome_normalized": outcome(gold, p, (gold == p) | (F.col("g") == normalize(p)), *flags)}


def cells(spark: SparkSession, sf_dir: str, runs: list[str] = RUNS) -> DataFrame:
    """run_id, doc_id, field, gold, prediction, outcome_exact, outcome_normalized."""
    return predicted(spark, sf_dir, runs).select("run_id", "doc_id", "field", "gold", "prediction", *[c.alias(k) for k, c in outcomes().items()])


# --- the same as SQL ----------------------------------------------------------------


def bucket_sql(*parts: str, of: int = 100) -> str:
    key = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({key}), 1, 4))::INT % {of})"


def normalize_sql(x: str) -> str:
    return rf"replace(lower(trim(regexp_replace({x}, '\s+', ' ', 'g'))), 'ß', 'ss')"


def _outcome_sql(equal: str) -> str:
    return f"CASE WHEN uncertain THEN 'excluded_uncertain' WHEN no_output THEN 'no_output' WHEN gold IS NULL AND prediction IS NULL THEN 'correct_null' WHEN gold IS NULL THEN 'hallucination' WHEN prediction IS NULL THEN 'omission' WHEN {equal} THEN 'correct' ELSE 'wrong' END"


GOLD_SQL = f"""
raw AS (SELECT o_orderkey AS doc_id, unnest(['status', 'priority', 'price', 'odate']) AS field,
  unnest([o_orderstatus, o_orderpriority, CAST(o_totalprice AS DECIMAL(15,2))::VARCHAR, CAST(o_orderdate AS DATE)::VARCHAR]) AS raw FROM orders),
gold AS (SELECT doc_id, field, CASE WHEN {bucket_sql("'gold'", 'doc_id', 'field')} >= 10 THEN raw END AS gold FROM raw)"""

CELLS_SQL = f"""WITH {GOLD_SQL},
flags AS (SELECT run_id, doc_id, field, gold, {bucket_sql('run_id', 'doc_id', 'field')} AS b, {bucket_sql('run_id', 'doc_id')} < 3 AS no_output, {bucket_sql("'unc'", 'doc_id', 'field')} < 4 AS uncertain
  FROM gold, (SELECT unnest(['r1', 'r2', 'r3', 'r4', 'r5']) AS run_id)),
pred AS (SELECT *, CASE WHEN no_output THEN NULL WHEN gold IS NULL THEN CASE WHEN b >= 90 THEN 'invented' END WHEN b < 10 THEN NULL WHEN b < 18 THEN gold || 'x' WHEN b < 24 THEN '  ' || upper(gold) || ' ' ELSE gold END AS prediction FROM flags),
cells AS (SELECT run_id, doc_id, field, gold, prediction, {_outcome_sql('gold = prediction')} AS outcome_exact, {_outcome_sql(normalize_sql('gold') + ' = ' + normalize_sql('prediction'))} AS outcome_normalized FROM pred)"""
