"""Scans of records, notices, responses, listings and cell tables.

Everything goes through Spark's readers, so inputs may lie in any store it knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Stands for null in CSV tables; a text equal to it would be read as null.
NULL_MARK = "␀"

RESPONSES = (
    "run_id string, doc_id string, split string, status string, error struct<type:string,message:string,attempts:bigint>, response_text string, finish_reason string, model_served string, "
    "provider_served string, attempts bigint, reasoning_tokens bigint, response_chars bigint, latency_ms double, cost_usd double, timestamp timestamp, "
    "usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,cost:double>"
)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def json_records(spark: SparkSession, path: str, schema: str | StructType, *, id_col: str = "doc_id") -> DataFrame:
    """One record per JSON file; bad JSON stops the scan. A missing id is the file's stem. The schema is stated, never inferred."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)
    df = df.withColumn("_file", F.col("_metadata.file_name"))
    own = F.col(id_col) if id_col in df.columns else F.lit(None).cast("string")
    return df.withColumn(id_col, F.coalesce(own, file_stem(F.col("_file")))).drop("_file")


def raw_json(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, json``: whole files as text, for typed comparison (a schema would turn a string in a number's place into null)."""
    return texts(spark, path).select("doc_id", F.col("text").alias("json"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text`` of whole UTF-8 files."""
    return spark.read.text(path, wholetext=True).select(file_stem(F.col("_metadata.file_name")).alias("doc_id"), F.col("value").alias("text"))


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Model responses with their nested usage flattened."""
    return json_records(spark, path, RESPONSES).select("*", "usage.prompt_tokens", "usage.completion_tokens", "usage.total_tokens", F.col("usage.cost").alias("usage_cost")).drop("usage")


def cell_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table of text columns where an empty text is not null."""
    return spark.read.option("header", True).option("nullValue", NULL_MARK).option("emptyValue", "").option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).schema(schema).csv(path)


def manifest(spark: SparkSession, path: str, record: str) -> DataFrame:
    """The entries of a file's ``records`` list."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"records array<struct<{record}>>").json(path)
    return df.select(F.explode("records").alias("r")).select("r.*")


def discover(raw: DataFrame, gold: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """Documents of a split: those with text, and with gold where the split has any."""
    return raw.select(key).distinct() if gold is None else raw.select(key).distinct().join(gold.select(key), key, "left_semi")


def select_docs(docs: DataFrame, wanted: list[str] | None = None, limit: int | None = None, key: str = "doc_id") -> DataFrame:
    """The wanted documents in the order asked for (an unknown one is an error), or all by id; then the limit."""
    if wanted is None:
        out = docs.orderBy(key)
    else:
        asked = docs.sparkSession.createDataFrame(list(enumerate(wanted)), f"__pos bigint, {key} string")
        if missing := [r[key] for r in asked.join(docs, key, "left_anti").orderBy("__pos").limit(10).collect()]:
            raise ValueError(f"unknown documents: {missing}")
        out = docs.join(F.broadcast(asked), key).orderBy("__pos").drop("__pos")
    return out if limit is None else out.limit(limit)


def require_complete(expected: DataFrame, *sides: DataFrame, key: str = "doc_id") -> None:
    """An error if a document lacks a row on any side, for it would silently leave the denominators."""
    for i, side in enumerate(sides):
        if missing := [r[key] for r in expected.join(side, key, "left_anti").select(key).limit(10).collect()]:
            raise ValueError(f"documents without a row in input {i + 1}: {missing}")


def reported_total(html: Column) -> Column:
    """The number of rows a page says it has, or null."""
    return F.regexp_extract(html, r"(?s)([0-9]+)\s*(?:Treffer|results|Ergebnisse)", 1).try_cast("int")


def listing_name(path: Column) -> tuple[Column, Column]:
    """(canton, date) from a name like ``zh_2026-08-18.html``; any other name is an error."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    ok = name.rlike(r"^[A-Za-z]{2}_[0-9]{4}-[0-9]{2}-[0-9]{2}\.html$")
    bad = F.raise_error(F.concat(F.lit("not a listing's name: "), name)).cast("string")
    return F.when(ok, F.upper(F.left(name, F.lit(2)))).otherwise(bad), F.when(ok, F.substring(name, 4, 10)).otherwise(bad)
