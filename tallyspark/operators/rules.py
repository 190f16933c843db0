"""Rules over records: a list of (name, field, predicate, evidence), all tested in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Rule:
    name: str
    field: str
    broken: Column
    evidence: Column


def sweep(records: DataFrame, key: list[str], rules: list[Rule]) -> DataFrame:
    """``key, rule, field, evidence`` of every rule that a record breaks; an unknown (null) verdict breaks none."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.field).alias("field"), r.evidence.cast("string").alias("evidence"))) for r in rules]))
    return records.select(*key, F.explode(found).alias("f")).select(*key, "f.*")


def rule_counts(findings: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings per rule, zero where there are none."""
    spark = findings.sparkSession
    names = spark.createDataFrame([(r.name,) for r in rules], "rule string")
    return F.broadcast(names).join(findings.groupBy("rule").agg(F.count("*").alias("n")), "rule", "left").fillna(0, ["n"])


# --- checks by kind -----------------------------------------------------------------


def check_str(x: Column, nullable: bool = True) -> Column:
    return F.when(x == "", "empty string").when(x.isNull() & F.lit(not nullable), "required")


def check_date(x: Column, nullable: bool = True) -> Column:
    """ISO text that is a real calendar date."""
    real = x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(x, "yyyy-MM-dd").isNotNull()
    return F.when(x.isNull() & F.lit(not nullable), "required").when(x.isNotNull() & ~real, "not a date")


def check_enum(x: Column, allowed: list[str], nullable: bool = True) -> Column:
    return F.when(x.isNull() & F.lit(not nullable), "required").when(~x.isin(allowed), "not in vocabulary")


def check_range(x: Column, low: float, high: float, nullable: bool = True) -> Column:
    return F.when(x.isNull() & F.lit(not nullable), "required").when((x < low) | (x > high), "out of range")


def violations(records: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """``key, field, reason`` of every check (a reason or null) that fails."""
    found = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(f).alias("field"), c.alias("reason"))) for f, c in checks.items()]))
    return records.select(*key, F.explode(found).alias("v")).select(*key, "v.*")
