"""Report tables: crosstabs, before and after, passes, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = "All"


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of both columns with margins named ``All``; null is shown as (null)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(null)"))
    cube = df.select(text(a).alias(a), text(b).alias(b)).cube(a, b).agg(F.count("*").alias("n"))
    return cube.select(F.coalesce(a, F.lit(ALL)).alias(a), F.coalesce(b, F.lit(ALL)).alias(b), "n")


def nested_report(cells: DataFrame, groups: dict[str, list[str]], outcomes: list[str], modes: tuple[str, ...] = ("exact", "normalized"), run: str = "run_id") -> DataFrame:
    """``run, report``: counts of outcomes and the accuracy of each run as one JSON tree: overall, by group of fields, by field, each by mode.

    One aggregate with grouping sets makes all levels; what is folded into a run's tree is a
    row for each field and group. A field in no group is under none. Accuracies are decimal
    text of six digits, null where nothing is scored.
    """
    group = F.lit(None).cast("string")
    for name, fields in groups.items():
        group = F.when(F.col("field").isin(fields), name).otherwise(group)
    level = F.grouping_id().alias("level")

    def block(mode: str) -> Column:
        o = F.col(f"outcome_{mode}")
        accuracy = F.try_divide(F.count_if(o.isin("correct", "correct_null")).cast("double"), F.count_if(o.isin(outcomes)).cast("double"))
        return F.struct(*[F.count_if(o == x).alias(x) for x in (*outcomes, "excluded_uncertain")], accuracy.cast("decimal(9,6)").cast("string").alias("accuracy")).alias(mode)

    by = [F.col(run), F.col("group"), F.col("field")]
    sets = cells.withColumn("group", group).groupingSets([[by[0]], by[:2], [by[0], by[2]]], *by)
    rows = sets.agg(level, F.struct(*[block(m) for m in modes]).alias("block"))
    # bits of what is summed over: group, field
    named = lambda bits, name: F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("level") == bits) & F.col(name).isNotNull(), F.struct(F.col(name), F.col("block"))))))
    tree = F.struct(F.max(F.when(F.col("level") == 3, F.col("block"))).alias("overall"), named(1, "group").alias("groups"), named(2, "field").alias("fields"))
    return rows.groupBy(run).agg(F.to_json(tree, {"ignoreNullFields": "false"}).alias("report"))


def before_after(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Full outer comparison: ``side`` both, left_only or right_only, and ``change`` fixed, broken, other or same."""
    l = before.select(*key, F.col(value).alias("before"), F.lit(True).alias("l"))
    r = after.select(*key, F.col(value).alias("after"), F.lit(True).alias("r"))
    ok = lambda c: F.col(c).isin("correct", "correct_null")
    side = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left_only").otherwise("right_only")
    change = F.when(F.col("before") == F.col("after"), "same").when(~ok("before") & ok("after"), "fixed").when(ok("before") & ~ok("after"), "broken").otherwise("other")
    return l.join(r, key, "full").select(*key, "before", "after", side.alias("side"), change.alias("change"))


def passes(events: DataFrame, by: list[str], ts: str, gap_seconds: int, order: list[str]) -> DataFrame:
    """``pass`` = 1, 2, ...: a new one begins when the time since the row before exceeds the gap."""
    w = Window.partitionBy(*by).orderBy(ts, *order)
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((seconds - F.lag(seconds).over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    return events.withColumn("new", new).withColumn("pass", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def describe(df: DataFrame, by: list[str], x: Column) -> DataFrame:
    """Sum, mean, exact median and 90th percentile."""
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.percentile(x, 0.9).alias("p90"))


def first_failures(failures: DataFrame, field: str, key: str, k: int) -> DataFrame:
    """For the ``k`` fields with most failures the lowest failing key; ties of counts by name."""
    top = failures.groupBy(field).agg(F.count("*").alias("n_failures"), F.min(key).alias("first_key"))
    return top.orderBy(F.desc("n_failures"), field).limit(k)


def first_of_groups(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """The row with the lowest ``key`` of each group, for few groups: their lowest keys pass through the driver.

    A minimum of whole rows would sort all of them, for texts are no running totals; keys
    alone are summed up before the shuffle, and only rows with one of them are compared.
    Rows without a key come last.
    """
    keys = {r[0] for r in rows.groupBy(*by).agg(F.min(key).alias("__least")).select("__least").distinct().collect()}
    asked = F.col(key).isin(sorted(keys - {None}))
    if None in keys:
        asked = asked | F.col(key).isNull()
    others = [c for c in rows.columns if c not in (*by, key)]
    least = F.min(F.struct(F.col(key).isNull().alias("__none"), key, *others)).alias("x")
    return rows.filter(asked).groupBy(*by).agg(least).select(*by, f"x.{key}", *[f"x.{c}" for c in others])


def perfect(cells: DataFrame, docs: DataFrame, key: list[str], outcome: str) -> DataFrame:
    """Whether all cells of a document are right; a document without cells is."""
    ok = cells.groupBy(*key).agg(F.bool_and(F.col(outcome).isin("correct", "correct_null", "excluded_uncertain")).alias("perfect"))
    return docs.select(*key).distinct().join(ok, key, "left").fillna(True, ["perfect"])
