"""Literal values in texts, without comparing every text with every value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.shared import keep

#: Characters of the grams that index values without a whole word inside.
GRAM = 3
_GAP = "[ \t\n\r]+"


def _grams(x: Column, size: int) -> Column:
    last = F.length(x) - size
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.substring(x, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def literal_hits(docs: DataFrame, values: DataFrame, *, text: str = "text", key: str = "item_id", value: str = "value") -> DataFrame:
    """``docs`` columns with ``key, n, position`` for every value that occurs in a text.

    ``n`` counts non-overlapping occurrences, ``position`` is the first one's (from 1). Empty
    and null values occur nowhere.

    A word that stands between white space inside a value stands so in every text that holds
    it. Each value is indexed by the rarest of its inner words in the texts, or by its rarest
    ``GRAM`` characters (all, if it has fewer) where it has none. Texts give the words that
    some value has, once; those that meet a value's rarest word are searched for the value
    itself. Neither values nor texts pass through the driver; copies of a text are searched
    for alike, by its digest.
    """
    rows = values.select(F.col(key).cast("bigint").alias("k"), F.col(value).cast("string").alias("v")).filter("v <> ''").groupBy("k", "v").agg(F.count("*").cast("int").alias("copies"))
    parts = F.split("v", _GAP)
    inner = F.array_distinct(F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: w != ""))
    grams = F.when(F.length("v") >= GRAM, _grams(F.col("v"), GRAM)).otherwise(F.array("v"))
    kind = F.when(F.size("inner") > 0, "word").otherwise("gram")
    terms = rows.withColumn("inner", inner).select("k", "v", "copies", kind.alias("kind"), F.explode(F.when(F.size("inner") > 0, F.col("inner")).otherwise(grams)).alias("term"))
    terms = keep(terms, "value-terms")
    whole = docs.select(F.md5(F.col(text)).alias("digest"), F.col(text).alias("t")).filter("t IS NOT NULL")
    of_texts = whole.select("digest", F.lit("word").alias("kind"), F.explode(F.array_distinct(F.split("t", _GAP))).alias("term"))
    if terms.filter("kind = 'gram'").limit(1).count():
        for size in range(1, GRAM + 1):
            of_texts = of_texts.unionByName(whole.select("digest", F.lit("gram").alias("kind"), F.explode(_grams(F.col("t"), size)).alias("term")))
    met = keep(of_texts.join(terms.select("kind", "term").distinct(), ["kind", "term"], "left_semi").distinct(), "text-terms")
    counted = terms.join(met.groupBy("kind", "term").agg(F.count("*").alias("n")), ["kind", "term"], "left")
    # a term that no text has rules its values out
    rarest = counted.groupBy("k", "v", "copies", "kind").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("x")).filter("x.n > 0").select("k", "v", "copies", "kind", F.col("x.term").alias("term"))
    found = met.join(rarest, ["kind", "term"]).select(F.col("digest").alias("__digest"), F.col("k").alias(key), F.col("v").alias("__v"), F.col("copies").alias("__copies"))
    hits = docs.withColumn("__digest", F.md5(F.col(text))).join(found, "__digest").filter(F.contains(F.col(text), F.col("__v")))
    n = ((F.length(text) - F.length(F.replace(F.col(text), F.col("__v"), F.lit("")))) / F.length("__v")).cast("bigint")
    hits = hits.withColumn("__each", F.explode(F.sequence(F.lit(1), F.col("__copies"))))  # values that repeat are answered each
    return hits.select(*docs.columns, key, n.alias("n"), F.expr(f"cast(locate(__v, `{text}`) as bigint)").alias("position"))


def status(n: Column) -> Column:
    """unique, ambiguous or missing by the number of occurrences."""
    return F.when(n == 0, "missing").when(n == 1, "unique").otherwise("ambiguous")


def crosscheck_fields(records: DataFrame, key: list[str], kinds: dict[str, str], text: str = "text", expected_missing: tuple[str, ...] = ()) -> DataFrame:
    """``key, field, value, searched, n, status, expected``: how often each record's own text prints its scalar fields.

    ``kinds`` maps a field to str, date, int or number, and so to the ways it may be printed;
    null fields are left out. A record without text has every value missing, so one bad
    document does not stop the batch. ``expected`` marks missing fields that are normalised.
    """
    from tallyspark.functions.formats import join_address_lines, renderings
    from tallyspark.functions.values import occurrences

    t = F.coalesce(join_address_lines(F.col(text)), F.lit(""))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), renderings(k, F.col(f)).alias("searched")) for f, k in kinds.items()])
    rows = records.withColumn("__text", t).select(*key, "__text", F.explode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("c"))
    n = F.aggregate("c.searched", F.lit(0).cast("bigint"), lambda a, v: a + occurrences(F.col("__text"), v))
    return rows.select(*key, "c.*", n.alias("n")).withColumn("status", status(F.col("n"))).withColumn("expected", (F.col("status") == "missing") & F.col("field").isin(*expected_missing) if expected_missing else F.lit(False))
