"""Matching of list entries, map entries and label sets between gold and prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal_match(gold: DataFrame, pred: DataFrame, group: list[str], name: str, order: list[str]) -> DataFrame:
    """One-to-one match of equal names in order: the k-th gold entry of a name with the k-th predicted one.

    Returns ``group``, ``name``, ``rn``, both sides' other columns (``gold_``/``pred_``) and
    ``status`` matched, missed or spurious. A null name never matches, on either side.
    """

    keys = [*group, name, "rn", "apart"]

    def side(df: DataFrame, prefix: str) -> DataFrame:
        w = Window.partitionBy(*group, name).orderBy(*order)
        rest = [c for c in df.columns if c not in (*group, name)]
        apart = F.when(F.col(name).isNull(), prefix).otherwise("")  # keeps null names of both sides apart
        numbered = df.withColumn("rn", F.row_number().over(w)).withColumn("apart", apart)
        return numbered.select(*[F.col(k).alias(f"{prefix}key_{k}") for k in keys], *[F.col(c).alias(prefix + c) for c in rest])

    both = side(gold, "gold_").join(side(pred, "pred_"), [F.col(f"gold_key_{k}").eqNullSafe(F.col(f"pred_key_{k}")) for k in keys], "full")
    has_gold, has_pred = (F.col(f"{p}_key_rn").isNotNull() for p in ("gold", "pred"))
    status = F.when(has_gold & has_pred, "matched").when(has_gold, "missed").otherwise("spurious")
    rest = [c for c in both.columns if not c.startswith(("gold_key_", "pred_key_"))]
    return both.select(*[F.coalesce(f"gold_key_{k}", f"pred_key_{k}").alias(k) for k in keys[:-1]], *rest, status.alias("status"))


def key_match(gold: DataFrame, pred: DataFrame, group: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """Full outer join on map keys: ``status`` shared, gold_only or pred_only."""
    g = gold.select(*group, name, F.col(value).alias("gold"), F.lit(True).alias("g"))
    p = pred.select(*group, name, F.col(value).alias("pred"), F.lit(True).alias("p"))
    status = F.when(F.col("g") & F.col("p"), "shared").when(F.col("g"), "gold_only").otherwise("pred_only")
    return g.join(p, [*group, name], "full").select(*group, name, "gold", "pred", status.alias("status"))


def map_counts(matched: DataFrame, by: list[str], registered: Column) -> DataFrame:
    """tp, fp, fn of keys and matching values; a shared key that is not registered counts as one fn and one fp."""
    odd = (F.col("status") == "shared") & ~registered
    return matched.groupBy(*by).agg(
        F.count_if((F.col("status") == "shared") & registered).alias("tp"),
        F.count_if((F.col("status") == "pred_only") | odd).alias("fp"),
        F.count_if((F.col("status") == "gold_only") | odd).alias("fn"),
        F.count_if((F.col("status") == "pred_only") & ~registered | odd).alias("fp_unregistered"),
    )


def label_match(gold: DataFrame, pred: DataFrame, group: list[str], label: str) -> DataFrame:
    """Full outer join of two label sets: ``status`` tp, fp or fn."""
    g = gold.select(*group, label).distinct().withColumn("g", F.lit(True))
    p = pred.select(*group, label).distinct().withColumn("p", F.lit(True))
    status = F.when(F.col("g") & F.col("p"), "tp").when(F.col("g"), "fn").otherwise("fp")
    return g.join(p, [*group, label], "full").select(*group, label, status.alias("status"))
