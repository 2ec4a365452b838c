"""Exact contributions of a linear score, their ranking and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions.numeric import sigmoid


def linear(df: DataFrame, state: str, coef: Sequence[float], intercept: float) -> DataFrame:
    """Adds contributions (array), logit and reconstructed probability."""
    contrib = ar.multiply(F.col(state), ar.literal_vector(coef))
    out = df.withColumn("contributions", contrib)
    return out.withColumn("logit", ar.total(F.col("contributions")) + F.lit(float(intercept))).withColumn(
        "probability", sigmoid(F.col("logit")))


def direction(x: Column) -> Column:
    return F.when(x > 0, "attack").when(x < 0, "benign").otherwise("neutral")


def top_contributions(df: DataFrame, names: Sequence[str], k: int, *keys: str) -> DataFrame:
    """The k largest contributions per row by size, ties in feature order: sorted inside the row, no shuffle."""
    labels = F.array(*[F.lit(n) for n in names])
    cells = F.transform("contributions", lambda x, i: F.struct((-F.abs(x)).alias("o"), i.alias("i"), x.alias("v")))
    top = F.slice(F.array_sort(cells), 1, k)
    ranked = df.select(*keys, labels.alias("_n"), F.posexplode(top).alias("rank", "_c"))
    return ranked.select(*keys, (F.col("rank") + 1).alias("rank"), F.element_at("_n", F.col("_c.i") + 1).alias("feature"),
                         F.col("_c.v").alias("contribution"), direction(F.col("_c.v")).alias("direction"))


def global_attribution(df: DataFrame) -> DataFrame:
    return df.select(F.posexplode("contributions").alias("feature", "v")).groupBy("feature").agg(
        F.avg("v").alias("mean_contribution"), F.avg(F.abs("v")).alias("mean_abs_contribution"))


def grounding(df: DataFrame, expected: Column) -> DataFrame:
    """Largest distance between the reconstructed and the model probability."""
    gap = F.max(F.abs(F.col("probability") - expected))
    return df.agg(F.count(F.lit(1)).alias("n"), gap.alias("max_abs_gap")).withColumn("grounded", F.col("max_abs_gap") <= 1e-6)


def rollup(cells: DataFrame, by: str, value: str = "contribution") -> DataFrame:
    v = F.col(value)
    return cells.groupBy(by).agg(F.avg(v).alias("mean_contribution"), F.sum(v).alias("sum_contribution"), F.sum(F.abs(v)).alias("sum_abs_contribution"))


def importance_by(importances: DataFrame, part: int, name: str) -> DataFrame:
    """Importances of flattened names (step__feature) by step (0) or feature (1)."""
    piece = F.split("name", "__", 2).getItem(part)
    return importances.groupBy(piece.alias(name)).agg(
        F.sum("importance").alias("sum_importance"), F.avg("importance").alias("mean_importance"), F.max("importance").alias("max_importance"))


def baseline(train: DataFrame, history: str = "history") -> DataFrame:
    """Mean state over every (sequence, step) of the training sequences, one row per feature. A window counts
    once per sequence that contains it."""
    cells = train.select(F.explode(history).alias("_s")).select(F.posexplode("_s").alias("feature", "v"))
    return cells.groupBy("feature").agg(F.avg("v").alias("baseline"))
