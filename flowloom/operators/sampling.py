"""Deterministic evenly spaced sample: the operator itself is a sample, so the limit is its meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import UPTO


def sample_even(df: DataFrame, order: str, k: int, cell: Column) -> DataFrame:
    """Rows at positions floor(i * (n - 1) / (k - 1)), i = 0 … k - 1, in ``order``.

    Cells are counted, the (at most k) cells that hold a wanted position are found from their offsets, and only their
    rows are numbered.
    """
    k = max(k, 1)
    celled = df.withColumn("_cell", cell)
    sizes = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_c"))
    offsets = sizes.select("_cell", "_c", (F.sum("_c").over(Window.orderBy("_cell").rowsBetween(*UPTO)) - F.col("_c")).alias("_off"))
    n = sizes.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_n")).select("_n", F.least(F.lit(k), F.col("_n")).alias("_k")).where("_n > 0")
    step = F.when(F.col("_k") > 1, (F.col("_n") - 1) / (F.col("_k") - 1)).otherwise(F.lit(0.0))
    want = n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)).alias("_i"), step.alias("_s")).select(F.floor(F.col("_i") * F.col("_s")).alias("_pos")).distinct()
    held = offsets.join(F.broadcast(want), (F.col("_pos") >= F.col("_off")) & (F.col("_pos") < F.col("_off") + F.col("_c")))
    cells = held.groupBy("_cell").agg(F.first("_off").alias("_off"), F.collect_set("_pos").alias("_want"))  # k positions at most
    rows = celled.join(F.broadcast(cells), "_cell").withColumn("pos", (F.row_number().over(Window.partitionBy("_cell").orderBy(order)) - 1 + F.col("_off")).cast("long"))
    return rows.where(F.array_contains("_want", F.col("pos"))).drop("_cell", "_off", "_want")
