"""One-pass column reports: many small aggregates in one job, turned into one row per column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_report(df: DataFrame, columns: Sequence[str], metrics: dict[str, Callable[[str], Column]]) -> DataFrame:
    """``metrics`` maps an output name to an aggregate builder; the result has one row per column.

    The table is read once and leaves the map side as one row of partial aggregates per task.
    """
    one = df.agg(*[build(x).alias(f"{m}__{i}") for i, x in enumerate(columns) for m, build in metrics.items()])
    rows = F.array(*[
        F.struct(F.lit(x).alias("column_name"), *[F.col(f"{m}__{i}").alias(m) for m in metrics])
        for i, x in enumerate(columns)
    ])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "feature",
              value: str = "value", keep_null: bool = True) -> DataFrame:
    """One row per (row, column); with ``keep_null=False`` missing cells are dropped before the explode."""
    cells = F.array(*[F.struct(F.lit(x).alias("n"), F.col(f"`{x}`").cast("double").alias("v")) for x in columns])
    if not keep_null:
        cells = F.filter(cells, lambda s: s["v"].isNotNull())
    return df.select(*keys, F.explode(cells).alias("_c")).select(*keys, F.col("_c.n").alias(name), F.col("_c.v").alias(value))


def cell_report(df: DataFrame, columns: Sequence[str], metrics: dict[str, Column], value: Column, keys: Sequence[str] = (),
                kind: str = "double") -> DataFrame:
    """One row per column from aggregates over its cells. ``metrics`` are aggregates over ``raw`` (the cell cast to
    ``kind``) and ``v`` (``value`` applied to it once), and over ``keys`` of the row.

    Cells are exploded inside the map stage and combined there: what is shuffled is one row per column and
    task. The plan stays the same size for any number of columns, where one aggregate per column and metric
    would be hundreds of expressions that the JVM no longer compiles.
    """
    cells = F.array(*[F.struct(F.lit(x).alias("n"), F.col(f"`{x}`").cast(kind).alias("raw")) for x in columns])
    long = df.select(*keys, F.explode(cells).alias("_c")).select(*keys, F.col("_c.n").alias("column_name"), F.col("_c.raw").alias("raw"))
    return long.withColumn("v", value).groupBy("column_name").agg(*[e.alias(k) for k, e in metrics.items()])
