"""Order-dependent building blocks that never put a whole table, or an unbounded group, in one task.

Three ideas are used throughout:

* cells   – rows are numbered inside bounded cells, the (few) cell totals are accumulated, and the
            offsets are joined back;
* halo    – rows next to a cell border are repeated in the neighbour cell, so LAG/LEAD/sliding frames
            over a dense id are exact although the partitioning key is only the cell;
* cdf     – equal values are merged first, then ranges of values are accumulated the same way as cells,
            which gives exact ranks, percentiles and ROC sums for any number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import staging_dir, write_stage

BEFORE = (Window.unboundedPreceding, -1)
UPTO = (Window.unboundedPreceding, Window.currentRow)


def dense_number(df: DataFrame, name: str, order: Sequence[str], cell: Column, by: Sequence[str] = ()) -> DataFrame:
    """0-based dense number in ``order`` per ``by``; ``cell`` must be monotone in ``order`` and bounded."""
    by = list(by)
    celled = df.withColumn("_cell", cell)
    inside = Window.partitionBy(*by, "_cell").orderBy(*order)
    across = Window.partitionBy(*by).orderBy("_cell")
    sizes = celled.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *by, "_cell", F.coalesce(F.sum("_n").over(across.rowsBetween(*BEFORE)), F.lit(0)).alias("_off")
    )
    return (
        celled.withColumn("_pos", F.row_number().over(inside) - 1)
        .join(offsets, by + ["_cell"])
        .withColumn(name, (F.col("_pos") + F.col("_off")).cast("long"))
        .drop("_cell", "_pos", "_off")
    )


def number_rows(df: DataFrame, name: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """0-based dense number in ``order`` per ``by``, for rows of any density: ranges are cut by rows.

    The rows are range-partitioned, written once with their place (a second run would cut elsewhere), and get the number of
    rows in the ranges before theirs, one row a range. ``order`` must tell rows apart, else equal ones are one range."""
    spark, by = df.sparkSession, list(by)
    place = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    path = write_stage(place, staging_dir(spark, "numbered"))
    rows = spark.read.schema(place.schema).parquet(path).withColumn("_p", F.shiftright("_at", 33))
    across = Window.orderBy("_p").rowsBetween(*BEFORE)
    before = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_off"))
    out = rows.join(F.broadcast(before), "_p").withColumn("_pos", F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_off"))
    if by:
        start = out.groupBy(*by).agg(F.min("_pos").alias("_start"))
        same = F.lit(True)
        for c in by:
            same &= F.col(f"_o.{c}").eqNullSafe(F.col(f"_s.{c}"))
        out = out.alias("_o").join(start.alias("_s"), same).select("_o.*", (F.col("_pos") - F.col("_start")).alias("_num"))
    else:
        out = out.withColumn("_num", F.col("_pos"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_num").cast("long").alias(name))


def with_halo(df: DataFrame, id_col: str, before: int, after: int, chunk: int = 8192) -> DataFrame:
    """Adds ``_chunk`` and ``_core``: each chunk holds its own ids plus ``before``/``after`` neighbours.

    Only (before + after) / chunk of the rows are repeated; callers keep ``_core`` rows at the end.
    """
    i = F.col(id_col)
    low = F.greatest(F.floor((i - after) / chunk), F.lit(0))
    high = F.floor((i + before) / chunk)
    return df.withColumn("_chunk", F.explode(F.sequence(low, high))).withColumn(
        "_core", F.col("_chunk") == F.floor(i / chunk)
    )


def halo_window(by: Sequence[str], id_col: str):
    return Window.partitionBy(*by, "_chunk").orderBy(id_col)


#: Distinct values that one range of ``value_cdf`` holds, about; and the most ranges a group is cut into.
RANGE_VALUES, MOST_RANGES = 250_000, 2_000


def _range_bounds(df: DataFrame, by: str | None, value: str, per_range: int) -> dict:
    """Approximate quantiles per group that cut it into ranges of about ``per_range`` distinct values.

    The number of ranges grows with the values (up to MOST_RANGES, then ranges grow); what reaches the driver is these
    numbers, for groups that are metric, feature or horizon names.
    """
    key = F.col(by) if by else F.lit("").alias("g")
    sizes = df.groupBy(key).agg(F.approx_count_distinct(value).alias("d")).collect()
    ranges = {r[0]: max(1, min(MOST_RANGES, -(-r["d"] // per_range))) for r in sizes}
    most = max(ranges.values(), default=1)
    if most == 1:
        return {g: [] for g in ranges}
    probs = F.array(*[F.lit(i / most) for i in range(1, most)])
    rows = df.groupBy(key).agg(F.percentile_approx(value, probs, F.lit(10 * most)).alias("b")).collect()
    return {r[0]: sorted(set(r["b"][:: -(-most // ranges[r[0]])] if ranges[r[0]] > 1 and r["b"] else [])) for r in rows}


def value_cdf(df: DataFrame, value: str, sums: dict[str, Column] | None = None, by: str | None = None,
              per_range: int = RANGE_VALUES) -> DataFrame:
    """One row per (by, distinct value): count ``n``, counts ``below`` and ``all_n``, and for each entry of
    ``sums`` its total ``s``, running total before the value ``s_below`` and overall total ``s_all``.

    The split points are fetched once as plain numbers, so a retried task sees the same ranges.
    """
    sums = sums or {}
    g = [by] if by else []
    merged = df.where(F.col(value).isNotNull()).groupBy(*g, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in sums.items()]
    )
    bounds = _range_bounds(df.where(F.col(value).isNotNull()), by, value, per_range)
    ranged = _assign_range(merged, by, value, bounds)
    inside = Window.partitionBy(*g, "_r").orderBy(value)
    across = Window.partitionBy(*g).orderBy("_r")
    whole = Window.partitionBy(*g)
    cols = ["n", *sums]
    totals = ranged.groupBy(*g, "_r").agg(*[F.sum(x).alias(f"_t_{x}") for x in cols])
    offsets = totals.select(
        *g, "_r",
        *[F.coalesce(F.sum(f"_t_{x}").over(across.rowsBetween(*BEFORE)), F.lit(0)).alias(f"_o_{x}") for x in cols],
        *[F.sum(f"_t_{x}").over(whole).alias(f"_a_{x}") for x in cols],
    )
    out = ranged
    for x in cols:
        out = out.withColumn(f"_i_{x}", F.coalesce(F.sum(x).over(inside.rowsBetween(*BEFORE)), F.lit(0)))
    out = out.join(offsets, g + ["_r"])
    return out.select(
        *g, value, "n", (F.col("_i_n") + F.col("_o_n")).alias("below"), F.col("_a_n").alias("all_n"),
        *[e for k in sums for e in (
            F.col(k), (F.col(f"_i_{k}") + F.col(f"_o_{k}")).alias(f"{k}_below"), F.col(f"_a_{k}").alias(f"{k}_all"))],
    )


def _assign_range(df: DataFrame, by: str | None, value: str, bounds: dict) -> DataFrame:
    if not any(bounds.values()):
        return df.withColumn("_r", F.lit(0))
    position = lambda cuts: F.size(F.filter(cuts, lambda b: b < F.col(value)))
    if by is None:
        return df.withColumn("_r", position(F.array(*[F.lit(float(x)) for x in bounds[""]])))
    schema = T.StructType([T.StructField(by, df.schema[by].dataType), T.StructField("_b", T.ArrayType(T.DoubleType()))])
    table = df.sparkSession.createDataFrame([(k, [float(x) for x in v]) for k, v in bounds.items()], schema)
    return df.join(F.broadcast(table), by).withColumn("_r", position(F.col("_b"))).drop("_b")


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float], by: str | None = None,
                      **kw) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per ``by``, one column per entry of ``probs``."""
    g = [by] if by else []
    cdf = value_cdf(df, value, by=by, **kw)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("all_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        holds_lo = (F.col("below") <= lo) & (lo < F.col("below") + F.col("n"))
        holds_hi = (F.col("below") <= hi) & (hi < F.col("below") + F.col("n"))
        v_lo, v_hi = F.max(F.when(holds_lo, F.col(value))), F.max(F.when(holds_hi, F.col(value)))
        part = F.max(pos - lo)
        aggs.append((v_lo + (v_hi - v_lo) * part).alias(name))
    return cdf.groupBy(*g).agg(*aggs) if g else cdf.agg(*aggs)
