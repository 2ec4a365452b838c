"""Flow rows to fixed event-time windows, window ids and gap-separated segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import c, epoch_seconds
from ..functions.ordering import BEFORE, UPTO
from ..schema import ATTACK, BENIGN, MEAN_FEATURES, STATE, SUM_FEATURES


def aggregation_policy(columns: Sequence[str] = STATE) -> dict[str, str]:
    """sum or mean for every state column; an unknown column is an error, never a guess."""
    policy = {x: "sum" for x in SUM_FEATURES} | {x: "mean" for x in MEAN_FEATURES}
    unknown = [x for x in columns if x not in policy]
    if unknown:
        raise ValueError(f"no aggregation policy for {unknown}")
    return {x: policy[x] for x in columns}


def floor_to_window(ts: Column, width: str) -> Column:
    return F.window(ts, width).getField("start")


def window_features(flows: DataFrame, width: str, by: Sequence[str] = (), columns: Sequence[str] = STATE,
                    ts: str = "timestamp") -> DataFrame:
    """One row per window: NULL-safe sums and means. Grouping keys are time, so no value can be hot
    beyond one window, and every aggregate combines map-side before the shuffle."""
    aggs = [(F.sum if how == "sum" else F.avg)(c(x).cast("double")).alias(x)
            for x, how in aggregation_policy(columns).items()]
    return (
        flows.groupBy(*by, F.window(ts, width).alias("_w"))
        .agg(*label_aggregates(), *aggs)
        .withColumn("window_start", F.col("_w.start"))
        .withColumn("window_end", F.col("_w.end"))
        .drop("_w")
    )


def label_aggregates(label: str = "label") -> list[Column]:
    lab = F.col(label)
    attacks = F.count_if(lab != BENIGN)
    return [
        F.count(F.lit(1)).alias("observation_count"),
        F.count_if(lab == BENIGN).alias("benign_count"),
        F.count_if(lab == ATTACK).alias("infiltration_count"),
        attacks.alias("attack_count"),
        (attacks / F.count(F.lit(1))).alias("attack_ratio"),
    ]


def dominant_labels(flows: DataFrame, width: str, by: Sequence[str] = (), ts: str = "timestamp", label: str = "label") -> DataFrame:
    """Most frequent non-benign label per window, ties to the smallest, benign where there is none.

    Kept apart from the feature aggregates: counting per (window, label) stays in a hash aggregate, while a
    mode() next to 70 sums would push all of them out of generated code.
    """
    start = floor_to_window(F.col(ts), width).alias("window_start")
    n = flows.groupBy(*by, start, F.col(label)).agg(F.count(F.lit(1)).alias("_n"))
    other = F.when(F.col(label) != BENIGN, F.struct((-F.col("_n")).alias("_k"), F.col(label).alias("_l")))
    return n.groupBy(*by, "window_start").agg(F.min(other).alias("_m")).select(
        *by, "window_start", F.coalesce("_m._l", F.lit(BENIGN)).alias("dominant_label"))


def with_targets(windows: DataFrame) -> DataFrame:
    """Two-class target and label of the training day plus the any-attack target of other days."""
    hit = F.col("infiltration_count") > 0
    return (
        windows.withColumn("infiltration_ratio", F.col("infiltration_count") / F.col("observation_count"))
        .withColumn("target", hit.cast("int"))
        .withColumn("label", F.when(hit, ATTACK).otherwise(BENIGN))
        .withColumn("binary_target", (F.col("attack_count") > 0).cast("int"))
    )


def index_windows(windows: DataFrame, step_seconds: int, by: Sequence[str] = (), rows_per_cell: int = 4096) -> DataFrame:
    """window_id (dense, time order) and segment_id (new one after any gap longer than one step).

    Windows are unique per start, so a cell of ``rows_per_cell`` steps bounds every task. Only one row per
    cell goes through the final running sum.
    """
    by = list(by)
    sec = epoch_seconds(F.col("window_start"))
    celled = windows.withColumn("_cell", F.floor(sec / (step_seconds * rows_per_cell)))
    inside = Window.partitionBy(*by, "_cell").orderBy("window_start")
    gap = sec - epoch_seconds(F.lag("window_start").over(inside)) > step_seconds
    local = (
        celled.withColumn("_pos", F.row_number().over(inside) - 1)
        .withColumn("_cut", F.coalesce(gap.cast("int"), F.lit(0)))
        .withColumn("_seg", F.sum("_cut").over(inside.rowsBetween(*UPTO)))
    )
    cells = local.groupBy(*by, "_cell").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_cut").alias("_cuts"),
        F.min("window_start").alias("_lo"), F.max("window_start").alias("_hi"),
    )
    across = Window.partitionBy(*by).orderBy("_cell")
    border = epoch_seconds(F.col("_lo")) - epoch_seconds(F.lag("_hi").over(across)) > step_seconds
    offsets = (
        cells.withColumn("_first", F.coalesce(border.cast("int"), F.lit(0)))
        .withColumn("_id0", F.coalesce(F.sum("_n").over(across.rowsBetween(*BEFORE)), F.lit(0)))
        .withColumn("_seg0", F.sum("_first").over(across.rowsBetween(*UPTO))
                    + F.coalesce(F.sum("_cuts").over(across.rowsBetween(*BEFORE)), F.lit(0)))
        .select(*by, "_cell", "_id0", "_seg0")
    )
    return (
        local.join(offsets, by + ["_cell"])
        .withColumn("window_id", (F.col("_pos") + F.col("_id0")).cast("long"))
        .withColumn("segment_id", (F.col("_seg") + F.col("_seg0")).cast("long"))
        .drop("_cell", "_pos", "_cut", "_seg", "_id0", "_seg0")
    )


def gap_summary(indexed: DataFrame, step_seconds: int, by: Sequence[str] = ()) -> DataFrame:
    """Windows, segments, gaps and the largest gap in seconds.

    Segment borders are enough: one row per segment is compared with the one before it.
    """
    by = list(by)
    seg = indexed.groupBy(*by, "segment_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("window_start").alias("_lo"), F.max("window_start").alias("_hi")
    )
    # The segment ids are dense, so the previous segment is an equi-join away (no single-task sort).
    previous = seg.select(*by, (F.col("segment_id") + 1).alias("segment_id"), F.col("_hi").alias("_prev"))
    jump = epoch_seconds(F.col("_lo")) - epoch_seconds(F.col("_prev"))
    return seg.join(previous, by + ["segment_id"], "left").groupBy(*by).agg(
        F.sum("_n").alias("windows"),
        F.count(F.lit(1)).alias("segments"),
        F.count("_prev").alias("gaps"),
        F.greatest(F.max(jump), F.max(F.when(F.col("_n") > 1, F.lit(step_seconds)))).cast("long").alias("largest_gap_s"),
    )


def distinct_ports(flows: DataFrame, width: str, port: str = "dst_port", ts: str = "timestamp",
                   by: Sequence[str] = ()) -> DataFrame:
    """Two-step distinct count (de-duplicate, then count), so a busy window is not one set in memory."""
    start = floor_to_window(F.col(ts), width).alias("window_start")
    pairs = flows.where(c(port).isNotNull()).groupBy(*by, start, c(port)).agg(F.lit(1).alias("_one"))
    return pairs.groupBy(*by, "window_start").agg(F.count(F.lit(1)).alias("dst_port_nunique"))
