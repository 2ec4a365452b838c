"""Gap-safe fixed-length sequences and horizon targets over indexed windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import c, ratio
from ..functions.ordering import dense_number, halo_window, with_halo
from ..schema import HISTORY, STATE


def with_state(windows: DataFrame, columns: Sequence[str] = STATE) -> DataFrame:
    return windows.withColumn("state", F.array(*[c(x).cast("double") for x in columns]))


def sliding_sequences(windows: DataFrame, by: Sequence[str] = (), steps: int = HISTORY, labeled: bool = True,
                      chunk: int = 8192, states: bool = True) -> DataFrame:
    """Every run of ``steps`` + 1 windows inside one segment: ``steps`` inputs and the next window.

    ``windows`` carries window_id, segment_id, window_start, state and, if labeled, target and label.
    Partitioned by chunks of the dense id with a halo, so one endless segment is still many tasks.
    """
    by = list(by)
    keep = [*by, "window_id", "segment_id", "window_start"] + (["state"] if states else [])
    keep += ["target", "label"] if labeled else []
    haloed = with_halo(windows.select(*keep), "window_id", before=steps - 1, after=1, chunk=chunk)
    w = halo_window(by, "window_id")
    first = lambda x: F.lag(x, steps - 1).over(w)
    nxt = lambda x: F.lead(x, 1).over(w)
    cols = [
        first("segment_id").alias("_s0"), nxt("segment_id").alias("_s1"),
        first("window_id").alias("input_start_window"),
        F.col("window_id").alias("input_end_window"),
        nxt("window_id").alias("target_window"),
        first("window_start").alias("input_start_timestamp"),
        F.col("window_start").alias("input_end_timestamp"),
        nxt("window_start").alias("target_timestamp"),
        (nxt("target") if labeled else F.lit(None).cast("int")).alias("target_window_target"),
        (nxt("label") if labeled else F.lit(None).cast("string")).alias("target_window_label"),
    ]
    if states:
        cols += [F.collect_list("state").over(w.rowsBetween(-(steps - 1), 0)).alias("history"),
                 nxt("state").alias("next_state")]
    slides = (
        haloed.select(*by, "_core", "segment_id", *cols)
        .where(F.col("_core") & (F.col("_s0") == F.col("segment_id")) & (F.col("_s1") == F.col("segment_id")))
        .drop("_s0", "_s1", "_core")
    )
    return dense_number(slides, "sequence_id", ["input_start_window"], F.floor(F.col("input_start_window") / chunk), by)


def horizon_targets(windows: DataFrame, horizons: Sequence[int], by: Sequence[str] = (), chunk: int = 8192) -> DataFrame:
    """For each window id and horizon: the target window if it lies in the same segment, else NULL.

    ``windows`` may carry ``partition``; then the target must also be in the same partition.
    """
    by = list(by)
    split = "partition" in windows.columns
    keep = [*by, "window_id", "segment_id", "window_start", "label", "target"] + (["partition"] if split else [])
    haloed = with_halo(windows.select(*keep), "window_id", before=0, after=max(horizons), chunk=chunk)
    w = halo_window(by, "window_id")
    parts = []
    for h in horizons:
        ok = F.lead("segment_id", h).over(w) == F.col("segment_id")
        if split:
            ok = ok & (F.lead("partition", h).over(w) == F.col("partition"))
        pick = lambda x: F.when(ok, F.lead(x, h).over(w))  # noqa: E731, B023
        parts.append(F.struct(F.lit(h).alias("horizon"), pick("window_id").alias("target_window"),
                              pick("window_start").alias("future_timestamp"), pick("label").alias("future_label"),
                              pick("target").alias("future_target")))
    wide = haloed.withColumn("_h", F.array(*parts)).where("_core")
    out = wide.select(*by, F.col("window_id").alias("input_end_window"), "segment_id",
                      *(["partition"] if split else []), F.explode("_h").alias("_x"))
    return out.select(*[x for x in out.columns if x != "_x"], "_x.*")


def growth_baseline(windows: DataFrame, value: str, by: Sequence[str] = (), back: int = 5, chunk: int = 8192) -> DataFrame:
    """window_id with the mean of up to ``back`` previous values in the segment and the change against it."""
    by = list(by)
    haloed = with_halo(
        windows.select(*by, "window_id", "segment_id", c(value).cast("double").alias("_v")),
        "window_id", before=back, after=0, chunk=chunk,
    )
    w = halo_window(by, "window_id")
    # Ids are dense, so the segment of a neighbour tells whether it may count.
    terms = [F.when(F.lag("segment_id", i).over(w) == F.col("segment_id"), F.lag("_v", i).over(w)) for i in range(back, 0, -1)]
    known = [F.when(t.isNotNull(), 1).otherwise(0) for t in terms]
    count, tot = sum(known[1:], known[0]), sum([F.coalesce(t, F.lit(0.0)) for t in terms[1:]], F.coalesce(terms[0], F.lit(0.0)))
    out = haloed.withColumn("growth_baseline", ratio(tot, count)).where("_core")
    base = F.col("growth_baseline")
    return out.select(*by, "window_id",
                      "growth_baseline", F.when(base > 0, (F.col("_v") - base) / base * 100.0).alias("traffic_growth_pct"))


def flattened(sequences: DataFrame) -> DataFrame:
    return sequences.withColumn("flat", F.flatten("history"))
