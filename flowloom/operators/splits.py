"""Chronological splits, purging, tail splits, day folds and leakage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bounds(n: Column, train: float, val: float) -> tuple[Column, Column]:
    t = F.greatest(F.lit(1), F.least(F.floor(F.lit(train) * n), n - 2))
    v = F.greatest(t + 1, F.least(F.floor(F.lit(train + val) * n), n - 1))
    return t, v


def chronological(windows: DataFrame, by: Sequence[str] = (), train: float = 0.70, val: float = 0.15) -> DataFrame:
    """partition of each window by its dense id; the window count is one tiny aggregate joined back."""
    by = list(by)
    n = windows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    joined = windows.join(n, by) if by else windows.crossJoin(F.broadcast(n))
    t, v = _bounds(F.col("_n"), train, val)
    wid = F.col("window_id")
    return joined.withColumn(
        "partition", F.when(wid < t, "train").when(wid < v, "validation").otherwise("test")
    ).drop("_n")


def partition_sequences(sequences: DataFrame, windows: DataFrame, by: Sequence[str] = (),
                        train: float = 0.70, val: float = 0.15) -> DataFrame:
    """partition of each sequence, NULL (purged) where its windows touch more than one.

    A sequence covers contiguous ids, so comparing its two ends with the two borders is enough.
    """
    by = list(by)
    n = windows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    joined = sequences.join(n, by) if by else sequences.crossJoin(F.broadcast(n))
    t, v = _bounds(F.col("_n"), train, val)
    lo, hi = F.col("input_start_window"), F.col("target_window")
    return joined.withColumn(
        "partition",
        F.when(hi < t, "train").when((lo >= t) & (hi < v), "validation").when(lo >= v, "test"),
    ).drop("_n")


def tail_split(sequences: DataFrame, by: str, fraction: float = 0.1) -> DataFrame:
    """The last max(1, round-half-even(n * fraction)) sequences of each day are validation; none if n <= 1.

    ``sequence_id`` is dense in start-window order per day, so no sort is needed.
    """
    n = sequences.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    tail = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.bround(F.col("_n") * fraction, 0).cast("long"))).otherwise(0)
    return sequences.join(n, by).withColumn(
        "split", F.when(F.col("sequence_id") >= F.col("_n") - tail, "validation").otherwise("train")
    ).drop("_n")


def holdout_folds(df: DataFrame, day: str, folds: dict[str, tuple[list[str], str]]) -> DataFrame:
    """Every row once per fold with its role; rows of days outside a fold are not in it.

    The fold list is a handful of literals, so this is one pass and an explode, not one scan per fold.
    """
    roles = [
        F.when(F.col(day).isin(train), F.struct(F.lit(name).alias("fold"), F.lit("train").alias("role")))
        .when(F.col(day) == hold, F.struct(F.lit(name).alias("fold"), F.lit("holdout").alias("role")))
        for name, (train, hold) in folds.items()
    ]
    picked = df.withColumn("_f", F.explode(F.filter(F.array(*roles), lambda x: x.isNotNull())))
    return picked.select(*df.columns, "_f.fold", "_f.role")


def leave_one_out(days: Sequence[str]) -> dict[str, tuple[list[str], str]]:
    return {f"hold_{d}": ([x for x in days if x != d], d) for d in days}


def leakage_checks(windows: DataFrame, sequences: DataFrame, feature_names: Sequence[str]) -> DataFrame:
    """One row per check: name, offending rows, passed."""
    per = windows.groupBy("partition").agg(F.min("window_start").alias("lo"), F.max("window_start").alias("hi"))
    ends = per.agg(*[
        F.max(F.when(F.col("partition") == p, F.col(x))).alias(f"{p}_{x}")
        for p in ["train", "validation", "test"] for x in ["lo", "hi"]
    ])
    order = ends.select(
        F.when(F.col("train_hi") < F.col("validation_lo"), 0).otherwise(1).alias("train_before_validation"),
        F.when(F.col("validation_hi") < F.col("test_lo"), 0).otherwise(1).alias("validation_before_test"),
    )
    ids = windows.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("partition").alias("p"))
    idc = ids.agg(
        F.count_if(F.col("n") > 1).alias("window_id_unique"),
        F.count_if(F.col("p") > 1).alias("window_in_one_partition"),
    )
    sid = sequences.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("sequence_id_unique"))
    chrono = sequences.agg(
        F.count_if(F.col("target_timestamp") <= F.col("input_end_timestamp")).alias("target_after_input"),
        F.count_if(F.col("input_end_timestamp") <= F.col("input_start_timestamp")).alias("input_in_order"),
        F.count_if(F.col("target_window") - F.col("input_start_window") != 10).alias("span_is_eleven_windows"),
    )
    bad_names = sum(1 for x in feature_names if x.lower() in ("label", "timestamp"))
    one = order.crossJoin(idc).crossJoin(sid).crossJoin(chrono).withColumn("no_label_or_time_feature", F.lit(bad_names))
    cols = one.columns
    return one.select(*[F.col(x).cast("long").alias(x) for x in cols]).unpivot([], cols, "check_name", "offending").withColumn(
        "passed", F.col("offending") == 0)


def shared_rows(df: DataFrame, side: str, columns: Sequence[str], by: Sequence[str] = (), training: str = "train") -> DataFrame:
    """(by…, side, offending): rows of each other side whose ``columns`` equal those of some training row.

    Rows meet by a 128-bit digest of their content, NULLs and NaN included; copies are counted where they are, so content
    that a third of the rows share is one row a task."""
    by = list(by)
    content = F.md5(F.to_json(F.struct(*[F.col(f"`{x}`") for x in columns]), {"ignoreNullFields": "false"}))
    n = df.select(*by, F.col(side).alias("_side"), content.alias("_row")).groupBy(*by, "_row", "_side").agg(F.count(F.lit(1)).alias("_n"))
    known = n.where(F.col("_side") == training).select(*by, "_row", F.lit(True).alias("_known"))
    other = n.where(F.col("_side").isNotNull() & (F.col("_side") != training)).join(known, [*by, "_row"], "left")
    return other.groupBy(*by, F.col("_side").alias(side)).agg(F.coalesce(F.sum(F.when(F.col("_known"), F.col("_n"))), F.lit(0)).alias("offending"))


def unusable_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(infinite, missing): cells that are infinite, and NULL or NaN, over all ``columns``; none may be left after scaling."""
    cells = F.array(*[F.col(f"`{x}`").cast("double") for x in columns])
    infinite = F.size(F.filter(cells, lambda v: F.abs(v) == float("inf")))
    missing = F.size(F.filter(cells, lambda v: v.isNull() | F.isnan(v)))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return df.agg(total(infinite).alias("infinite"), total(missing).alias("missing"))
