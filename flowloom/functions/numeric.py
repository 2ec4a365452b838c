"""Null-safe scalar expressions. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def c(name: str) -> Column:
    """Column by exact name, safe for names with blanks and slashes."""
    return F.col(f"`{name}`")


def is_inf(x: Column) -> Column:
    return F.coalesce((x == F.lit(INF)) | (x == F.lit(-INF)), F.lit(False))


def finite(x: Column) -> Column:
    """NaN and both infinities become NULL, as every aggregate downstream expects.

    NaN sorts above every number in Spark, so one comparison covers all three.
    """
    d = x.cast("double")
    return F.when(F.abs(d) < F.lit(INF), d)


def ratio(a: Column, b: Column, default: Column | float | None = None) -> Column:
    """a / b, or ``default`` when b is 0 or NULL or a is NULL."""
    other = default if isinstance(default, Column) else F.lit(default).cast("double")
    return F.when(a.isNotNull() & b.isNotNull() & (b != 0), a.cast("double") / b.cast("double")).otherwise(other)


def rate(count: Column, seconds: Column, at_zero: Column) -> Column:
    return F.when(seconds > 0, count.cast("double") / seconds).otherwise(at_zero)


def int_ratio(a: Column, b: Column) -> Column:
    """Truncating a / b for non-negative counts, 0 where b is 0."""
    return F.when(b > 0, F.floor(a.cast("double") / b.cast("double"))).otherwise(F.lit(0)).cast("long")


def variation(std: Column, mean: Column) -> Column:
    return F.when(mean > 0, std / mean)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def evidence_band(score: Column) -> Column:
    return (
        F.when(score < 30, "LOW").when(score < 60, "MEDIUM").when(score < 80, "HIGH").when(score >= 80, "VERY HIGH")
    )


def true_only(predicate: Column) -> Column:
    """A predicate over missing evidence is false, never NULL."""
    return F.coalesce(predicate, F.lit(False))


def minmax_scaled(value: Column, low: Column, high: Column) -> Column:
    spread = high - low
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - low, spread)))
    return F.when(spread == 0, F.when(value > 0, 1.0).otherwise(0.0)).otherwise(scaled)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, independent of the session zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def from_micros(us: Column) -> Column:
    """Zone-less timestamp of microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
