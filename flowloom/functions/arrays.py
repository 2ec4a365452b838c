"""Vector helpers over ARRAY<DOUBLE> columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def average(a: Column) -> Column:
    return total(a) / F.size(a)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def abs_error(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def squared_error(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y) * (x - y))


def argmax(a: Column) -> Column:
    """0-based position of the first largest element."""
    return F.array_position(a, F.array_max(a)) - 1



def flatten_names(names: Sequence[str], steps: int = 10) -> list[str]:
    """Names t-9__f … t__f of a flattened history."""
    stamps = [f"t-{i}" if i else "t" for i in range(steps - 1, -1, -1)]
    return [f"{s}__{n}" for s in stamps for n in names]
