"""Exact percentiles of many columns at once, by refinement over the bits of their values.

A double's bits, with the sign turned, are ordered like the numbers. A pass counts, for every column, the values by the
next DIGIT bits below the prefix that holds a wanted rank; counts are added up map-side, so what is shuffled is at most
2 ** DIGIT counts a column and task, whatever the number of rows or distinct values. A rank whose bin holds one value is
found; the others go on inside their bin, by all remaining bits once that holds no more than 2 ** DIGIT values, so two
passes are the rule and four the most. What reaches the driver is one row a wanted rank.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGIT = 16
_COUNTS = "target int, bin long, n long, lo double, hi double"
_COUNTS_ARROW = pa.schema([("target", pa.int32()), ("bin", pa.int64()), ("n", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64())])
_FOUND = "target int, want int, upper boolean, bin long, rest long, lo double, hi double, held long, total long"


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order; minus zero is zero."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _count(cells: DataFrame, targets: list[tuple[str, int, int, int]]) -> DataFrame:
    """Counts, least and greatest value of each bin of each target: column, prefix, its bits, and bits of the bins."""
    by_column: dict[str, list[tuple]] = {}
    for t, (column, *where) in enumerate(targets):
        by_column.setdefault(column, []).append((t, *where))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column, wanted in by_column.items():
                x = batch.column(column).to_numpy(zero_copy_only=False)
                x = x[x == x]  # neither null nor NaN
                bits = ordered_bits(x)
                for t, prefix, used, width in wanted:
                    mine = bits >> np.uint64(64 - used) == np.uint64(prefix) if used else slice(None)
                    v, bins = x[mine], (bits[mine] >> np.uint64(64 - used - width)) & np.uint64((1 << width) - 1)
                    if not len(v):
                        continue
                    order = np.argsort(bins, kind="stable")
                    v, bins = v[order], bins[order]
                    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(first), t, np.int32)), pa.array(bins[first].astype(np.int64)), pa.array(np.diff(np.append(first, len(v)))),
                        pa.array(np.minimum.reduceat(v, first)), pa.array(np.maximum.reduceat(v, first))], schema=_COUNTS_ARROW)

    counts = cells.mapInArrow(run, _COUNTS)
    return counts.groupBy("target", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _find(counts: DataFrame, wants: dict[int, list[tuple[int, bool, int]]] | list[float]) -> list:
    """The bin of each wanted rank: of each probability's two ranks, or of ranks inside a prefix."""

    def pick(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        end = bins["n"].cumsum().to_numpy()
        target, total = int(bins["target"].iloc[0]), int(end[-1])
        if isinstance(wants, list):
            mine = [(i, up, int(np.ceil((total - 1) * p) if up else np.floor((total - 1) * p))) for i, p in enumerate(wants) for up in (False, True)]
        else:
            mine = wants[target]
        out = []
        for want, up, rank in mine:
            k = int(np.searchsorted(end, rank, "right"))
            out.append((target, want, up, int(bins["bin"].iloc[k]), rank - int(end[k] - bins["n"].iloc[k]), bins["lo"].iloc[k], bins["hi"].iloc[k], int(bins["n"].iloc[k]), total))
        return pd.DataFrame(out, columns=[f.split()[0] for f in _FOUND.split(", ")])

    return counts.groupBy("target").applyInPandas(pick, _FOUND).collect()  # a target has 2 ** DIGIT bins at most


def quantiles(df: DataFrame, columns: Sequence[str], probs: dict[str, float]) -> dict[str, dict[str, float]]:
    """Percentiles with linear interpolation of each column's non-missing values; a column without any is left out."""
    cells = df.select(*[F.col(f"`{x}`").cast("double").alias(x) for x in columns])
    p = list(probs.values())
    targets: list[tuple[str, int, int, int]] = [(x, 0, 0, DIGIT) for x in columns]
    wants: dict | list = p
    values: dict[tuple[str, int, bool], float] = {}
    totals: dict[str, int] = {}
    while targets:
        later: dict[tuple[str, int, int, int], list] = {}
        for r in _find(_count(cells, targets), wants):
            column, prefix, used, width = targets[r.target]
            totals.setdefault(column, r.total)
            if r.lo == r.hi:
                values[column, r.want, r.upper] = r.lo + 0.0
            else:
                used += width
                inside = (column, prefix << width | r.bin, used, 64 - used if r.held <= 1 << DIGIT else DIGIT)
                later.setdefault(inside, []).append((r.want, r.upper, r.rest))
        targets, wants = list(later), dict(enumerate(later.values()))
    out: dict[str, dict[str, float]] = {}
    for column, n in totals.items():
        out[column] = {}
        for i, name in enumerate(probs):
            at = (n - 1) * p[i]
            lo, hi = values[column, i, False], values[column, i, True]
            out[column][name] = lo if lo == hi else lo + (hi - lo) * (at - np.floor(at))
    return out
