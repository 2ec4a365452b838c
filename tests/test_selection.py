"""Exact percentiles by refinement against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions import selection as sel

PROBS = {"least": 0.0, "p10": 0.1, "half": 0.5, "p95": 0.95, "most": 1.0}


def test_bits_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-320, -0.0, 0.0, 1e-320, 1.0, 1.0000000000000002, 7e9, np.inf])
    b = sel.ordered_bits(x)
    assert (b[1:] >= b[:-1]).all() and b[4] == b[5] and len(set(b.tolist())) == len(x) - 1


@pytest.mark.parametrize("seed, digit", [(0, 16), (1, 16), (1, 4)])
def test_quantiles(spark, seed, digit, monkeypatch):
    monkeypatch.setattr(sel, "DIGIT", digit)
    r = np.random.default_rng(seed)
    n = 3000 + seed
    close = 1.0 + r.integers(0, 1000, n) * 2.0**-52  # differ in the last bits only: all passes are needed
    made = {"normal": r.normal(size=n) * 10.0 ** r.integers(-200, 200, n), "whole": r.integers(-3, 3, n).astype(float), "close": close, "same": np.full(n, -0.0),
            "wide": np.where(r.random(n) < 0.01, np.inf, -r.random(n)), "few": np.where(r.random(n) < 0.999, np.nan, 5.0)}
    rows = [tuple(None if v != v and i % 2 else float(v) for v in t) for i, t in enumerate(zip(*made.values()))]
    df = spark.createDataFrame([*rows, (None,) * 6], ", ".join(f"`{k}` double" for k in made)).withColumn("none", F.lit(None).cast("double")).repartition(5)
    got = sel.quantiles(df, [*made, "none"], PROBS)
    assert set(got) == set(made)
    for k, v in made.items():
        v = np.sort(v[v == v])
        for name, p in PROBS.items():
            at = (len(v) - 1) * p
            lo, hi = v[int(np.floor(at))], v[int(np.ceil(at))]
            assert got[k][name] == (lo if lo == hi else lo + (hi - lo) * (at - np.floor(at))), (k, name)


def test_what_is_shuffled_does_not_grow_with_distinct_values(spark):
    """All values differ, yet the counts of a pass are the bins of its digit."""
    df = spark.range(0, 200_000, 1, 4).select((F.col("id") * 1.0000001).alias("x"))
    assert sel._count(df, [("x", 0, 0, sel.DIGIT)]).count() < 400
