"""Leave-one-day-out forecasters from one pass against fits from the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import metrics as mx
from flowloom.operators import models as md


@pytest.mark.parametrize("parts", [1, 70])
def test_gram_matrices(spark, parts):
    r = np.random.default_rng(0)
    rows = [("a" if i % 3 else "b", r.normal(size=70).tolist(), r.normal(size=2).tolist()) for i in range(140)]
    got = md.gram_matrices(spark.createDataFrame(rows, "g string, x array<double>, y array<double>").repartition(parts), "x", "y", "g")
    for g in ("a", "b"):
        z = np.array([[*x, 1.0, *y] for n, x, y in rows if n == g])
        assert got[g].shape == (73, 73) and np.allclose(got[g], z.T @ z)


def test_folds_of_all_days(spark):
    r = np.random.default_rng(1)
    true = r.normal(size=(6, 2))
    rows = []
    for day in range(4):
        for i in range(60):
            x = r.normal(size=6) * [1, 10, 0.1, 1, 1, 5] + day
            rows.append((f"2024-01-0{day + 1}", "validation" if i >= 50 else "train", x.tolist(), (x @ true + r.normal(size=2) * 0.3).tolist()))
    df = spark.createDataFrame(rows, "day string, split string, x array<double>, y array<double>").repartition(6)
    folds = md.fold_forecasters(df, "x", "y", "day", "split")
    assert [f["hold"] for f in folds] == [f"2024-01-0{d}" for d in (1, 2, 3, 4)]
    pick = lambda want: [np.array(v) for v in zip(*[(x, y) for d, s, x, y in rows if want(d, s)])]
    for f in folds:
        x, y = pick(lambda d, s: d != f["hold"] and s == "train")
        vx, vy = pick(lambda d, s: d != f["hold"] and s == "validation")
        hx, hy = pick(lambda d, s: d == f["hold"])
        mean, dev = x.mean(0), x.std(0)
        best = None
        for lam in md.PENALTIES:  # standardise, fit without penalising the bias, predict
            z = (x - mean) / dev
            b = np.linalg.solve(z.T @ z + lam * np.eye(6), z.T @ (y - y.mean(0)))
            err = lambda p, q: float((((p - mean) / dev @ b + y.mean(0) - q) ** 2).mean())  # noqa: E731, B023
            best = min(best or (np.inf,), (err(vx, vy), lam, err(hx, hy)))
        assert f["penalty"] == best[1] and f["train_rows"] == 150 and f["holdout_rows"] == 60
        assert f["validation_mse"] == pytest.approx(best[0], rel=1e-6) and f["holdout_mse"] == pytest.approx(best[2], rel=1e-6)
        assert f["persistence_mse"] == pytest.approx(float(((hx[:, -2:] - hy) ** 2).mean()))


@pytest.mark.parametrize("only", [0, 1, None])
def test_forest_facts_of_one_class(spark, only):
    """Training rows that are all of one class have no ranking; the facts of the forest hold all the same."""
    rows = [(i, [float(i), float(i % 3)], i % 2 if only is None else only) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    scored = md.score(df, md.train_forest(df, "x", "y", trees=5, depth=6), "x").cache()
    assert mx.beats_coin(scored)
    assert only is None or {r["p"] for r in scored.collect()} == {float(only)}
    assert not mx.beats_coin(scored.withColumn("p", F.lit(0.5)))
    scored.unpersist()
