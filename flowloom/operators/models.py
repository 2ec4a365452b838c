"""Classifiers, the multi-output forecaster, recursive rollout and occlusion.

Model state that reaches the driver has a fixed size set by the 68 state columns (a 681 x 749 matrix at
most); rows never do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..sources.tables import staging_dir, write_stage
from ..functions.numeric import sigmoid
from .attribution import direction
from .scaling import class_weights


def train_logistic(train: DataFrame, features: str, label: str, max_iter: int = 2000) -> LogisticRegressionModel:
    """Balanced L2 logistic regression. Balanced weights add up to the row count n, so a unit inverse penalty
    is regParam = 1 / n in this objective."""
    n = train.count()
    data = class_weights(train.select(label, features), label).select(
        F.col(label).cast("double").alias("label"), array_to_vector(features).alias("features"), "weight")
    return LogisticRegression(weightCol="weight", standardization=False, elasticNetParam=0.0, regParam=1.0 / n, maxIter=max_iter).fit(data)


def train_forest(train: DataFrame, features: str, label: str, trees: int = 300, depth: int = 30, seed: int = 42) -> RandomForestClassificationModel:
    data = class_weights(train.select(label, features), label).select(
        F.col(label).cast("double").alias("label"), array_to_vector(features).alias("features"), "weight")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="weight", seed=seed, maxMemoryInMB=1024).fit(data)


def score(df: DataFrame, model, features: str, name: str = "p") -> DataFrame:
    """Adds the attack probability; classes follow from p >= 0.5, not from the model's own > 0.5. A forest fitted to benign
    rows alone knows no second class: its probability is 0."""
    scored = model.transform(df.withColumn("features", array_to_vector(features)))
    keep = [x for x in df.columns]
    return scored.select(*keep, F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)).alias(name))


def linear_probability(state: Column, coef: Sequence[float], intercept: float) -> Column:
    return sigmoid(ar.dot(state, ar.literal_vector(coef)) + F.lit(float(intercept)))


def coef_table(spark, names: Sequence[str], values: Sequence[float], name: str = "coefficient") -> DataFrame:
    rows = [(n, float(v), abs(float(v))) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, f"name string, {name} double, abs_value double").orderBy(F.desc("abs_value"), "name")


def importances(model: RandomForestClassificationModel, spark, names: Sequence[str]) -> DataFrame:
    """(name, importance) of a forest, largest first; columns that no tree uses have zero."""
    return coef_table(spark, names, model.featureImportances.toArray(), "importance").drop("abs_value")


@dataclass(frozen=True)
class Forecaster:
    """next state = flattened history @ weights + bias."""

    weights: np.ndarray
    bias: np.ndarray
    penalty: float
    validation_mse: float


def save_forecaster(spark, model: Forecaster, path: str) -> str:
    """One row per input column, the bias last, with the penalty and its validation error."""
    rows = [(i, [float(v) for v in w], model.penalty, model.validation_mse) for i, w in enumerate(np.vstack([model.weights, model.bias]))]
    return write_stage(spark.createDataFrame(rows, "input int, weights array<double>, penalty double, validation_mse double"), path)


def load_forecaster(spark, path: str) -> Forecaster:
    rows = spark.read.parquet(path).orderBy("input").collect()
    w = np.array([r["weights"] for r in rows])
    return Forecaster(w[:-1], w[-1], rows[0]["penalty"], rows[0]["validation_mse"])


#: Matrices that one group adds up.
FAN_IN = 32
#: Rows of a matrix that travel and are added together.
BLOCK = 64


def gram_matrices(df: DataFrame, x: str, y: str, group: str) -> dict[str, np.ndarray]:
    """[x 1 y]' [x 1 y] per group, in one pass over the rows: each task adds up its own matrices, and a tree of groups of
    FAN_IN adds these, by blocks of rows. What is shuffled is one matrix a task and group, whatever the number of rows;
    what reaches the driver is one matrix a group (4.5 MB for 68 columns and ten steps)."""
    import pyarrow as pa
    from pyspark import TaskContext

    out_schema = pa.schema([("g", pa.string()), ("part", pa.int64()), ("block", pa.int32()), ("v", pa.binary())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            xs = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            ys = b.column("y").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            z = np.hstack([xs, np.ones((n, 1)), ys])
            names = np.asarray(b.column("g").to_pylist())
            for g in set(names.tolist()):
                part = z[names == g]
                m = part.T @ part
                sums[g] = sums[g] + m if g in sums else m
        task = TaskContext.get().partitionId()
        for g, m in sums.items():
            blocks = [m[i:i + BLOCK].tobytes() for i in range(0, len(m), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(blocks)), pa.array([task] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks)], schema=out_schema)

    def add(key, table):
        total = None
        for v in table.column("v").to_pylist():
            one = np.frombuffer(v)
            total = one.copy() if total is None else total + one
        return pa.table({"g": [key[0].as_py()], "part": [key[1].as_py()], "block": [key[2].as_py()], "v": [total.tobytes()]}, schema=out_schema)

    spark = df.sparkSession
    schema = "g string, part long, block int, v binary"
    parts = df.select(F.col(group).cast("string").alias("g"), F.col(x).alias("x"), F.col(y).alias("y")).mapInArrow(partial, schema)
    parts = spark.read.schema(schema).parquet(write_stage(parts, staging_dir(spark, "gram")))
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        left = -(-left // FAN_IN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("g", "part", "block").applyInArrow(add, schema)
    found: dict[str, dict[int, bytes]] = {}
    for r in parts.collect():
        found.setdefault(r["g"], {})[r["block"]] = r["v"]
    flat = {g: np.frombuffer(b"".join(rows[i] for i in range(len(rows)))) for g, rows in found.items()}
    return {g: v.reshape(int(len(v) ** 0.5), -1) for g, v in flat.items()}


def _mse(g: np.ndarray, k: int, w: np.ndarray) -> float:
    n, m = g[k - 1, k - 1], g.shape[0] - k
    xx, xy, yy = g[:k, :k], g[:k, k:], np.trace(g[k:, k:])
    return float((yy - 2 * np.sum(w * xy) + np.einsum("ij,ij->", w, np.einsum("ij,jk->ik", xx, w, optimize=False))) / (n * m))


PENALTIES = (0.1, 1.0, 10.0, 100.0, 1000.0)


def ridge(g: np.ndarray, k: int, penalty: float, scale: np.ndarray | None = None) -> np.ndarray:
    """Weights and bias (last row) from [x 1 y]' [x 1 y]; the bias is not penalised. ``scale``: deviations of x, as if
    each column were standardised first."""
    reg = np.eye(k) * 1e-9
    reg[np.arange(k - 1), np.arange(k - 1)] += penalty * (1.0 if scale is None else scale**2)
    return np.linalg.solve(g[:k, :k] + reg, g[:k, k:])


def _best_ridge(spark, train: np.ndarray, check: np.ndarray, k: int, penalties: Sequence[float], scale: np.ndarray | None = None) -> tuple[float, float, np.ndarray]:
    """(penalty, error on the checked rows, weights with bias) of the best penalty. One small task a penalty solves one
    fixed-size system, so the driver's own threads have nothing to do."""
    sent = spark.sparkContext.broadcast((train, check, scale))

    def solve(batches):
        import pandas as pd

        train, check, scale = sent.value
        for b in batches:
            for lam in b["penalty"]:
                w = ridge(train, k, lam, scale)
                yield pd.DataFrame({"penalty": [lam], "mse": [_mse(check, k, w)], "w": [w.ravel()]})

    tried = spark.createDataFrame([(float(v),) for v in penalties], "penalty double").repartition(len(penalties)).mapInPandas(
        solve, "penalty double, mse double, w array<double>")
    best = tried.orderBy("mse", "penalty").first()
    sent.unpersist()
    return best["penalty"], best["mse"], np.asarray(best["w"]).reshape(k, -1)


def train_forecaster(df: DataFrame, x: str, y: str, split: str, penalties: Sequence[float] = PENALTIES) -> Forecaster:
    """Ridge from one pass over train and validation rows; the penalty with the lowest validation error wins
    (the role early stopping has for a network)."""
    grams = gram_matrices(df.where(F.col(split).isin("train", "validation")), x, y, split)
    k = len(df.select(x).first()[0]) + 1
    if "validation" not in grams:
        raise ValueError("no validation rows to choose the penalty on")
    lam, mse, w = _best_ridge(df.sparkSession, grams["train"], grams["validation"], k, penalties)
    return Forecaster(w[:-1], w[-1], lam, mse)


def _deviations(g: np.ndarray, k: int) -> np.ndarray:
    n = g[k - 1, k - 1]
    return np.sqrt(np.maximum(np.diag(g)[:k - 1] / n - (g[k - 1, :k - 1] / n) ** 2, 0.0))


def fold_forecasters(df: DataFrame, x: str, y: str, day: str, split: str, penalties: Sequence[float] = PENALTIES) -> list[dict]:
    """Leave-one-day-out fits of the forecaster for every day, from one pass over the rows.

    ``split`` is train or validation within each day (the tail of a day). A fold's matrices are the sums over all days
    less the held-out day's, columns are standardised by the fold's own training rows (moments are in the matrix), and
    errors on the held-out day come from that day's matrix, so no fold reads the rows again. Per day two matrices reach
    the driver. A day whose other days have no training or no validation rows has no fit."""
    k = len(df.select(x).first()[0]) + 1
    named = df.withColumn("_group", F.concat_ws("|", F.col(split), F.col(day).cast("string")))
    parts: dict[str, dict[str, np.ndarray]] = {"train": {}, "validation": {}}
    for g, m in gram_matrices(named.where(F.col(split).isin(*parts)), x, y, "_group").items():
        role, name = g.split("|", 1)
        parts[role][name] = m
    days = sorted({*parts["train"], *parts["validation"]})
    out = []
    for hold in days:
        rest = {role: sum((m for d, m in by_day.items() if d != hold), 0) for role, by_day in parts.items()}
        own = sum((by_day[hold] for by_day in parts.values() if hold in by_day), 0)
        if np.ndim(rest["train"]) == 0 or np.ndim(rest["validation"]) == 0:
            continue
        dev = _deviations(rest["train"], k)
        lam, mse, w = _best_ridge(df.sparkSession, rest["train"], rest["validation"], k, penalties, dev)
        last = np.zeros_like(w)  # the state of the last step goes on unchanged
        m = w.shape[1]
        last[np.arange(k - 1 - m, k - 1), np.arange(m)] = 1.0
        out.append({"fold": f"hold_{hold}", "hold": hold, "penalty": lam, "train_rows": int(rest["train"][k - 1, k - 1]), "holdout_rows": int(own[k - 1, k - 1]),
                    "validation_mse": mse, "holdout_mse": _mse(own, k, w), "persistence_mse": _mse(own, k, last), "weights": w})
    return out


def rollout(df: DataFrame, model: Forecaster, steps: int, history: str, keys: Sequence[str], horizons: Sequence[int] | None = None) -> DataFrame:
    """K-step recursive forecast: each prediction is shifted into the history. Batched matrix products per
    Arrow batch; (keys, horizon, state) rows for the wanted horizons."""
    import pyarrow as pa

    wanted = set(horizons or range(1, steps + 1))
    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    fields = [df.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", horizon int, state array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = sent.value
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            h = b.column("_h").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            for k in range(1, steps + 1):
                nxt = h @ w + bias
                h = np.hstack([h[:, bias.shape[0]:], nxt])
                if k in wanted:
                    yield pa.RecordBatch.from_arrays(
                        [*[b.column(x) for x in keys], pa.array(np.full(n, k, dtype="int32")), pa.array(list(nxt), pa.list_(pa.float64()))],
                        [*keys, "horizon", "state"])

    return df.select(*keys, F.flatten(history).alias("_h")).mapInArrow(run, schema)


def composite(model: Forecaster, coef: Sequence[float], intercept: float) -> tuple[list[float], float]:
    """One-step forecast followed by the linear classifier is linear in the history."""
    c = np.asarray(coef)
    return [float(v) for v in model.weights @ c], float(model.bias @ c + intercept)


def occlusion(df: DataFrame, history: str, key: str, weights: Sequence[float], intercept: float, base: Sequence[float],
              whole_steps: bool) -> DataFrame:
    """Change of the probability when one time step (or one cell) of the history is replaced by the baseline.

    The logit is linear in the history, so each replacement is one subtraction: 680 re-scored histories per
    sequence need no matrix product and stay in the JVM.
    """
    steps, width = len(weights) // len(base), len(base)
    per_step = F.array(*[ar.literal_vector(weights[t * width:(t + 1) * width]) for t in range(steps)])
    moved = lambda s, t: F.zip_with(F.zip_with(s, ar.literal_vector(base), lambda x, b: x - b), F.element_at(per_step, t + 1), lambda d, w: d * w)
    logit = ar.dot(F.flatten(history), ar.literal_vector(weights)) + F.lit(float(intercept))
    shifts = F.transform(history, lambda s, t: ar.total(moved(s, t))) if whole_steps else F.flatten(F.transform(history, moved))
    x = df.select(key, logit.alias("_z"), shifts.alias("_d"))
    cells = x.select(key, "_z", F.posexplode("_d").alias("_i", "_s"))
    full, occ = sigmoid(F.col("_z")), sigmoid(F.col("_z") - F.col("_s"))
    step = F.col("_i") if whole_steps else F.floor(F.col("_i") / width)
    out = cells.select(key, (step - (steps - 1)).cast("int").alias("time_step"),
                       (F.lit(None).cast("int") if whole_steps else (F.col("_i") % width)).alias("feature"),
                       full.alias("full_probability"), occ.alias("occluded_probability"), (full - occ).alias("contribution"))
    return out.withColumn("direction", direction(F.col("contribution")))
