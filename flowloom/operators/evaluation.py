"""Everything fitted on some days, frozen, and applied to others.

Preprocessing, the classifiers on flattened histories, the forecaster and the classifier of states see windows of the
training days only; the other days are transformed and scored. Sequences and horizons never leave their day. A report has
one row per day, model and horizon, so it is the only thing that grows with the number of days; a day without a sequence
has no row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import exact_percentiles
from ..schema import FEATURES, HORIZONS
from ..sources.tables import staging_dir, write_stage
from . import metrics as mx
from . import models as md
from . import scaling as sc
from . import sequences as sq
from . import splits as sp


@dataclass(frozen=True)
class Frozen:
    """Fitted parts. ``windows`` and ``sequences`` are written tables of all days, scaled by the training days' parameters."""

    params: dict[str, tuple[float, float, float]]
    logistic: LogisticRegressionModel
    forest: RandomForestClassificationModel
    forecaster: md.Forecaster
    state_classifier: LogisticRegressionModel
    windows: str
    sequences: str


def fit(windows: DataFrame, train_days: Sequence[str], day: str = "day", target: str = "binary_target", trees: int = 300, depth: int = 30) -> Frozen:
    """``windows`` hold raw state columns, ids that are dense in time, segments, labels and a day. The last tenth of each
    training day's sequences chooses the forecaster's penalty and is not fitted by it."""
    spark = windows.sparkSession
    params = sc.load(sc.fit(windows.where(F.col(day).isin(*train_days)), FEATURES))
    scaled = sq.with_state(sc.transform(windows, params)).withColumn("target", F.col(target)).select(
        day, "window_id", "segment_id", "window_start", "state", "target", "label")
    w = write_stage(scaled, staging_dir(spark, "scaled_windows"))
    slid = sq.sliding_sequences(spark.read.parquet(w), by=[day]).withColumn("flat", F.flatten("history"))
    s = write_stage(sp.tail_split(slid, day), staging_dir(spark, "day_sequences"))
    train = spark.read.parquet(s).where(F.col(day).isin(*train_days))
    y = "target_window_target"
    return Frozen(params, md.train_logistic(train, "flat", y), md.train_forest(train, "flat", y, trees, depth),
                  md.train_forecaster(train, "flat", "next_state", "split"), md.train_logistic(train, "next_state", y), w, s)


def forecasts(frozen: Frozen, spark, days: Sequence[str], day: str = "day", horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """(day, sequence_id, horizon, state, actual, y) of all sequences of the days, where the horizon stays in the segment."""
    w = spark.read.parquet(frozen.windows).where(F.col(day).isin(*days))
    s = spark.read.parquet(frozen.sequences).where(F.col(day).isin(*days))
    f = md.rollout(s, frozen.forecaster, max(horizons), "history", [day, "sequence_id", "input_end_window"], horizons)
    valid = sq.horizon_targets(w, horizons, by=[day]).where("target_window IS NOT NULL").select(
        day, "input_end_window", "horizon", "target_window", F.col("future_target").alias("y"))
    actual = w.select(day, F.col("window_id").alias("target_window"), F.col("state").alias("actual"))
    return f.join(valid, [day, "input_end_window", "horizon"]).join(actual, [day, "target_window"]).select(
        day, "sequence_id", "horizon", "state", "actual", "y")


def predictions(frozen: Frozen, spark, days: Sequence[str], ahead: DataFrame, day: str = "day") -> DataFrame:
    """(day, model, horizon, y, p): both classifiers of histories, and the classifier of states on true and on forecast ones."""
    s = spark.read.parquet(frozen.sequences).where(F.col(day).isin(*days)).select(day, F.col("target_window_target").alias("y"), "flat")
    one = lambda df, name: df.select(day, F.lit(name).alias("model"), F.lit(1).alias("horizon"), "y", "p")
    clf = frozen.state_classifier
    p = lambda c: md.linear_probability(F.col(c), clf.coefficients.toArray(), clf.intercept)
    states = ahead.select(day, "horizon", "y", F.explode(F.array(
        F.struct(F.lit("state_oracle").alias("model"), p("actual").alias("p")),
        F.struct(F.lit("state_pipeline").alias("model"), p("state").alias("p")))).alias("x")).select(day, "x.model", "horizon", "y", "x.p")
    return one(md.score(s, frozen.logistic, "flat"), "logistic_history").unionByName(
        one(md.score(s, frozen.forest, "flat"), "forest_history")).unionByName(states)


def report(frozen: Frozen, spark, days: Sequence[str], day: str = "day") -> DataFrame:
    """Per day, model and horizon: counts, rates, areas under the curves; for forecast states also the errors of the states."""
    ahead = spark.read.parquet(write_stage(forecasts(frozen, spark, days, day), staging_dir(spark, "forecasts")))
    keys = [day, "model", "horizon"]
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    scored = spark.read.parquet(write_stage(predictions(frozen, spark, days, ahead, day).withColumn("_g", name), staging_dir(spark, "predictions")))
    rates = mx.confusion_zero(mx.confusion_counts(scored, [*keys, "_g"])).join(mx.ranking(scored, "_g").select("_g", "roc_auc", "pr_auc"), "_g", "left")
    errors = ahead.withColumn("_g", F.concat_ws("|", F.col(day).cast("string"), F.lit("state_pipeline"), F.col("horizon").cast("string")))
    sizes = exact_percentiles(mx.sample_errors(errors, "state", "actual").select("_g", "sample_mae"), "sample_mae", {"median_abs_error": 0.5, "p95_abs_error": 0.95}, "_g")
    reg = mx.regression_metrics(errors, "state", "actual", ["_g"]).drop("n").join(sizes, "_g")
    return rates.join(reg, "_g", "left").drop("_g")
