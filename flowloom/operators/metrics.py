"""Exact evaluation metrics as plain aggregates; nothing is binned, sampled or sorted in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions.numeric import ratio
from ..functions.ordering import exact_percentiles, value_cdf

THRESHOLD = 0.5


def predicted(p: Column, threshold: float = THRESHOLD) -> Column:
    return (p >= threshold).cast("int")


def confusion_counts(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", threshold: float = THRESHOLD) -> DataFrame:
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"),
        F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"),
        F.avg(hit.cast("double")).alias("positive_fraction"))


def _rates() -> dict[str, Column]:
    tp, fp, fn, tn, n = [F.col(x) for x in ("tp", "fp", "fn", "tn", "n")]
    return {"accuracy": ratio(tp + tn, n), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn)}


def confusion_metrics(counts: DataFrame) -> DataFrame:
    """Undefined rates are NULL and carry a reason."""
    r = _rates()
    reason = lambda x, text: F.when(r[x].isNull(), F.lit(text))
    return counts.select(
        *[x for x in counts.columns if x not in ("brier", "positive_fraction")], *[v.alias(k) for k, v in r.items()],
        ratio(F.col("tp") + F.col("fn"), F.col("n")).alias("prevalence"),
        reason("precision", "TP+FP = 0 (model predicted zero positives): 0/0.").alias("precision_undefined_reason"),
        reason("recall", "TP+FN = 0 (zero actual positives): 0/0.").alias("recall_undefined_reason"),
        reason("fpr", "FP+TN (actual negative count) is 0.").alias("fpr_undefined_reason"))


def degenerate(fraction: Column) -> Column:
    return (fraction >= 0.99) | (fraction <= 0.01)


def confusion_zero(counts: DataFrame) -> DataFrame:
    """Fold variant: 0/0 counts as 0 for precision, recall and F1; FPR stays NULL."""
    r = _rates()
    zero = {k: F.coalesce(v, F.lit(0.0)) if k in ("precision", "recall", "f1") else v for k, v in r.items()}
    return counts.select(*[x for x in counts.columns if x not in ("brier", "positive_fraction")], *[v.alias(k) for k, v in zero.items()],
                         "brier", "positive_fraction", degenerate(F.col("positive_fraction")).alias("degenerate"))


def confusion_withheld(counts: DataFrame) -> DataFrame:
    """Progression variant: recall and F1 are withheld when a class is missing; precision only without negatives."""
    r = _rates()
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    no_pos = (F.col("tp") + F.col("fn") == 0) & (F.col("tn") + F.col("fp") > 0)
    return counts.select(
        *[x for x in counts.columns if x not in ("brier", "positive_fraction")],
        F.when(both | no_pos, r["precision"]).alias("precision"), F.when(both, r["recall"]).alias("recall"),
        F.when(both, r["f1"]).alias("f1"), r["fpr"].alias("fpr"), (~both).alias("withheld"))


def ranking(df: DataFrame, by: str | None = None, y: str = "y", p: str = "p", **kw) -> DataFrame:
    """roc_auc (ties count half) and pr_auc (average precision); NULL when only one class is present."""
    cdf = value_cdf(df, p, {"pos": (F.col(y) == 1).cast("long"), "neg": (F.col(y) != 1).cast("long")}, by, **kw)
    pos, neg = F.col("pos"), F.col("neg")
    tp, fp = F.col("pos_all") - F.col("pos_below"), F.col("neg_all") - F.col("neg_below")
    g = [by] if by else []
    agg = cdf.groupBy(*g).agg(
        F.max("pos_all").alias("positives"), F.max("neg_all").alias("negatives"),
        F.sum(pos * (F.col("neg_below") + neg / 2)).alias("_u"), F.sum(pos * (tp / (tp + fp))).alias("_ap"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return agg.select(*g, "positives", "negatives",
                      F.when(both, F.try_divide(F.col("_u"), F.col("positives") * F.col("negatives"))).alias("roc_auc"),
                      F.when(both, F.try_divide(F.col("_ap"), F.col("positives"))).alias("pr_auc"))


def beats_coin(df: DataFrame, y: str = "y", p: str = "p") -> bool:
    """Whether the scores rank the two classes better than chance. Rows of one class have no ranking: every score must then
    be that class itself, which a coin's are not."""
    r = ranking(df, None, y, p).first()
    if r["roc_auc"] is not None:
        return r["roc_auc"] > 0.5
    return df.where(~F.col(y).cast("double").eqNullSafe(F.col(p))).isEmpty()


def brier(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def edges(bins: int = 10) -> list[float]:
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def calibration_bins(df: DataFrame, by: str, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Equal-width bins, the last one closed; empty bins stay with NULL rates. Groups are few (horizons)."""
    e = edges(bins)
    v = F.col(p)
    place = sum([(v >= x).cast("int") for x in e[2:-1]], (v >= e[1]).cast("int"))
    got = df.where((v >= 0) & (v <= 1)).groupBy(by, place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("observed"))
    table = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(e[i]).alias("bin_low"), F.lit(e[i + 1]).alias("bin_high")) for i in range(bins)])
    grid = df.select(by).distinct().withColumn("_b", F.explode(table)).select(by, "_b.*")
    return grid.join(got, [by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def family_recall(df: DataFrame, family: str, y: str = "y", p: str = "p") -> DataFrame:
    return df.where(F.col(y) == 1).groupBy(family).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(p) >= THRESHOLD).alias("detected")).withColumn("recall", F.col("detected") / F.col("n"))


def trajectory(df: DataFrame, by: str = "horizon", y: str = "y", p: str = "p") -> DataFrame:
    """Distribution of the probability per horizon, overall and by actual class; percentiles are exact."""
    v, pos = F.col(p), F.col(y) == 1
    base = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.avg(F.when(~pos, v)).alias("mean_benign"), F.avg(F.when(pos, v)).alias("mean_attack"))
    out = base.join(exact_percentiles(df, p, {"median": 0.5, "p10": 0.1, "p90": 0.9}, by), by)
    for name, cond in (("benign", ~pos), ("attack", pos)):
        out = out.join(exact_percentiles(df.where(cond), p, {f"median_{name}": 0.5}, by), by, "left")
    return out


def early_warning(df: DataFrame, seq: str = "sequence_id", horizon: str = "horizon", y: str = "y", p: str = "p", last: int = 5) -> DataFrame:
    """Mean probability per horizon for sequences grouped by their actual class at the last horizon."""
    groups = df.where(F.col(horizon) == last).select(seq, (F.col(y) == 1).alias("_attack"))
    j = df.join(groups, seq)
    return j.groupBy(horizon).agg(
        F.count_if("_attack").alias("n_attack_group"), F.avg(F.when(F.col("_attack"), F.col(p))).alias("mean_p_attack_group"),
        F.count_if(~F.col("_attack")).alias("n_benign_group"), F.avg(F.when(~F.col("_attack"), F.col(p))).alias("mean_p_benign_group"))


def sample_errors(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """Per-row mean squared and mean absolute error, inside the row (no shuffle)."""
    return df.withColumn("sample_mse", ar.average(ar.squared_error(F.col(pred), F.col(actual)))).withColumn(
        "sample_mae", ar.average(ar.abs_error(F.col(pred), F.col(actual))))


def regression_metrics(df: DataFrame, pred: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    e = sample_errors(df, pred, actual)
    return e.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("sample_mse").alias("mse"), F.sqrt(F.avg("sample_mse")).alias("rmse"),
                              F.avg("sample_mae").alias("mae"))


def feature_errors(df: DataFrame, pred: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, feature index, signed error) long form."""
    d = F.zip_with(F.col(pred), F.col(actual), lambda a, b: a - b)
    return df.select(*by, F.posexplode(d).alias("feature", "err"))


def per_feature_errors(df: DataFrame, pred: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    return feature_errors(df, pred, actual, by).groupBy(*by, "feature").agg(
        F.avg(F.col("err") * F.col("err")).alias("mse"), F.avg(F.abs("err")).alias("mae"))


def regression_extended(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """One row: overall errors plus exact median and 95th percentile of the per-row error."""
    base = regression_metrics(df, pred, actual)
    pct = exact_percentiles(sample_errors(df, pred, actual).select("sample_mae"), "sample_mae", {"median_abs_error": 0.5, "p95_abs_error": 0.95})
    return base.crossJoin(F.broadcast(pct))


def outlier_features(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """Per feature: mae, exact p95, max and whether the maximum exceeds ten times the mean."""
    long = feature_errors(df, pred, actual).select("feature", F.abs("err").alias("a"))
    base = long.groupBy("feature").agg(F.avg("a").alias("mae"), F.max("a").alias("max_abs"))
    p95 = exact_percentiles(long, "a", {"p95_abs": 0.95}, "feature")
    worst = (F.col("max_abs") > 0) & (F.col("max_abs") / F.greatest(F.col("mae"), F.lit(1e-12)) > 10)
    return base.join(p95, "feature").withColumn("outlier_dominated", worst)


def worst_sample(df: DataFrame, key: str, pred: str, actual: str, by: str) -> DataFrame:
    """Row with the largest error per group, its dominant feature, and the error without that row."""
    e = sample_errors(df, pred, actual)
    sq = ar.squared_error(F.col(pred), F.col(actual))
    best = F.max(F.struct(F.col("sample_mse").alias("m"), (-F.col(key)).alias("k"), ar.argmax(sq).alias("f")))
    a = e.groupBy(by).agg(best.alias("w"), F.sum("sample_mse").alias("_s"), F.count(F.lit(1)).alias("n"))
    return a.select(by, (-F.col("w.k")).alias("worst_id"), F.col("w.m").alias("worst_mse"), F.col("w.f").cast("long").alias("dominant_feature"),
                    F.when(F.col("n") > 1, (F.col("_s") - F.col("w.m")) / (F.col("n") - 1)).alias("mse_without_worst"))


def error_accumulation(metrics: DataFrame, horizon: str = "horizon", value: str = "mse", by: str = "split") -> DataFrame:
    """MSE by horizon and whether it never falls; one row per horizon, so the window is tiny."""
    w = Window.partitionBy(by).orderBy(horizon)
    step = metrics.withColumn("_up", F.coalesce(F.col(value) >= F.lag(value).over(w), F.lit(True)))
    flag = step.groupBy(by).agg(F.bool_and("_up").alias("monotone"))
    return metrics.join(flag, by)


def metrics_pivot(metrics: DataFrame, row: str, column: str, values: Sequence[str], value: str) -> DataFrame:
    return metrics.groupBy(row).pivot(column, list(values)).agg(F.first(value))


def compare_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], left: str, right: str) -> DataFrame:
    """Two metric tables in long form side by side with their difference."""
    la = a.select(*keys, *[F.col(v).cast("double") for v in values]).unpivot(list(keys), list(values), "metric", left)
    lb = b.select(*keys, *[F.col(v).cast("double") for v in values]).unpivot(list(keys), list(values), "metric", right)
    return la.join(lb, [*keys, "metric"]).withColumn("difference", F.col(right) - F.col(left))
