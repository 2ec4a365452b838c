"""Queries: preprocessing parameters and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import c
from ..operators import metrics as mx
from ..operators import scaling as sc
from ..operators import splits as sp
from ..schema import FEATURES, HORIZONS
from . import mapping as m
from . import q_windows as qw
from .registry import query

FITTED = FEATURES
TRAIN_SQL = f"{qw.windows_sql(FITTED)}, {qw.SPLIT_SQL}, tr AS (SELECT * FROM part WHERE partition = 'train')"
_one = lambda f: (f"""SELECT '{f}' AS feature, quantile_cont("{f}", 0.5) AS median FROM tr""")
MED_SQL = "med AS (" + " UNION ALL ".join(_one(f) for f in FITTED) + ")"
_par = lambda f: (f"""SELECT '{f}' AS feature, any_value(median) AS median, avg(coalesce("{f}", median)) AS mean, stddev_pop(coalesce("{f}", median)) AS std FROM tr, med WHERE feature = '{f}'""")
PARAM_SQL = f"{TRAIN_SQL}, {MED_SQL}, params AS (" + " UNION ALL ".join(_par(f) for f in FITTED) + ")"


def train_windows(spark, d, features=FITTED):
    return sp.chronological(qw.windows(spark, d, features)).where("partition = 'train'")


@query("fit_impute_scale", f"WITH {PARAM_SQL} SELECT feature, round(median, 6) AS median, round(mean, 5) AS mean, round(std, 5) AS std, round(CASE WHEN std = 0 THEN 1 ELSE std END, 5) AS scale FROM params")
def fit_impute_scale(spark, d):
    p = sc.fit(train_windows(spark, d), FITTED)
    return p.select("feature", F.round("median", 6).alias("median"), *[F.round(x, 5).alias(x) for x in ("mean", "std", "scale")])


_pick = ", ".join(f"""max({x}) FILTER (WHERE feature = '{f}') AS "{x}_{i}" """ for i, f in enumerate(FITTED) for x in ("median", "mean", "std"))
_scaled = ", ".join(f"""round((coalesce("{f}", median_{i}) - mean_{i}) / CASE WHEN std_{i} = 0 THEN 1 ELSE std_{i} END, 6) AS "{f}" """ for i, f in enumerate(FITTED))


@query("transform_frozen", f"WITH {PARAM_SQL}, pk AS (SELECT {_pick} FROM params) SELECT window_id, {_scaled} FROM win, pk")
def transform_frozen(spark, d):
    w = qw.windows(spark, d, FITTED)
    params = sc.load(sc.fit(sp.chronological(w).where("partition = 'train'"), FITTED))
    return sc.transform(w, params).select("window_id", *[F.round(c(f), 6).alias(f) for f in FITTED])


_steps = lambda i: f"(((window_id * 7 + {i * 3}) % 17 - 8) / 4.0E0)"


@query("inverse_scale", f"""WITH {PARAM_SQL}, pk AS (SELECT {_pick} FROM params) SELECT window_id, {", ".join(f'round({_steps(i)} * CASE WHEN std_{i} = 0 THEN 1 ELSE std_{i} END + mean_{i} + 1e-4, 2) AS "{f}"' for i, f in enumerate(FITTED))} FROM win, pk""")
def inverse_scale(spark, d):
    """Scaled states, a quarter of a deviation apart and another one per window and feature, back in raw units: mean and
    scale of the training windows do not cancel. The offset keeps whole and dyadic results off the rounding border."""
    w = qw.windows(spark, d, FITTED)
    params = sc.load(sc.fit(sp.chronological(w).where("partition = 'train'"), FITTED))
    scaled = w.select("window_id", *[F.expr(_steps(i)).alias(f) for i, f in enumerate(FITTED)])
    return sc.inverse(scaled, params).select("window_id", *[F.round(c(f) + 1e-4, 2).alias(f) for f in FITTED])


_KEEP = [f for i, f in enumerate(FITTED) if i % 16 == 0]
_cells = ", ".join(f"(coalesce(\"{f}\", median_{i}) - mean_{i}) / CASE WHEN std_{i} = 0 THEN 1 ELSE std_{i} END" for i, f in enumerate(FITTED))


@query("leakage_rows", f"""WITH {PARAM_SQL}, pk AS (SELECT {_pick} FROM params), p AS (SELECT win.*, part.partition FROM win JOIN part USING (window_id)),
s AS (SELECT p.partition, [{_cells}] AS x FROM p, pk), c AS (SELECT partition, count(*) FILTER (WHERE isinf(v)) AS infinite, count(*) FILTER (WHERE v IS NULL OR isnan(v)) AS missing FROM (SELECT partition, unnest(x) AS v FROM s) GROUP BY 1),
same AS (SELECT partition, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM p t WHERE t.partition = 'train' AND {" AND ".join(f't."{f}" IS NOT DISTINCT FROM p."{f}"' for f in _KEEP)})) AS n FROM p WHERE partition <> 'train' GROUP BY 1),
d AS (SELECT *, CAST(CASE WHEN window_start < TIMESTAMP '2024-01-11' THEN 1 WHEN window_start < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END AS VARCHAR) AS day FROM win),
h AS (SELECT f.fold, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM d t WHERE t.day <> f.hold AND {" AND ".join(f't."{f}" IS NOT DISTINCT FROM d."{f}"' for f in _KEEP)})) AS n
 FROM d, (VALUES ('fold_hold_1', '1'), ('fold_hold_2', '2'), ('fold_hold_3', '3')) f(fold, hold) WHERE d.day = f.hold GROUP BY 1)
SELECT 'infinite_after_scaling' AS check_name, partition AS part, infinite AS offending FROM c UNION ALL SELECT 'missing_after_scaling', partition, missing FROM c
UNION ALL SELECT 'content_of_training', partition, n FROM same UNION ALL SELECT 'content_of_training_days', fold, n FROM h""")
def leakage_rows(spark, d):
    """Cells left unusable by the scaling, and rows whose content training has as well, by partition and by held-out day.

    The content is that of every sixteenth feature: rows that repeat in all of them hardly occur in the given tables."""
    w = sp.chronological(qw.windows(spark, d, FITTED))
    scaled = sc.transform(w, sc.load(sc.fit(w.where("partition = 'train'"), FITTED)))
    out = None
    for p in ("train", "validation", "test"):
        one = sp.unusable_cells(scaled.where(F.col("partition") == p), FITTED).select(
            F.explode(F.array(*[F.struct(F.lit(f"{k}_after_scaling").alias("check_name"), F.lit(p).alias("part"), F.col(k).alias("offending")) for k in ("infinite", "missing")])).alias("r")).select("r.*")
        out = one if out is None else out.unionByName(one)
    shared = sp.shared_rows(w, "partition", _KEEP).select(F.lit("content_of_training").alias("check_name"), F.col("partition").alias("part"), "offending")
    t = F.col("window_start")
    day = F.when(t < F.lit("2024-01-11").cast("timestamp_ntz"), "1").when(t < F.lit("2024-01-21").cast("timestamp_ntz"), "2").otherwise("3")
    folds = sp.holdout_folds(w.withColumn("day", day), "day", qw.FOLDS)
    held = sp.shared_rows(folds, "role", _KEEP, ["fold"]).select(F.lit("content_of_training_days").alias("check_name"), F.col("fold").alias("part"), "offending")
    return out.unionByName(shared).unionByName(held)


@query("class_weights", f"WITH {m.SCORES_SQL} SELECT sequence_id, y, round((SELECT count(*) FROM scores) / (2.0E0 * count(*) OVER (PARTITION BY y)), 9) AS weight FROM scores")
def class_weights(spark, d):
    return sc.class_weights(m.scores(spark, d), "y").select("sequence_id", "y", F.round("weight", 9).alias("weight"))


# ---- classification --------------------------------------------------------------------------------------

DAY = 'CAST("day" AS VARCHAR) AS "day"'
CONF = """conf AS (SELECT {k}, count(*) AS n, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
 count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, avg((p - y) * (p - y)) AS brier,
 avg(CASE WHEN p >= 0.5 THEN 1.0E0 ELSE 0.0E0 END) AS positive_fraction FROM {t} GROUP BY ALL)"""
R6 = ["accuracy", "precision", "recall", "f1", "fpr", "prevalence", "brier", "positive_fraction"]


def _r(df):
    return df.select(*[F.round(x, 6).alias(x) if x in R6 else F.col(x) for x in df.columns])


def _counts(spark, d, by="day"):
    return mx.confusion_counts(m.scores(spark, d).withColumn("day", F.col("day").cast("string")), [by])


@query("confusion_metrics", f"""WITH {m.SCORES_SQL}, {CONF.format(k=DAY, t='scores')} SELECT "day", n, tn, fp, fn, tp, round((tp + tn) / n, 6) AS accuracy,
round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS fpr,
round((tp + fn) / n, 6) AS prevalence, CASE WHEN tp + fp = 0 THEN 'TP+FP = 0 (model predicted zero positives): 0/0.' END AS precision_undefined_reason,
CASE WHEN tp + fn = 0 THEN 'TP+FN = 0 (zero actual positives): 0/0.' END AS recall_undefined_reason, CASE WHEN fp + tn = 0 THEN 'FP+TN (actual negative count) is 0.' END AS fpr_undefined_reason FROM conf""")
def confusion_metrics(spark, d):
    return _r(mx.confusion_metrics(_counts(spark, d)))


@query("confusion_zero", f"""WITH {m.SCORES_SQL}, {CONF.format(k='family', t='scores')} SELECT family, n, tn, fp, fn, tp, round((tp + tn) / n, 6) AS accuracy,
round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
round(fp / nullif(fp + tn, 0), 6) AS fpr, round(brier, 6) AS brier, round(positive_fraction, 6) AS positive_fraction, positive_fraction >= 0.99 OR positive_fraction <= 0.01 AS degenerate FROM conf""")
def confusion_zero(spark, d):
    return _r(mx.confusion_zero(_counts(spark, d, "family")))


@query("confusion_withheld", f"""WITH {m.SCORES_SQL}, {CONF.format(k='family', t='scores')} SELECT family, n, tn, fp, fn, tp,
round(CASE WHEN tn + fp > 0 THEN tp / nullif(tp + fp, 0) END, 6) AS precision, round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN tp / (tp + fn) END, 6) AS recall,
round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN 2 * tp / nullif(2 * tp + fp + fn, 0) END, 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS fpr, NOT (tp + fn > 0 AND tn + fp > 0) AS withheld FROM conf""")
def confusion_withheld(spark, d):
    return _r(mx.confusion_withheld(_counts(spark, d, "family")))


@query("roc_auc", f"""WITH {m.SCORES_SQL}, s AS (SELECT horizon, p, sum(y) AS pos, sum(1 - y) AS neg FROM scores GROUP BY 1, 2), c AS (SELECT *, sum(neg) OVER (PARTITION BY horizon ORDER BY p) - neg AS below FROM s)
SELECT horizon, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives, round(sum(pos * (below + neg / 2.0E0)) / (sum(pos) * sum(neg)), 9) AS roc_auc FROM c GROUP BY 1""")
def roc_auc(spark, d):
    return mx.ranking(m.scores(spark, d), "horizon").select("horizon", "positives", "negatives", F.round("roc_auc", 9).alias("roc_auc"))


@query("pr_auc", f"""WITH {m.SCORES_SQL}, s AS (SELECT horizon, p, sum(y) AS pos, count(*) AS n FROM scores GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER (PARTITION BY horizon) AS allpos FROM s WINDOW w AS (PARTITION BY horizon ORDER BY p DESC))
SELECT horizon, round(sum(pos / CAST(allpos AS DOUBLE) * (tp / CAST(k AS DOUBLE))), 9) AS pr_auc FROM c GROUP BY 1""")
def pr_auc(spark, d):
    return mx.ranking(m.scores(spark, d), "horizon").select("horizon", F.round("pr_auc", 9).alias("pr_auc"))


@query("roc_auc_one_class", "SELECT family, count(*) AS positives, CAST(NULL AS DOUBLE) AS roc_auc FROM (SELECT CASE event_type WHEN 'error' THEN 'Infilteration' ELSE 'SSH-Bruteforce' END AS family FROM events WHERE event_type IN ('error', 'signup')) GROUP BY 1")
def roc_auc_one_class(spark, d):
    return mx.ranking(m.scores(spark, d).where("y = 1"), "family").select("family", "positives", "roc_auc")


@query("brier", f"WITH {m.SCORES_SQL} SELECT horizon, round(avg((p - y) * (p - y)), 8) AS brier FROM scores GROUP BY 1")
def brier(spark, d):
    return mx.brier(m.scores(spark, d), ["horizon"]).select("horizon", F.round("brier", 8).alias("brier"))


_edges = ", ".join(f"({i}, {lo!r}E0, {hi!r}E0)" for i, (lo, hi) in enumerate(zip(mx.edges(), mx.edges()[1:])))


@query("calibration_bins", f"""WITH {m.SCORES_SQL}, low AS (SELECT horizon, y, CASE WHEN p > 0.9 AND p < 1.0 THEN 0.85E0 ELSE p END AS p FROM scores), e(bin, lo, hi) AS (VALUES {_edges}), g AS (SELECT * FROM (SELECT DISTINCT horizon FROM scores), e)
SELECT g.horizon, g.bin, round(g.lo, 9) AS bin_low, round(g.hi, 9) AS bin_high, count(s.p) AS n, round(avg(s.p), 8) AS mean_p, round(avg(s.y), 8) AS observed
FROM g LEFT JOIN low s ON s.horizon = g.horizon AND s.p >= g.lo AND (s.p < g.hi OR (g.bin = 9 AND s.p <= g.hi)) GROUP BY ALL""")
def calibration_bins(spark, d):
    p = F.when((F.col("p") > 0.9) & (F.col("p") < 1.0), 0.85).otherwise(F.col("p"))
    b = mx.calibration_bins(m.scores(spark, d).withColumn("p", p), "horizon")
    return b.select("horizon", "bin", F.round("bin_low", 9).alias("bin_low"), F.round("bin_high", 9).alias("bin_high"), "n",
                    F.round("mean_p", 8).alias("mean_p"), F.round("observed", 8).alias("observed"))


@query("degenerate_check", f"WITH {m.SCORES_SQL}, g AS (SELECT horizon, avg(CASE WHEN p >= 0.995 THEN 1.0E0 ELSE 0.0E0 END) AS f FROM scores GROUP BY 1) SELECT horizon, round(f, 8) AS positive_fraction, f >= 0.99 OR f <= 0.01 AS degenerate FROM g")
def degenerate_check(spark, d):
    g = mx.confusion_counts(m.scores(spark, d), ["horizon"], threshold=0.995)
    return g.select("horizon", F.round("positive_fraction", 8).alias("positive_fraction"), mx.degenerate(F.col("positive_fraction")).alias("degenerate"))


@query("family_recall", f"WITH {m.SCORES_SQL} SELECT family, count(*) AS n, count(*) FILTER (WHERE p >= 0.5) AS detected, round(count(*) FILTER (WHERE p >= 0.5) / CAST(count(*) AS DOUBLE), 8) AS recall FROM scores WHERE y = 1 GROUP BY 1")
def family_recall(spark, d):
    return mx.family_recall(m.scores(spark, d), "family").withColumn("recall", F.round("recall", 8))


@query("trajectory_stats", f"""WITH {m.SCORES_SQL} SELECT horizon, count(*) AS n, round(avg(p), 8) AS mean, round(stddev_pop(p), 8) AS std, round(avg(p) FILTER (WHERE y = 0), 8) AS mean_benign, round(avg(p) FILTER (WHERE y = 1), 8) AS mean_attack,
round(quantile_cont(p, 0.5), 8) AS median, round(quantile_cont(p, 0.1), 8) AS p10, round(quantile_cont(p, 0.9), 8) AS p90, round(quantile_cont(p, 0.5) FILTER (WHERE y = 0), 8) AS median_benign, round(quantile_cont(p, 0.5) FILTER (WHERE y = 1), 8) AS median_attack FROM scores GROUP BY 1""")
def trajectory_stats(spark, d):
    t = mx.trajectory(m.scores(spark, d))
    return t.select("horizon", "n", *[F.round(x, 8).alias(x) for x in t.columns if x not in ("horizon", "n")])


# Probabilities of one sequence at several horizons: missing where the horizon leaves its segment.
HP = "CAST((e * 7919 + u * 104729 + k * 31 + horizon * 977) % 1001 AS DOUBLE) / 1000.0E0"
HY = "CASE WHEN (CAST(floor(value) AS BIGINT) + horizon) % 3 = 0 THEN 1 ELSE 0 END"
HORIZON_SQL = f"{m._RAW_SQL}, hs AS (SELECT e AS sequence_id, horizon, {HP} AS p, {HY} AS y, k, t, u FROM raw, (VALUES (1), (2), (3), (5)) h(horizon))"


def horizon_scores(spark, d):
    base = m.table(spark, d, "events").selectExpr(
        "event_id AS e", "user_id AS u", "event_type AS t", "value", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    return base.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS]))).selectExpr(
        "e AS sequence_id", "horizon", f"{HP} AS p", f"{HY} AS y", "k", "t", "u")


@query("early_warning", f"""WITH {HORIZON_SQL}, g AS (SELECT sequence_id, y = 1 AS attack FROM hs WHERE horizon = 5)
SELECT horizon, count(*) FILTER (WHERE attack) AS n_attack_group, round(avg(p) FILTER (WHERE attack), 8) AS mean_p_attack_group, count(*) FILTER (WHERE NOT attack) AS n_benign_group, round(avg(p) FILTER (WHERE NOT attack), 8) AS mean_p_benign_group FROM hs JOIN g USING (sequence_id) GROUP BY 1""")
def early_warning(spark, d):
    t = mx.early_warning(horizon_scores(spark, d))
    return t.select("horizon", "n_attack_group", "n_benign_group", *[F.round(x, 8).alias(x) for x in ("mean_p_attack_group", "mean_p_benign_group")])


@query("semi_group", f"WITH {HORIZON_SQL} SELECT sequence_id, horizon, round(p, 6) AS p FROM hs WHERE sequence_id IN (SELECT sequence_id FROM hs WHERE horizon = 5 AND y = 1)")
def semi_group(spark, d):
    h = horizon_scores(spark, d)
    return h.join(h.where("horizon = 5 AND y = 1").select("sequence_id"), "sequence_id", "left_semi").select("sequence_id", "horizon", F.round("p", 6).alias("p"))


@query("union_results", f"WITH {HORIZON_SQL} SELECT 'oracle' AS mode, sequence_id, horizon, round(y * 1.0E0, 6) AS p FROM hs UNION ALL SELECT 'full_pipeline', sequence_id, horizon, round(p, 6) FROM hs")
def union_results(spark, d):
    h = horizon_scores(spark, d)
    a = h.select(F.lit("oracle").alias("mode"), "sequence_id", "horizon", F.col("y").cast("double").alias("p"))
    return a.unionByName(h.select(F.lit("full_pipeline").alias("mode"), "sequence_id", "horizon", F.round("p", 6).alias("p")))


@query("score_probability", f"WITH {HORIZON_SQL} SELECT sequence_id, horizon, round(p, 6) AS p, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted_class FROM hs")
def score_probability(spark, d):
    return horizon_scores(spark, d).select("sequence_id", "horizon", F.round("p", 6).alias("p"), mx.predicted(F.col("p")).alias("predicted_class"))


@query("day_comparison", f"""WITH {m.SCORES_SQL}, a AS (SELECT *, p AS p0 FROM scores), {CONF.format(k=DAY, t='a')}, b AS (SELECT "day", y, 1 - p AS p FROM scores), {CONF.replace('conf AS', 'conf2 AS').format(k=DAY, t='b')},
x AS (SELECT "day", 'accuracy' AS metric, (tp + tn) / CAST(n AS DOUBLE) AS v FROM conf UNION ALL SELECT "day", 'brier', brier FROM conf), y2 AS (SELECT "day", 'accuracy' AS metric, (tp + tn) / CAST(n AS DOUBLE) AS v FROM conf2 UNION ALL SELECT "day", 'brier', brier FROM conf2)
SELECT "day", metric, round(x.v, 6) AS frozen, round(y2.v, 6) AS retrained, round(y2.v - x.v, 6) AS difference FROM x JOIN y2 USING ("day", metric)""")
def day_comparison(spark, d):
    s = m.scores(spark, d).withColumn("day", F.col("day").cast("string"))
    runs = [mx.confusion_zero(mx.confusion_counts(x, ["day"])) for x in (s, s.withColumn("p", 1 - F.col("p")))]
    j = mx.compare_runs(runs[0], runs[1], ["day"], ["accuracy", "brier"], "frozen", "retrained")
    return j.select("day", "metric", *[F.round(x, 6).alias(x) for x in ("frozen", "retrained", "difference")])


@query("join_compare_runs", f"""WITH {HORIZON_SQL}, a AS (SELECT horizon, avg((p - y) * (p - y)) AS brier, avg(p) AS mean_p FROM hs GROUP BY 1), b AS (SELECT horizon, avg((0.5 - y) * (0.5 - y)) AS brier, avg(0.5E0) AS mean_p FROM hs GROUP BY 1)
SELECT horizon, 'brier' AS metric, round(a.brier, 7) AS pipeline, round(b.brier, 7) AS oracle, round(b.brier - a.brier, 7) AS difference FROM a JOIN b USING (horizon) UNION ALL SELECT horizon, 'mean_p', round(a.mean_p, 7), round(b.mean_p, 7), round(b.mean_p - a.mean_p, 7) FROM a JOIN b USING (horizon)""")
def join_compare_runs(spark, d):
    h = horizon_scores(spark, d)
    runs = [x.groupBy("horizon").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.avg("p").alias("mean_p")) for x in (h, h.withColumn("p", F.lit(0.5)))]
    j = mx.compare_runs(runs[0], runs[1], ["horizon"], ["brier", "mean_p"], "pipeline", "oracle")
    return j.select("horizon", "metric", *[F.round(x, 7).alias(x) for x in ("pipeline", "oracle", "difference")])


# ---- regression: the state after each embedding is the next one ------------------------------------------

EMB_SQL = """emb AS (SELECT a.vec_id, a.label, list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)) AS pred, list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)) AS actual FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
cell AS (SELECT vec_id, label, unnest(range(len(pred))) AS feature, unnest(pred) AS pv, unnest(actual) AS av FROM emb), er AS (SELECT *, pv - av AS err FROM cell),
smp AS (SELECT vec_id, label, avg(err * err) AS sample_mse, avg(abs(err)) AS sample_mae FROM er GROUP BY ALL)"""


def embedding_pairs(spark, d):
    e = m.table(spark, d, "embeddings")
    vec = F.col("embedding").cast("array<double>")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), vec.alias("actual"))
    return e.select("vec_id", "label", vec.alias("pred")).join(nxt, "vec_id")


@query("regression_metrics", f"WITH {EMB_SQL} SELECT label, count(*) AS n, round(avg(sample_mse), 8) AS mse, round(sqrt(avg(sample_mse)), 8) AS rmse, round(avg(sample_mae), 8) AS mae FROM smp GROUP BY 1")
def regression_metrics(spark, d):
    r = mx.regression_metrics(embedding_pairs(spark, d), "pred", "actual", ["label"])
    return r.select("label", "n", *[F.round(x, 8).alias(x) for x in ("mse", "rmse", "mae")])


@query("regression_per_feature", f"WITH {EMB_SQL} SELECT CAST(feature AS INTEGER) AS feature, round(avg(err * err), 8) AS mse, round(avg(abs(err)), 8) AS mae FROM er GROUP BY 1")
def regression_per_feature(spark, d):
    r = mx.per_feature_errors(embedding_pairs(spark, d), "pred", "actual")
    return r.select("feature", F.round("mse", 8).alias("mse"), F.round("mae", 8).alias("mae"))


@query("regression_extended", f"WITH {EMB_SQL} SELECT count(*) AS n, round(avg(sample_mse), 8) AS mse, round(sqrt(avg(sample_mse)), 8) AS rmse, round(avg(sample_mae), 8) AS mae, round(quantile_cont(sample_mae, 0.5), 8) AS median_abs_error, round(quantile_cont(sample_mae, 0.95), 8) AS p95_abs_error FROM smp")
def regression_extended(spark, d):
    r = mx.regression_extended(embedding_pairs(spark, d), "pred", "actual")
    return r.select("n", *[F.round(x, 8).alias(x) for x in r.columns if x != "n"])


@query("outlier_features", f"WITH {EMB_SQL} SELECT CAST(feature AS INTEGER) AS feature, round(avg(abs(err)), 8) AS mae, round(max(abs(err)), 8) AS max_abs, round(quantile_cont(abs(err), 0.95), 8) AS p95_abs, max(abs(err)) > 0 AND max(abs(err)) / greatest(avg(abs(err)), 1e-12) > 10 AS outlier_dominated FROM er GROUP BY 1")
def outlier_features(spark, d):
    r = mx.outlier_features(embedding_pairs(spark, d), "pred", "actual")
    return r.select("feature", *[F.round(x, 8).alias(x) for x in ("mae", "max_abs", "p95_abs")], "outlier_dominated")


@query("worst_sample", f"""WITH {EMB_SQL}, w AS (SELECT label, arg_max(vec_id, (sample_mse, -vec_id)) AS worst_id, max(sample_mse) AS worst_mse, CASE WHEN count(*) > 1 THEN (sum(sample_mse) - max(sample_mse)) / (count(*) - 1) END AS rest FROM smp GROUP BY 1)
SELECT w.label, worst_id, round(worst_mse, 8) AS worst_mse, CAST((SELECT arg_max(feature, (err * err, -feature)) FROM er WHERE er.vec_id = w.worst_id) AS BIGINT) AS dominant_feature, round(rest, 8) AS mse_without_worst FROM w""")
def worst_sample(spark, d):
    w = mx.worst_sample(embedding_pairs(spark, d), "vec_id", "pred", "actual", "label")
    return w.select("label", "worst_id", "dominant_feature", F.round("worst_mse", 8).alias("worst_mse"), F.round("mse_without_worst", 8).alias("mse_without_worst"))


_HM = "hm AS (SELECT CASE WHEN t IN ('error', 'signup') THEN 'validation' ELSE 'train' END AS split, horizon, avg((p - y) * (p - y)) AS mse FROM hs GROUP BY 1, 2)"


def _horizon_mse(spark, d):
    split = F.when(F.col("t").isin("error", "signup"), "validation").otherwise("train")
    return horizon_scores(spark, d).groupBy(split.alias("split"), "horizon").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("mse"))


@query("error_accumulation", f"WITH {HORIZON_SQL}, {_HM}, s AS (SELECT *, mse >= lag(mse) OVER (PARTITION BY split ORDER BY horizon) AS up FROM hm) SELECT split, horizon, round(mse, 8) AS mse, bool_and(coalesce(up, true)) OVER (PARTITION BY split) AS monotone FROM s")
def error_accumulation(spark, d):
    return mx.error_accumulation(_horizon_mse(spark, d)).select("split", "horizon", F.round("mse", 8).alias("mse"), "monotone")


@query("metrics_pivot", f"WITH {HORIZON_SQL}, {_HM} SELECT horizon, round(max(mse) FILTER (WHERE split = 'train'), 8) AS train, round(max(mse) FILTER (WHERE split = 'validation'), 8) AS validation FROM hm GROUP BY 1")
def metrics_pivot(spark, d):
    p = mx.metrics_pivot(_horizon_mse(spark, d), "horizon", "split", ["train", "validation"], "mse")
    return p.select("horizon", F.round("train", 8).alias("train"), F.round("validation", 8).alias("validation"))
