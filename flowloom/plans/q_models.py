"""Queries around trained models. Results depend on the optimiser, so they are checked by rows and by tests."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from ..functions.arrays import flatten_names
from ..functions.numeric import c
from ..operators import attribution as at
from ..operators import evaluation as ev
from ..operators import metrics as mx
from ..operators import models as md
from ..operators import rules as ru
from ..operators import scaling as sc
from ..operators import sequences as sq
from ..operators import splits as sp
from ..schema import FEATURES, HORIZONS, STATE
from ..sources.tables import staging_dir, write_params, write_stage
from . import mapping as m
from . import q_windows as qw
from .registry import query

_STAGED: dict[tuple[str, str], dict] = {}


def staged(spark, d):
    """Scaled sequences and windows of the whole table, written once per application and input folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STAGED:
        raw = write_stage(sp.chronological(qw.windows(spark, d, STATE)), staging_dir(spark, "windows"))
        windows = spark.read.parquet(raw)
        params = sc.load(sc.fit(windows.where("partition = 'train'"), FEATURES))
        scaled = sc.transform(windows, params)
        seq = sp.partition_sequences(sq.sliding_sequences(sq.with_state(scaled)), windows)
        seq = seq.withColumn("flat", F.flatten("history"))
        path = write_stage(seq, staging_dir(spark, "sequences"))
        _STAGED[key] = {"sequences": path, "windows": raw, "params": params}
    return _STAGED[key]


def seqs(spark, d):
    return spark.read.parquet(staged(spark, d)["sequences"])


def wins(spark, d):
    return spark.read.parquet(staged(spark, d)["windows"])


def _memo(spark, d, name, make):
    s = staged(spark, d)
    if name not in s:
        s[name] = make()
    return s[name]


def logistic(spark, d):
    return _memo(spark, d, "lr", lambda: md.train_logistic(seqs(spark, d).where("partition = 'train'"), "flat", "target_window_target"))


def forest(spark, d):
    return _memo(spark, d, "rf", lambda: md.train_forest(seqs(spark, d).where("partition = 'train'").select("flat", "target_window_target"), "flat", "target_window_target"))


def state_classifier(spark, d):
    return _memo(spark, d, "clf", lambda: md.train_logistic(seqs(spark, d).where("partition = 'train'"), "next_state", "target_window_target"))


def forecaster(spark, d):
    return _memo(spark, d, "fc", lambda: md.train_forecaster(seqs(spark, d), "flat", "next_state", "partition"))


def _evaluated(df):
    out = mx.confusion_zero(mx.confusion_counts(df.withColumnRenamed("target_window_target", "y"), ["partition"]))
    auc = mx.ranking(df.withColumnRenamed("target_window_target", "y"), "partition").select("partition", "roc_auc", "pr_auc")
    return out.join(auc, "partition", "left")


@query("train_logreg")
def train_logreg(spark, d):
    s = seqs(spark, d).where("partition IS NOT NULL").select("sequence_id", "partition", "target_window_target", "flat")
    return _evaluated(md.score(s, logistic(spark, d), "flat"))


@query("train_rf")
def train_rf(spark, d):
    s = seqs(spark, d).where("partition IS NOT NULL").select("sequence_id", "partition", "target_window_target", "flat")
    return _evaluated(md.score(s, forest(spark, d), "flat"))


@query("train_next_state_clf")
def train_next_state_clf(spark, d):
    s = seqs(spark, d).where("partition IS NOT NULL").select("sequence_id", "partition", "target_window_target", "next_state")
    return _evaluated(md.score(s, state_classifier(spark, d), "next_state"))


@query("train_forecaster")
def train_forecaster(spark, d):
    s = seqs(spark, d).where("partition IS NOT NULL")
    f = md.rollout(s, forecaster(spark, d), 1, "history", ["sequence_id", "partition"])
    j = f.join(s.select("sequence_id", "next_state"), "sequence_id")
    return mx.regression_metrics(j, "state", "next_state", ["partition"])


# ---- fixed weights: applying a model is plain algebra, so SQL can check it ---------------------------------------------

#: A forecaster and a classifier over all state columns, with weights at all ten steps. A feature follows its own history with
#: weights in eighths that are dealt in another order to each feature; coefficients are powers of two below the size of the
#: feature. Over whole-number histories every sum is then exact in doubles, whatever its order.
EIGHTHS, BIAS, INTERCEPT = [4, 1, -1, 1, -1, 1, -1, 1, -1, 1], 0.125, -0.75
LARGE = {"Flow Byts/s": 26, "Flow Duration": 25, "TotLen Fwd Pkts": 22, "Subflow Fwd Byts": 22, "Fwd Pkt Len Mean": 18, "Fwd Seg Size Avg": 18,
         "Init Fwd Win Byts": 16, "Init Bwd Win Byts": 16}
COEF = [(-1) ** i * 2.0 ** -LARGE.get(f, 11) for i, f in enumerate(STATE)]
BASE = [8.0 * (i % 7) for i in range(len(STATE))]


def _weight(back, i):
    """Weight of feature i, ``back`` steps before the end of the history."""
    return EIGHTHS[(back + i) % sq.HISTORY] / 8


def fixed_forecaster():
    n = len(STATE)
    w = np.vstack([np.diag([_weight(sq.HISTORY - 1 - t, i) for i in range(n)]) for t in range(sq.HISTORY)])
    return md.Forecaster(w, np.full(n, BIAS), 0.0, 0.0)


def _whole(state):
    """Missing numbers are zero, others go to the next whole number; the offset keeps halves off the border."""
    return F.transform(state, lambda x: F.round(F.coalesce(x, F.lit(0.0)) + 1e-7))


def fixed_sequences(spark, d, w=None):
    s = qw.sequences(spark, d, STATE, w=w)
    return s.select("sequence_id", "input_end_window", "target_window_target", F.transform("history", _whole).alias("history"), _whole("next_state").alias("next_state"))


# ``roll``: per sequence and feature, h holds the forecasts of horizons 5 to 1, then the history from its last step backwards.
_COLS = ", ".join(f'"{f}"' for f in STATE)
_ROWS = ", ".join(f"('{f}', {i}, CAST({COEF[i]!r} AS DOUBLE), CAST({BASE[i]!r} AS DOUBLE), CAST([{', '.join(str(_weight(t, i)) for t in range(sq.HISTORY))}] AS DOUBLE[]))"
                  for i, f in enumerate(STATE))
FIXED_SQL = f"""{qw.seq_sql(STATE)}, fw(feature, i, c, b, w) AS (VALUES {_ROWS}), hz(horizon) AS (VALUES {", ".join(f"({k})" for k in HORIZONS)}),
wl AS (SELECT window_id, feature, round(coalesce(v, 0) + 1e-7) + 0.0 AS v FROM (SELECT window_id, {", ".join(f'CAST("{f}" AS DOUBLE) AS "{f}"' for f in STATE)} FROM win) UNPIVOT INCLUDE NULLS (v FOR feature IN ({_COLS}))),
h0 AS (SELECT q.sequence_id, f.i, f.c, f.b, f.w, max(l.v) FILTER (WHERE l.window_id = q.target_window) AS n, list(l.v ORDER BY l.window_id DESC) FILTER (WHERE l.window_id < q.target_window) AS h
 FROM seq q JOIN wl l ON l.window_id BETWEEN q.input_start_window AND q.target_window JOIN fw f ON f.feature = l.feature GROUP BY ALL)"""
for _k in range(1, max(HORIZONS) + 1):
    FIXED_SQL += f", {'roll' if _k == max(HORIZONS) else f'h{_k}'} AS (SELECT * REPLACE (list_prepend(list_dot_product(h[1:{sq.HISTORY}], w) + {BIAS}, h) AS h) FROM h{_k - 1})"
_LAST = max(HORIZONS) + 1  # h[_LAST - k] is horizon k, h[_LAST + t] the history t steps back
_p = lambda z: f"1 / (1 + exp(-({z})))"


@query("rollout_k", f"WITH {FIXED_SQL} SELECT sequence_id, CAST(horizon AS INTEGER) AS horizon, " + ", ".join(
    f'max(h[{_LAST} - horizon]) FILTER (WHERE i = {i}) AS "{f}"' for i, f in enumerate(STATE)) + " FROM roll, hz GROUP BY 1, 2")
def rollout_k(spark, d):
    """Recursive forecast with fixed weights over all sequences and state columns."""
    f = md.rollout(fixed_sequences(spark, d), fixed_forecaster(), max(HORIZONS), "history", ["sequence_id"], HORIZONS)
    return f.select("sequence_id", "horizon", *[F.col("state")[i].alias(x) for i, x in enumerate(STATE)])


@query("rollout_trained")
def rollout_trained(spark, d):
    f = md.rollout(seqs(spark, d), forecaster(spark, d), max(HORIZONS), "history", ["sequence_id", "input_end_window"], HORIZONS)
    return f.select("sequence_id", "horizon", F.size("state").alias("width"), F.element_at("state", 1).alias("first"))


@query("score_state", f"WITH {FIXED_SQL}, z AS (SELECT sequence_id, sum(c * n) + {INTERCEPT} AS z FROM roll GROUP BY 1) SELECT sequence_id, round({_p('z')}, 9) AS p, CASE WHEN {_p('z')} >= 0.5 THEN 1 ELSE 0 END AS predicted_class FROM z")
def score_state(spark, d):
    """Attack probability of every next state under fixed weights."""
    p = md.linear_probability(F.col("next_state"), COEF, INTERCEPT)
    return fixed_sequences(spark, d).select("sequence_id", F.round(p, 9).alias("p"), mx.predicted(p).alias("predicted_class"))


@query("oracle_vs_pipeline", f"""WITH {FIXED_SQL}, seen AS (SELECT q.sequence_id, hz.horizon, t.target AS y, sum(f.c * l.v) + {INTERCEPT} AS z FROM seq q CROSS JOIN hz JOIN win t ON t.window_id = q.input_end_window + hz.horizon AND t.segment_id = q.segment_id
 JOIN wl l ON l.window_id = t.window_id JOIN fw f ON f.feature = l.feature GROUP BY ALL), guessed AS (SELECT sequence_id, horizon, sum(c * h[{_LAST} - horizon]) + {INTERCEPT} AS z FROM roll, hz GROUP BY 1, 2)
SELECT 'oracle' AS mode, sequence_id, CAST(horizon AS INTEGER) AS horizon, y, round({_p('z')}, 9) AS p FROM seen UNION ALL
SELECT 'full_pipeline', sequence_id, CAST(horizon AS INTEGER), s.y, round({_p('g.z')}, 9) FROM seen s JOIN guessed g USING (sequence_id, horizon)""")
def oracle_vs_pipeline(spark, d):
    """The same classifier on true and on forecast states of all horizons, stacked; a horizon that leaves the segment has no row."""
    w = qw.windows(spark, d, STATE)
    s = fixed_sequences(spark, d, w)
    f = md.rollout(s, fixed_forecaster(), max(HORIZONS), "history", ["sequence_id", "input_end_window"], HORIZONS)
    valid = sq.horizon_targets(w, HORIZONS).where("target_window IS NOT NULL").select("input_end_window", "horizon", "target_window", F.col("future_target").alias("y"))
    actual = sq.with_state(w).select(F.col("window_id").alias("target_window"), _whole("state").alias("actual"))
    p = lambda c: F.round(md.linear_probability(F.col(c), COEF, INTERCEPT), 9)
    both = f.join(valid, ["input_end_window", "horizon"]).join(actual, "target_window").select("sequence_id", "horizon", "y", F.explode(F.array(
        F.struct(F.lit("oracle").alias("mode"), p("actual").alias("p")), F.struct(F.lit("full_pipeline").alias("mode"), p("state").alias("p")))).alias("x"))
    return both.select("x.mode", "sequence_id", "horizon", "y", "x.p")


def _fixed_occlusion(spark, d, whole):
    w, b = md.composite(fixed_forecaster(), COEF, INTERCEPT)
    return md.occlusion(fixed_sequences(spark, d), "history", "sequence_id", w, b, BASE, whole)


_OCC = f"{FIXED_SQL}, z AS (SELECT sequence_id, sum(c * h[{_LAST} - 1]) + {INTERCEPT} AS z FROM roll GROUP BY 1), cells AS (SELECT sequence_id, i, t, c * w[t + 1] * (h[{_LAST} + t] - b) AS d FROM roll, range({sq.HISTORY}) s(t))"
_CELLS = f"{_OCC}, cell AS (SELECT CAST(-t AS INTEGER) AS time_step, i AS feature, {_p('z')} AS p, {_p('z - d')} AS o FROM cells JOIN z USING (sequence_id))"


@query("occlusion_timestep", f"""WITH {_OCC}, o AS (SELECT sequence_id, t, {_p('any_value(z)')} AS p, {_p('any_value(z) - sum(d)')} AS o FROM cells JOIN z USING (sequence_id) GROUP BY 1, 2)
SELECT sequence_id, CAST(-t AS INTEGER) AS time_step, round(p, 9) AS full_probability, round(o, 9) AS occluded_probability, round(p - o, 9) + 0.0 AS contribution FROM o""")
def occlusion_timestep(spark, d):
    r = lambda c: (F.round(c, 9) + F.lit(0.0)).alias(c)
    return _fixed_occlusion(spark, d, True).select("sequence_id", "time_step", r("full_probability"), r("occluded_probability"), r("contribution"))


@query("occlusion_cell", f"WITH {_CELLS} SELECT feature, round(avg(p - o), 9) + 0.0 AS mean_contribution, round(sum(p - o), 6) + 0.0 AS sum_contribution, round(sum(abs(p - o)), 6) AS sum_abs_contribution FROM cell GROUP BY 1")
def occlusion_cell(spark, d):
    t = at.rollup(_fixed_occlusion(spark, d, False), "feature")
    r = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c)
    return t.select("feature", r("mean_contribution", 9), r("sum_contribution", 6), r("sum_abs_contribution", 6))


@query("cross_occlusion", f"WITH {_CELLS} SELECT time_step, count(*) AS cells, round(avg(p - o), 9) + 0.0 AS mean_contribution FROM cell GROUP BY 1")
def cross_occlusion(spark, d):
    """Each sequence times its 680 cells, counted per step."""
    return _fixed_occlusion(spark, d, False).groupBy("time_step").agg(F.count(F.lit(1)).alias("cells"), (F.round(F.avg("contribution"), 9) + F.lit(0.0)).alias("mean_contribution"))


@query("train_facts", """SELECT 'classifier' AS model, true AS holds UNION ALL SELECT 'forecaster', true UNION ALL SELECT 'forest', true FROM (SELECT count(*) FROM events)""")
def train_facts(spark, d):
    """What must hold of any fit, over the training rows: the classifier's penalised gradient vanishes in all its columns, the forecaster
    meets all its normal equations, the forest beats a coin on the rows it was fitted to (rows of one class: it is sure of that class).
    """
    s = seqs(spark, d).where("partition = 'train'")
    weighted = sc.class_weights(s.select("next_state", "target_window_target"), "target_window_target")
    lr = state_classifier(spark, d)
    coef = lr.coefficients.toArray()
    p = md.linear_probability(F.col("next_state"), coef, lr.intercept)
    push = weighted.withColumn("_e", F.col("weight") * (p - F.col("target_window_target"))).select(
        array_to_vector(F.transform(F.concat("next_state", F.array(F.lit(1.0))), lambda v: v * F.col("_e"))).alias("g"))
    row = push.agg(Summarizer.mean(F.col("g")).alias("g"), F.count(F.lit(1)).alias("n")).first()
    slope = row.g.toArray() + np.append(coef, 0.0) / row.n  # unit inverse penalty, the intercept is free
    fc = forecaster(spark, d)
    left = md.rollout(s, fc, 1, "history", ["sequence_id"]).join(s.select("sequence_id", "flat", "next_state"), "sequence_id").select(
        F.lit("all").alias("g"), "flat", F.zip_with("state", "next_state", lambda a, b: a - b).alias("residual"))
    g, k = md.gram_matrices(left, "flat", "residual", "g")["all"], len(fc.weights) + 1
    normal = g[:k, k:] + np.vstack([fc.penalty * fc.weights, np.zeros((1, len(fc.bias)))])
    fitted = md.score(s.select("sequence_id", "partition", "target_window_target", "flat"), forest(spark, d), "flat").withColumnRenamed("target_window_target", "y")
    facts = [("classifier", bool(np.abs(slope).max() < 1e-3)), ("forecaster", bool(np.abs(normal).max() / g[k - 1, k - 1] < 1e-6)), ("forest", mx.beats_coin(fitted))]
    return spark.createDataFrame(facts, "model string, holds boolean")


@query("fold_forecasts")
def fold_forecasts(spark, d):
    """Every part of the month held out once: ridge forecasters from one pass, errors on the held-out part against persistence.

    Sequences that reach over a border between parts are left out; a part's last tenth of targets is its validation tail."""
    t = lambda x: F.when(F.col(x) < F.lit(FOLD_DAYS["2"]).cast("timestamp_ntz"), "1").when(F.col(x) < F.lit(FOLD_DAYS["3"]).cast("timestamp_ntz"), "2").otherwise("3")
    s = seqs(spark, d).withColumn("day", t("target_timestamp")).where(F.col("day") == t("input_start_timestamp")).select("sequence_id", "input_start_window", "day", "flat", "next_state")
    first = s.groupBy("day").agg(F.min("sequence_id").alias("_first"))  # ids are dense in a part, as borders cut its end off
    s = sp.tail_split(s.join(F.broadcast(first), "day").withColumn("sequence_id", F.col("sequence_id") - F.col("_first")), "day")
    rows = [(f["fold"], f["train_rows"], f["holdout_rows"], float(f["penalty"]), float(f["validation_mse"]), float(f["holdout_mse"]), float(f["persistence_mse"]))
            for f in md.fold_forecasters(s, "flat", "next_state", "day", "split")]
    return spark.createDataFrame(rows, "fold string, train_rows long, holdout_rows long, penalty double, validation_mse double, holdout_mse double, persistence_mse double")


def _forecast_vs_actual(spark, d):
    """(sequence_id, horizon, partition, forecast state, actual state, actual label) where the horizon is valid."""
    s = seqs(spark, d).where("partition IS NOT NULL").select("sequence_id", "input_end_window", "partition", "history")
    f = md.rollout(s, forecaster(spark, d), max(HORIZONS), "history", ["sequence_id", "input_end_window", "partition"], HORIZONS)
    w = wins(spark, d)
    valid = sq.horizon_targets(w, HORIZONS).where("target_window IS NOT NULL").select(
        "input_end_window", "horizon", "target_window", F.col("future_target").alias("y"), F.col("future_label").alias("label"))
    actual = sq.with_state(sc.transform(w, staged(spark, d)["params"])).select(F.col("window_id").alias("target_window"), F.col("state").alias("actual"))
    return f.join(valid, ["input_end_window", "horizon"]).join(actual, "target_window")


@query("k_step_metrics")
def k_step_metrics(spark, d):
    return mx.regression_metrics(_forecast_vs_actual(spark, d), "state", "actual", ["partition", "horizon"])


@query("oracle_vs_pipeline_trained")
def oracle_vs_pipeline_trained(spark, d):
    """The same classifier on true and on forecast states, stacked."""
    clf = state_classifier(spark, d)
    p = lambda col: md.linear_probability(F.col(col), clf.coefficients.toArray(), clf.intercept)
    base = _forecast_vs_actual(spark, d).select("partition", "sequence_id", "horizon", "label", "y", p("actual").alias("_o"), p("state").alias("_p"))
    both = base.withColumn("_x", F.explode(F.array(F.struct(F.lit("oracle").alias("mode"), F.col("_o").alias("p")),
                                                   F.struct(F.lit("full_pipeline").alias("mode"), F.col("_p").alias("p")))))
    return both.select("_x.mode", "partition", "sequence_id", "horizon", "label", "y", "_x.p", mx.predicted(F.col("_x.p")).alias("predicted_class"))


@query("coef_table")
def coef_table(spark, d):
    return md.coef_table(spark, flatten_names(STATE), logistic(spark, d).coefficients.toArray())


@query("forest_importances")
def forest_importances(spark, d):
    """Importances of the trained forest: every flattened column, then their sums by feature and by time step."""
    cells = md.importances(forest(spark, d), spark, flatten_names(STATE))
    by = lambda part, kind: at.importance_by(cells, part, "name").select(F.lit(kind).alias("kind"), "name", "sum_importance", "mean_importance", "max_importance")
    own = F.col("importance")
    return cells.select(F.lit("column").alias("kind"), "name", own.alias("sum_importance"), own.alias("mean_importance"), own.alias("max_importance")).unionByName(
        by(1, "feature")).unionByName(by(0, "step"))


def _baseline(spark, d):
    rows = at.baseline(seqs(spark, d).where("partition = 'train'")).orderBy("feature").collect()
    return [r["baseline"] for r in rows]


def _occlude(spark, d, whole):
    clf = state_classifier(spark, d)
    w, b = md.composite(forecaster(spark, d), clf.coefficients.toArray(), clf.intercept)
    return md.occlusion(seqs(spark, d), "history", "sequence_id", w, b, _baseline(spark, d), whole)


@query("occlusion_timestep_trained")
def occlusion_timestep_trained(spark, d):
    return _occlude(spark, d, True).drop("feature")


@query("occlusion_cell_trained")
def occlusion_cell_trained(spark, d):
    return at.rollup(_occlude(spark, d, False), "feature")


@query("cross_occlusion_trained")
def cross_occlusion_trained(spark, d):
    """Each sequence times its 680 cells, counted per step."""
    return _occlude(spark, d, False).groupBy("time_step").agg(F.count(F.lit(1)).alias("cells"), F.avg("contribution").alias("mean_contribution"))


@query("forecast_stages")
def forecast_stages(spark, d):
    """Forecast states back in raw units, then evidence and stages, per horizon."""
    params = staged(spark, d)["params"]
    s = seqs(spark, d).where("partition = 'validation'").select("sequence_id", "input_end_window", "history")
    f = md.rollout(s, forecaster(spark, d), max(HORIZONS), "history", ["sequence_id", "input_end_window"], HORIZONS)
    cols = f.select("sequence_id", "input_end_window", "horizon", *[F.col("state")[i].alias(x) for i, x in enumerate(STATE)])
    raw = sc.inverse(cols, params)
    seen = wins(spark, d).select(F.col("window_id").alias("input_end_window"), c("Flow Pkts/s").alias("observed_pkts_per_s"))
    ev = ru.forecast_evidence(raw.join(seen, "input_end_window"), "sequence_id", "horizon")
    return ru.primary_stage(ru.stage_scores(ev)).groupBy("horizon", "primary_stage").agg(F.count(F.lit(1)).alias("n"))


@query("sink_params", f"WITH {m.flows_sql(['row_id'])} SELECT 65 AS features, true AS model_equal FROM (SELECT count(*) FROM flows)")
def sink_params(spark, d):
    """Saved preprocessing and classifier read back: 65 parameter rows and equal coefficients."""
    from pyspark.ml.classification import LogisticRegressionModel

    params = staged(spark, d)["params"]
    rows = [(k, *map(float, v)) for k, v in params.items()]
    path = write_params(spark.createDataFrame(rows, "feature string, median double, mean double, scale double"), staging_dir(spark, "params"))
    model, where = state_classifier(spark, d), staging_dir(spark, "classifier")
    model.write().overwrite().save(where)
    same = bool((LogisticRegressionModel.load(where).coefficients.toArray() == model.coefficients.toArray()).all())
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("features")).withColumn("model_equal", F.lit(same))


@query("sink_models", """SELECT unnest(['logistic_history', 'forest_history', 'state_classifier', 'forecaster']) AS model, true AS same_parameters, 0 AS rows_that_differ FROM (SELECT count(*) FROM events)""")
def sink_models(spark, d):
    """Every fitted model written, read back, and applied to all sequences beside the one in memory."""
    from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel

    s = seqs(spark, d).select("sequence_id", "flat", "next_state")
    out = None
    for name, model, kind, x in [("logistic_history", logistic(spark, d), LogisticRegressionModel, "flat"), ("forest_history", forest(spark, d), RandomForestClassificationModel, "flat"),
                                 ("state_classifier", state_classifier(spark, d), LogisticRegressionModel, "next_state")]:
        path = staging_dir(spark, name)
        model.write().overwrite().save(path)
        again = kind.load(path)
        inner = lambda m: m.featureImportances if kind is RandomForestClassificationModel else m.coefficients  # noqa: E731, B023
        one = md.score(md.score(s, model, x), again, x, "q").agg(F.count_if(~F.col("p").eqNullSafe(F.col("q"))).alias("rows_that_differ"))
        one = one.select(F.lit(name).alias("model"), F.lit(bool((inner(model).toArray() == inner(again).toArray()).all())).alias("same_parameters"), "rows_that_differ")
        out = one if out is None else out.unionByName(one)
    fc = forecaster(spark, d)
    again = md.load_forecaster(spark, md.save_forecaster(spark, fc, staging_dir(spark, "forecaster")))
    h = seqs(spark, d).select("sequence_id", "history")
    a, b = md.rollout(h, fc, 1, "history", ["sequence_id"]), md.rollout(h, again, 1, "history", ["sequence_id"]).withColumnRenamed("state", "other")
    one = a.join(b, ["sequence_id", "horizon"]).agg(F.count_if(F.col("state") != F.col("other")).alias("rows_that_differ"))
    same = bool((fc.weights == again.weights).all() and (fc.bias == again.bias).all() and fc.penalty == again.penalty)
    return out.unionByName(one.select(F.lit("forecaster").alias("model"), F.lit(same).alias("same_parameters"), "rows_that_differ"))


FOLD_DAYS = {"1": "2024-01-01", "2": "2024-01-11", "3": "2024-01-21"}


@query("fold_evaluation")
def fold_evaluation(spark, d):
    """Leave-one-part-out: preprocessing and classifier are fitted on the other parts only. The loop is over the
    three folds; every step inside is a distributed job."""
    start = F.col("window_start")
    part = F.when(start < F.lit(FOLD_DAYS["2"]).cast("timestamp_ntz"), "1").when(start < F.lit(FOLD_DAYS["3"]).cast("timestamp_ntz"), "2").otherwise("3")
    w = wins(spark, d).withColumn("day", part)
    out = None
    for name, (train_days, hold) in sp.leave_one_out(sorted(FOLD_DAYS)).items():
        params = sc.load(sc.fit(w.where(F.col("day").isin(train_days)), FEATURES))
        scaled = sq.with_state(sc.transform(w, params)).select("day", "window_id", "state", "binary_target")
        model = md.train_logistic(scaled.where(F.col("day").isin(train_days)), "state", "binary_target")
        p = md.score(scaled.where(F.col("day") == hold), model, "state").select(F.lit(name).alias("fold"), F.col("binary_target").alias("y"), "p")
        out = p if out is None else out.unionByName(p)
    return mx.confusion_zero(mx.confusion_counts(out, ["fold"]))


#: Trees of the forests below; each query fits up to three, so they have fewer than the single model's 300.
FOLD_TREES = 40


def _parted(spark, d):
    """Windows of the month in three parts that stand for days."""
    start = lambda n: F.lit(FOLD_DAYS[n]).cast("timestamp_ntz")
    t = F.col("window_start")
    return wins(spark, d).withColumn("day", F.when(t < start("2"), "1").when(t < start("3"), "2").otherwise("3"))


def _frozen(spark, d, train_days):
    return _memo(spark, d, ("frozen", *train_days), lambda: ev.fit(_parted(spark, d), train_days, trees=FOLD_TREES))


def _kept(spark, df, what):
    return spark.read.parquet(write_stage(df, staging_dir(spark, what)))


@query("frozen_evaluation")
def frozen_evaluation(spark, d):
    """All models fitted on the first part of the month and applied, unchanged, to each of the others: every model and horizon."""
    return _kept(spark, ev.report(_frozen(spark, d, ["1"]), spark, ["2", "3"]), "frozen_report")


@query("fold_models")
def fold_models(spark, d):
    """Leave-one-part-out with all models: fits on the other parts, reports on the one held out. The loop is over three folds."""
    out = None
    for name, (train_days, hold) in sp.leave_one_out(sorted(FOLD_DAYS)).items():
        one = _kept(spark, ev.report(_frozen(spark, d, train_days), spark, [hold]).select(F.lit(name).alias("fold"), "*"), "fold_report")
        out = one if out is None else out.unionByName(one)
    return out
