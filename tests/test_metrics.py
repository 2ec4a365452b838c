"""Exact percentiles, ranks and metrics against direct numpy, including forced multi-range execution."""

import numpy as np
import pytest

from flowloom.functions.ordering import exact_percentiles, value_cdf
from flowloom.operators import metrics as mx
from flowloom.operators import profiling as pf
from flowloom.operators import rules as ru
from flowloom.operators import scaling as sc
from flowloom.operators import triage as tr


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(900) ** 3, 3)
    p[:300] = 0.5  # a third of all rows share one score
    y = (rng.random(900) < 0.3 + 0.4 * p).astype(int)
    g = np.where(np.arange(900) % 3 == 0, "a", "b")
    return p, y, g, spark.createDataFrame([(str(a), int(b), float(c)) for a, b, c in zip(g, y, p)], "g string, y int, p double").repartition(4)


@pytest.mark.parametrize("kw", [{}, {"per_range": 3}])
def test_percentiles(scored, kw):
    p, y, g, df = scored
    got = {r["g"]: r for r in exact_percentiles(df, "p", {"q1": 0.1, "q5": 0.5, "q95": 0.95}, "g", **kw).collect()}
    for k in "ab":
        assert [got[k][c] for c in ("q1", "q5", "q95")] == pytest.approx(list(np.percentile(p[g == k], [10, 50, 95])))
    one = exact_percentiles(df, "p", {"m": 0.5}, **kw).first()["m"]
    assert one == pytest.approx(np.median(p))
    cdf = value_cdf(df, "p", **kw).collect()
    assert sum(r["n"] for r in cdf) == 900 and all(r["below"] == int((p < r["p"]).sum()) for r in cdf)


@pytest.mark.parametrize("kw", [{}, {"per_range": 3}])
def test_ranking(scored, kw):
    p, y, _, df = scored
    r = mx.ranking(df, **kw).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        rec = (pos >= t).mean()
        ap += (rec - last) * (y[p >= t].mean())
        last = rec
    assert r["roc_auc"] == pytest.approx(auc) and r["pr_auc"] == pytest.approx(ap)


def test_confusion_edges(spark):
    df = spark.createDataFrame([("none", 0, 0.1), ("none", 0, 0.2), ("all", 1, 0.5), ("all", 1, 1.0)], "g string, y int, p double")
    n = mx.confusion_counts(df, ["g"])
    strict = {r["g"]: r for r in mx.confusion_metrics(n).collect()}
    assert strict["none"]["precision"] is None and strict["none"]["precision_undefined_reason"] and strict["none"]["f1"] is None
    assert strict["all"]["tp"] == 2 and strict["all"]["fpr"] is None
    zero = {r["g"]: r for r in mx.confusion_zero(n).collect()}
    assert zero["none"]["f1"] == 0.0 and zero["none"]["degenerate"] and zero["all"]["fpr"] is None
    held = {r["g"]: r for r in mx.confusion_withheld(n).collect()}
    assert held["all"]["recall"] is None and held["none"]["withheld"]


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1, 1, 0.3), (1, 0, 1.0), (1, 0, 0.0)], "horizon int, y int, p double")
    got = {r["bin"]: r["n"] for r in mx.calibration_bins(df, "horizon").collect()}
    hist, _ = np.histogram([0.3, 1.0, 0.0], np.linspace(0, 1, 11))
    assert [got[i] for i in range(10)] == list(hist) and len(got) == 10


def test_fit_matches_numpy(spark):
    x = np.array([1.0, 2.0, 3.0, 10.0, np.nan])
    df = spark.createDataFrame([(None if np.isnan(v) else float(v), 4.0) for v in x], "a double, b double")
    p = {r["feature"]: r for r in sc.fit(df, ["a", "b"]).collect()}
    full = np.where(np.isnan(x), np.nanmedian(x), x)
    assert (p["a"]["median"], p["a"]["mean"], p["a"]["std"]) == pytest.approx((2.5, full.mean(), full.std()))
    assert p["b"]["std"] == 0 and p["b"]["scale"] == 1.0
    params = sc.load(sc.fit(df, ["a", "b"]))
    back = sc.inverse(sc.transform(df, params), params).collect()
    assert [r["a"] for r in back] == pytest.approx(list(full))


def test_pairs_match_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.random(200) * 1e6
    cols = {"a": a, "b": a * 2 + 1, "c": rng.random(200), "d": np.full(200, 3.0)}
    rows = [tuple(float(v[i]) for v in cols.values()) for i in range(200)]
    rows[3] = (float("nan"), 1.0, float("inf"), 3.0)
    got = pf.correlated_pairs(spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3), list(cols)).collect()
    assert [(r["column_a"], r["column_b"]) for r in got] == [("a", "b")] and got[0]["correlation"] == pytest.approx(1.0)


def _evidence(spark, **kw):
    schema = ", ".join(f"{x} double" for x in ru.EVIDENCE)
    return spark.createDataFrame([tuple(float(kw[x]) if x in kw else None for x in ru.EVIDENCE)], schema)


def test_rules(spark):
    r = ru.primary_stage(ru.stage_scores(_evidence(spark))).first()
    assert r["fired"] == [] and r["primary_stage"] == ru.UNKNOWN
    top = dict(dst_port_nunique=500, flow_duration_mean_us=1, observation_count=100, avg_bytes_per_flow=1, flow_iat_coefficient_of_variation=0.0,
               tot_fwd_pkts=100, tot_bwd_pkts=100, flow_byts_per_s=1e7, flow_pkts_per_s=1e4, outbound_inbound_byte_ratio=1000,
               traffic_growth_pct=500, connection_frequency=100, syn_flag_cnt=50, ack_flag_cnt=1)
    r = ru.primary_stage(ru.stage_scores(_evidence(spark, **top))).first()
    assert (r["discovery_score"], r["command_and_control_score"], r["exfiltration_score"], r["impact_score"]) == (85, 60, 75, 80)
    assert (r["reconnaissance_score"], r["initial_access_score"], r["lateral_movement_score"]) == (45, 40, 0)
    assert r["primary_stage"] == "Discovery" and len(r["fired"]) == 11
    edge = ru.primary_stage(ru.stage_scores(_evidence(spark, flow_byts_per_s=500000))).first()
    assert edge["exfiltration_score"] == 40 and edge["impact_score"] == 30 and edge["primary_stage"] == "Exfiltration"


@pytest.mark.parametrize("p,stage,score,want", [
    ((None, None, None, None), None, None, "MONITOR"), ((0.7, None, None, 0.7), None, None, "ESCALATE"),
    ((0.6, None, None, 0.5), "Impact", 70.0, "ESCALATE"), ((0.53, 0.53, None, None), "Discovery", 40.0, "ALERT"),
    ((0.56, None, None, 0.6), "Impact", 65.0, "TEMPORARY_BLOCK"), ((0.56, None, None, 0.56), "Reconnaissance", 45.0, "ALERT")])
def test_triage(spark, p, stage, score, want):
    status = {"Reconnaissance": "candidate"}.get(stage, "mapped") if stage else None
    df = spark.createDataFrame([(*p, stage, score, status)], "p1 double, p2 double, p3 double, p5 double, stage string, stage_score double, stage_status string")
    assert tr.triage(df).first()["level"] == want
