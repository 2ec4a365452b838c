"""Models frozen on some days: nothing of the other days enters the fit, and the report equals plain numpy."""

import datetime as dt

import numpy as np
import pytest

from flowloom.operators import evaluation as ev
from flowloom.operators import models as md
from flowloom.schema import FEATURES, HORIZONS, STATE

SEGMENTS = {"a": [0] * 60, "b": [0] * 40 + [1] * 25, "c": [0] * 12 + [1] * 5}


def _windows(spark, shift=0.0):
    r = np.random.default_rng(5)
    rows, wid, seg0 = [], 0, 0
    for n, (day, segments) in enumerate(SEGMENTS.items()):
        for i, seg in enumerate(segments):
            v = (r.normal(size=len(STATE)) + (i % 3) + (shift if day != "a" else 0.0)).tolist()
            if i % 11 == 4:
                v[3] = None
            rows.append((day, wid, seg0 + seg, dt.datetime(2024, 1, 1 + n) + dt.timedelta(minutes=10 * i), int(i % 3 == 0), "x", *v))
            wid += 1
        seg0 += max(segments) + 1
    cols = ", ".join(f"`{x}` double" for x in STATE)
    return spark.createDataFrame(rows, f"day string, window_id long, segment_id long, window_start timestamp_ntz, binary_target int, label string, {cols}")


@pytest.fixture(scope="module")
def frozen(spark):
    return ev.fit(_windows(spark), ["a"], trees=5, depth=4)


def test_held_out_days_do_not_enter(spark, frozen):
    other = ev.fit(_windows(spark, shift=50.0), ["a"], trees=5, depth=4)
    assert other.params == frozen.params
    assert np.allclose(other.forecaster.weights, frozen.forecaster.weights) and other.forecaster.penalty == frozen.forecaster.penalty
    assert np.allclose(other.state_classifier.coefficients.toArray(), frozen.state_classifier.coefficients.toArray())


def test_report(spark, frozen):
    got = {(r["day"], r["model"], r["horizon"]): r for r in ev.report(frozen, spark, ["b", "c"]).collect()}
    windows = {}
    for r in _windows(spark).collect():
        s = [(frozen.params[x][0] if r[x] is None else r[x]) for x in FEATURES]
        s = [(v - frozen.params[x][1]) / frozen.params[x][2] for v, x in zip(s, FEATURES)] + [r[x] for x in STATE[len(FEATURES):]]
        windows[r["window_id"]] = (r["day"], r["segment_id"], np.array(s), r["binary_target"])
    clf, fc = frozen.state_classifier, frozen.forecaster
    prob = lambda x: 1 / (1 + np.exp(-(x @ clf.coefficients.toArray() + clf.intercept)))
    want: dict = {}
    for wid, (day, seg, _, _) in windows.items():
        ids = range(wid - 9, wid + 2)
        if day == "a" or any(i not in windows or windows[i][:2] != (day, seg) for i in ids):
            continue
        h = np.concatenate([windows[i][2] for i in list(ids)[:10]])
        for k in range(1, max(HORIZONS) + 1):
            nxt = h @ fc.weights + fc.bias
            h = np.concatenate([h[len(STATE):], nxt])
            t = windows.get(wid + k)
            if k in HORIZONS and t is not None and t[:2] == (day, seg):
                want.setdefault((day, k), []).append((prob(nxt), prob(t[2]), t[3], ((nxt - t[2]) ** 2).mean(), np.abs(nxt - t[2]).mean()))
    assert {k for k in got if k[1] == "state_pipeline"} == {(d, "state_pipeline", k) for d, k in want}
    assert ("c", 3) not in want or len(want["c", 3]) < len(want["c", 1])
    for (day, k), rows in want.items():
        p, o, y, mse, mae = (np.array(v) for v in zip(*rows))
        one, true = got[day, "state_pipeline", k], got[day, "state_oracle", k]
        assert one["n"] == len(y) and one["tp"] == int(((p >= 0.5) & (y == 1)).sum()) and one["fp"] == int(((p >= 0.5) & (y == 0)).sum())
        assert true["tp"] == int(((o >= 0.5) & (y == 1)).sum()) and true["mse"] is None
        assert one["mse"] == pytest.approx(mse.mean()) and one["mae"] == pytest.approx(mae.mean())
        assert one["median_abs_error"] == pytest.approx(np.percentile(mae, 50)) and one["p95_abs_error"] == pytest.approx(np.percentile(mae, 95))
    for model in ("logistic_history", "forest_history"):
        assert got["b", model, 1]["n"] == len(want["b", 1]) and ("b", model, 2) not in got


def test_forecaster_round_trip(spark, frozen, tmp_path):
    again = md.load_forecaster(spark, md.save_forecaster(spark, frozen.forecaster, str(tmp_path / "f")))
    assert (again.weights == frozen.forecaster.weights).all() and (again.bias == frozen.forecaster.bias).all()
    assert (again.penalty, again.validation_mse) == (frozen.forecaster.penalty, frozen.forecaster.validation_mse)


def test_importances(spark, frozen):
    names = [f"t-{9 - t}__{x}" for t in range(10) for x in STATE]
    rows = md.importances(frozen.forest, spark, names).collect()
    assert len(rows) == 680 and sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
