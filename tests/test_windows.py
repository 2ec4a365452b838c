"""Windows, segments, sequences, splits on small hand-made tables, with tiny cells and chunks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import sequences as sq
from flowloom.operators import splits as sp
from flowloom.operators import windows as wn

T0 = dt.datetime(2024, 1, 1)


def window_frame(spark, seconds):
    rows = [(T0 + dt.timedelta(seconds=s), float(s), s % 2, "x") for s in seconds]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "window_start timestamp_ntz, v double, target int, label string")
    return df.withColumn("state", F.array("v", -F.col("v")))


SECONDS = list(range(0, 10)) + list(range(12, 23)) + list(range(25, 37)) + [40] + list(range(50, 90))


@pytest.mark.parametrize("cell", [3, 7, 4096])
def test_segments_and_sequences(spark, cell):
    w = wn.index_windows(window_frame(spark, SECONDS), 1, rows_per_cell=cell)
    got = {r["v"]: (r["window_id"], r["segment_id"]) for r in w.collect()}
    seg, want = 0, {}
    for i, s in enumerate(SECONDS):
        if i and s - SECONDS[i - 1] > 1:
            seg += 1
        want[float(s)] = (i, seg)
    assert got == want
    seqs = sq.sliding_sequences(w, chunk=cell).orderBy("sequence_id").collect()
    expect = []
    for i in range(len(SECONDS) - 10):
        run = SECONDS[i:i + 11]
        if run[-1] - run[0] == 10:
            expect.append((i, run))
    assert len(seqs) == len(expect) == 1 + 2 + 30
    for k, (r, (i, run)) in enumerate(zip(seqs, expect)):
        assert (r["sequence_id"], r["input_start_window"], r["target_window"]) == (k, i, i + 10)
        assert [h[0] for h in r["history"]] == run[:10] and r["next_state"] == [run[10], -run[10]]
    g = wn.gap_summary(w, 1).first()
    assert (g["windows"], g["segments"], g["gaps"], g["largest_gap_s"]) == (len(SECONDS), 5, 4, 10)


@pytest.mark.parametrize("chunk", [2, 8192])
def test_horizons_and_growth(spark, chunk):
    w = wn.index_windows(window_frame(spark, SECONDS), 1)
    h = {(r["input_end_window"], r["horizon"]): r["target_window"] for r in sq.horizon_targets(w, [1, 5], chunk=chunk).collect()}
    assert h[(0, 5)] == 5 and h[(9, 1)] is None and h[(5, 5)] is None
    g = {r["window_id"]: r["growth_baseline"] for r in sq.growth_baseline(w, "v", chunk=chunk).collect()}
    assert g[0] is None and g[10] is None and g[3] == 1.0 and g[9] == 6.0


def test_null_policy(spark):
    rows = [(T0, None, None, "Benign"), (T0, None, 3.0, "Infilteration"), (T0 + dt.timedelta(seconds=5), 2.0, None, "Benign")]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, `Tot Fwd Pkts` double, `Flow Duration` double, label string")
    r = wn.window_features(df, "1 second", columns=["Tot Fwd Pkts", "Flow Duration"]).orderBy("window_start").collect()
    assert r[0]["Tot Fwd Pkts"] is None and r[0]["Flow Duration"] == 3.0 and r[1]["Tot Fwd Pkts"] == 2.0 and r[1]["Flow Duration"] is None
    with pytest.raises(ValueError):
        wn.aggregation_policy(["no such column"])


def test_dominant_label_tie(spark):
    rows = [(T0, x) for x in ("b", "a", "b", "a", "Benign", "Benign", "Benign")] + [(T0 + dt.timedelta(seconds=9), "Benign")]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, label string")
    got = [r["dominant_label"] for r in wn.dominant_labels(df, "1 second").orderBy("window_start").collect()]
    assert got == ["a", "Benign"]


def test_tail_split(spark):
    starts = [5, 1, 3, 4, 2, 0, 9, 8, 7, 6]
    df = spark.createDataFrame([("d", s, s) for s in starts] + [("one", 0, 0)], "day string, sequence_id long, input_start_window long")
    got = {r["input_start_window"] for r in sp.tail_split(df, "day", 0.2).where("split = 'validation' AND day = 'd'").collect()}
    assert got == {8, 9}
    assert sp.tail_split(df, "day", 0.2).where("day = 'one'").first()["split"] == "train"


def test_leave_one_out():
    assert sp.leave_one_out(["a", "b"]) == {"hold_a": (["b"], "a"), "hold_b": (["a"], "b")}
