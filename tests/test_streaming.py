"""Streams under disorder and lateness against their batch forms."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowloom.operators import flows as fl
from flowloom.operators import sequences as sq
from flowloom.operators import windows as wn
from flowloom.sources.tables import staging_dir
from flowloom.streaming import jobs, stateful


def batches(spark, parts, schema):
    """A stream whose micro-batches are ``parts`` in this order: one file each, written one after the other."""
    base = staging_dir(spark, "arrivals")
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(base)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base)


def window_rows(times):
    return [(f"d{k}", datetime(2024, 1, 1) + timedelta(seconds=600 * t), [float(t), None if t % 4 == 0 else t / 2]) for k in (1, 2) for t in times]


WINDOWS = "day string, window_start timestamp_ntz, state array<double>"


def batch_sequences(spark, rows):
    df = spark.createDataFrame(rows, WINDOWS).withColumns({"observation_count": F.lit(1)})
    out = sq.sliding_sequences(wn.index_windows(df, 600, ["day"]), ["day"], labeled=False)
    return out.select("day", *[F.unix_timestamp(F.col(x).cast("timestamp")).alias(x) for x in ("input_start_timestamp", "input_end_timestamp", "target_timestamp")], "history", "next_state")


def plain(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("seed", [0])
def test_sequences_in_any_order(spark, seed):
    rnd = random.Random(seed)
    times = [*range(0, 14), *range(16, 30), *range(31, 33)]
    # late by at most five windows: well inside the delay of ten
    order = sorted(times, key=lambda t: t + rnd.uniform(0, 5))
    rows = [(r, i) for i, t in enumerate(order) for r in window_rows([t])]
    parts = [[r for r, i in rows if i // 8 == b] for b in range(-(-len(order) // 8))]
    end = [("end", datetime(2024, 2, 1), [0.0, 0.0])]  # lets the watermark pass everything
    stream = batches(spark, [*parts, end], WINDOWS)
    got = jobs.run_available(jobs.sequences(stream, "day", 600, delay="100 minutes"), "sequences")
    want = batch_sequences(spark, window_rows(times))
    assert len(plain(got)) == 2 * (4 + 4) and plain(got) == plain(want)


def test_one_late_window(spark):
    rows = [window_rows(t) for t in ((0, 1, 2, 4), (3, 5), (6, 7, 8, 9, 10, 11))]
    stream = batches(spark, [*rows, [("end", datetime(2024, 2, 1), [0.0, 0.0])]], WINDOWS)
    got = jobs.run_available(jobs.sequences(stream, "day", 600), "sequences")
    assert plain(got) == plain(batch_sequences(spark, window_rows(range(12))))


class Kept(dict):
    """State of one key without an engine, for the bookkeeping of buckets."""

    def containsKey(self, k):  # noqa: N802
        return k in self

    def getValue(self, k):  # noqa: N802
        self.read = getattr(self, "read", 0) + 1
        return self[k]

    def updateValue(self, k, v):  # noqa: N802
        self.written = getattr(self, "written", 0) + len(v[0]) if isinstance(v[0], list) else 0
        self[k] = v

    def removeKey(self, k):  # noqa: N802
        del self[k]


def test_arrivals_write_what_is_new():
    p = stateful.Flows(10_000_000, 120_000_000, [])
    p.rows, p.arrivals = Kept(), Kept()
    p.handle = type("Timers", (), {"registerTimer": lambda self, t: None})()
    for n in range(20):
        part = pd.DataFrame({"timestamp_us": [n * 1000], "index": [n], "side": [0], "ip_total_len": [1], "rst": [False], "fin": [False]})
        list(p.handleInputRows(("k",), iter([part]), None))
    assert p.rows.written == 20 and getattr(p.rows, "read", 0) == 0 and len(p._waiting(0)) == 20 and not p.rows


def test_late_rows_are_counted(spark):
    base = datetime(2024, 1, 1)
    rows = lambda minutes: [(base + timedelta(minutes=m), "Benign", 80 + m % 3) for m in minutes]
    schema = "timestamp timestamp_ntz, label string, dst_port int"
    first, second = rows([1, 2, 3, 11, 12, 31]), rows([4, 5, 15, 32, 55])
    parts = [spark.createDataFrame(x, schema) for x in (first, second)]
    out, folder = jobs.run_arrivals(parts, lambda s: jobs.window_aggregates(s, "10 minutes", []), "late")
    # after the first run the watermark is 00:30:30, so 4, 5 and 15 are late; after the second 00:54:30
    assert jobs.window_accounts(out, folder).collect() == [(11, 7, 1, 3)]
    assert {(r.window_start.minute, r.observation_count, r.dst_port_nunique) for r in out.collect()} == {(0, 3, 3), (10, 2, 2), (30, 2, 2)}


def test_flows_in_any_order_with_buckets(spark):
    rnd = random.Random(5)
    packets = []
    for i in range(400):
        t = i * 3_000_000 + rnd.randrange(1000) + (150_000_000 if i > 200 else 0)
        flags = rnd.choice([16, 16, 16, 17, 20])
        a, b = (("10.0.0.1", 1000 + i % 2), ("10.0.0.2", 80))
        (s, sp), (d, dp) = (a, b) if rnd.random() < 0.5 else (b, a)
        packets.append(("c", i, t, s, d, sp, dp, 6, 40, 20, 20, 0, flags, 100))
    schema = ("capture string, index long, timestamp_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, ip_total_len int, "
              "ip_header_len int, transport_header_len int, payload_len int, tcp_flags int, tcp_window int")
    order = sorted(packets, key=lambda p: p[2] + rnd.randrange(100_000_000))
    parts = [order[i:i + 100] for i in range(0, 400, 100)]
    end = [("c", 10**6, 10**11, "9.9.9.9", "9.9.9.8", 1, 2, 6, 40, 20, 20, 0, 16, 1)]
    got = jobs.run_available(jobs.flows(batches(spark, [*parts, end], schema)), "flows")
    table = fl.flow_features(fl.label_packets(spark.createDataFrame(packets, schema)))
    want = table.select("a_port", "b_port", "start_us", "first_index", "end_us", (F.col("`Tot Fwd Pkts`") + F.col("`Tot Bwd Pkts`")).alias("packets"),
                        F.when(F.col("closed_reason") == "end_of_capture", "timeout").otherwise(F.col("closed_reason")).alias("closed_reason"))
    assert plain(got.select("a_port", "b_port", "start_us", "first_index", "end_us", "packets", "closed_reason")) == plain(want)
