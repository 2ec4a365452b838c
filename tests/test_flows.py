"""Flow rebuilding against a direct fold, with and without slices, and golden rows."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import flows as fl
from flowloom.schema import PACKET_SCHEMA


def fold(rows, timeout):
    """Plain sequential statement of the rule; used on small random captures only."""
    flows, open_ = [], {}
    for r in sorted(rows, key=lambda r: (r["timestamp_us"], r["index"])):
        a, b = (r["src_ip"], r["src_port"]), (r["dst_ip"], r["dst_port"])
        key = (min(a, b), max(a, b), r["protocol"])
        cur = open_.get(key)
        if cur and r["timestamp_us"] - cur["end"] > timeout:
            cur["reason"] = "timeout"
            cur = None
        if cur is None:
            cur = open_[key] = dict(start=r["timestamp_us"], ix=r["index"], src=a, fins=set(), n=0, fwd=0, reason="end_of_capture")
            flows.append(cur)
        cur["end"], cur["n"], cur["fwd"] = r["timestamp_us"], cur["n"] + 1, cur["fwd"] + (a == cur["src"])
        fl_ = r["tcp_flags"]
        if fl_ is not None and fl_ & 4:
            cur["reason"] = "tcp_rst"
            del open_[key]
        elif fl_ is not None and fl_ & 1:
            cur["fins"].add(a == cur["src"])
            if len(cur["fins"]) == 2:
                cur["reason"] = "tcp_fin_both"
                del open_[key]
    return sorted((f["start"], f["ix"], f["end"], f["n"], f["fwd"], f["reason"]) for f in flows)


def capture(seed, n, keys=2):
    rnd = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += rnd.choice([0, 10, 1_000_000, 6_000_000, 130_000_000 if rnd.random() < 0.2 else 3])
        k = rnd.randrange(keys)
        ends = [("10.0.0.1", 1000 + k), ("9.0.0.2", 80)]
        if rnd.random() < 0.5:
            ends.reverse()
        if k == 1 and rnd.random() < 0.1:
            ends = [ends[0], ends[0]]
        flags = rnd.choice([16, 16, 17, 17, 17, 2, 20 if rnd.random() < 0.3 else 24])
        rows.append(dict(capture="c", index=i, timestamp_us=t, src_ip=ends[0][0], src_port=ends[0][1], dst_ip=ends[1][0],
                         dst_port=ends[1][1], protocol=6, ip_total_len=40 + i % 7, ip_header_len=20, transport_header_len=20,
                         payload_len=i % 7, tcp_flags=flags, tcp_window=100 + i))
    return rows


def as_df(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in PACKET_SCHEMA) for r in rows], PACKET_SCHEMA)


@pytest.mark.parametrize("kw", [{}, {"slices": 40}, {"slices": 3}])
@pytest.mark.parametrize("seed", [1, 2])
def test_flows_match_fold(spark, seed, kw):
    rows = capture(seed, 260)
    random.Random(seed).shuffle(rows)
    got = fl.flow_table(as_df(spark, rows).repartition(3), **kw).select(
        "start_us", "first_index", "end_us", F.expr("`Tot Fwd Pkts` + `Tot Bwd Pkts`"), "`Tot Fwd Pkts`", "closed_reason", "flow_id").collect()
    assert sorted(tuple(r)[:6] for r in got) == fold(rows, fl.TIMEOUT_US)
    assert [r["flow_id"] for r in sorted(got, key=lambda r: (r[0], r[1]))] == list(range(len(got)))


def test_sliced_features_equal_unsliced(spark):
    df = as_df(spark, capture(7, 200, keys=1))
    a = fl.flow_table(df)
    b = fl.flow_table(df, slices=25)
    ra, rb = a.orderBy("flow_id").collect(), b.select(*a.columns).orderBy("flow_id").collect()
    assert len(ra) == len(rb)
    for x, y in zip(ra, rb):
        for p, q in zip(x, y):
            assert p == q or p == pytest.approx(q, nan_ok=True), (x, y)


def packet(i, t, fwd=True, length=100, proto=6, hdr=20, flags=16):
    a, b = ("10.0.0.1", 1000), ("10.0.0.2", 80)
    s, d = (a, b) if fwd else (b, a)
    return dict(capture="g", index=i, timestamp_us=t, src_ip=s[0], src_port=s[1], dst_ip=d[0], dst_port=d[1], protocol=proto,
                ip_total_len=length, ip_header_len=20, transport_header_len=hdr, payload_len=0, tcp_flags=flags if proto == 6 else None,
                tcp_window=512 if proto == 6 else None)


def test_rate_conventions(spark):
    one = fl.flow_table(as_df(spark, [packet(0, 5, length=0)])).first()
    assert str(one["Flow Byts/s"]) == "nan" and one["Flow Pkts/s"] == float("inf") and one["Fwd Pkts/s"] == 0.0
    two = fl.flow_table(as_df(spark, [packet(0, 5, length=800)])).first()
    assert two["Flow Byts/s"] == float("inf") and two["Bwd Pkts/s"] == 0.0
    r = fl.flow_table(as_df(spark, [packet(0, 0, True, 100), packet(1, 2_000_000, False, 200)])).first()
    assert (r["Flow Byts/s"], r["Flow Pkts/s"], r["Fwd Pkts/s"], r["Bwd Pkts/s"]) == (150.0, 1.0, 0.5, 0.5)


@pytest.mark.parametrize("headers,want", [((20, 20), 20), ((32, 20), 20), ((40, 40), 40)])
def test_smallest_header(spark, headers, want):
    rows = [packet(i, i, hdr=h) for i, h in enumerate(headers)]
    assert fl.flow_table(as_df(spark, rows)).first()["Fwd Seg Size Min"] == want


def test_udp_and_bursts(spark):
    rows = [packet(0, 0, proto=17, hdr=8), packet(1, 1_000_000, False, proto=17, hdr=8), packet(2, 7_000_000, proto=17, hdr=8),
            packet(3, 7_500_000, False, proto=17, hdr=8)]
    r = fl.flow_table(as_df(spark, rows)).first()
    assert r["closed_reason"] == "end_of_capture" and r["Fwd Seg Size Min"] == 8
    assert (r["Tot Fwd Pkts"], r["Tot Bwd Pkts"], r["Init Fwd Win Byts"], r["Init Bwd Win Byts"]) == (2, 2, -1, -1)
    assert (r["Idle Max"], r["Idle Min"], r["Active Max"], r["Active Min"]) == (6_000_000, 6_000_000, 1_000_000, 500_000)
    assert r["Active Mean"] == 750_000.0 and r["Active Std"] == 250_000.0 and r["Fwd IAT Tot"] == 7_000_000


def test_unassigned_and_contract(spark):
    rows = [packet(0, 0), {**packet(1, 1), "src_port": None, "dst_port": None, "protocol": 1}]
    df = as_df(spark, rows)
    assert fl.unassigned(df).collect()[0]["reason"] == "Packet has no usable src/dst port for protocol=1."
    assert fl.missing_packet_fields(df) == [] and fl.missing_packet_fields(df.drop("tcp_flags")) == ["tcp_flags"]
    table = fl.clean_flow_columns(fl.flow_table(df))
    assert fl.contract_rejections(table).first()["accepted"]
    bad = table.withColumn("Label", F.lit("x")).withColumn("Protocol", F.lit(999)).drop("Idle Max").withColumn("Idle Min", F.lit("many"))
    got = fl.contract_rejections(bad).first()
    assert got["reasons"].split(",") == ["missing_required_column", "unsupported_protocol_other",
                                          "label_column_present_and_required_absent", "feature_value_type_mismatch"]


def test_stream_does_not_depend_on_arrival(spark, tmp_path):
    """Packets up to a minute out of order, in many micro-batches, give the flows of the plain fold."""
    from flowloom.streaming import jobs

    rows = capture(3, 150)
    rnd = random.Random(5)
    arrival = sorted(rows, key=lambda r: r["timestamp_us"] + rnd.randrange(60_000_000))
    for i in range(5):
        as_df(spark, arrival[i * 30:(i + 1) * 30]).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(PACKET_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = jobs.run_available(jobs.flows(stream), "flow_test").select("start_us", "first_index", "end_us", "packets", "closed_reason").collect()
    passed = max(r["timestamp_us"] for r in rows) // 1000 - 130_000
    want = []
    for start, ix, end, n, _, reason in fold(rows, fl.TIMEOUT_US):
        reason = "timeout" if reason == "end_of_capture" else reason
        if (end + (fl.TIMEOUT_US if reason == "timeout" else 0)) // 1000 < passed:
            want.append((start, ix, end, n, reason))
    assert sorted(map(tuple, got)) == want and len(want) > 20


def test_one_busy_second_is_many_tasks(spark):
    """One pair, everything within a second and no break: every slice depends on all slices before it."""
    r = random.Random(3)
    rows = [packet(i, 10**6 + i * 2, r.random() < 0.6, flags=r.choice([16, 16, 16, 16, 17])) for i in range(5000)]
    cut = fl.label_packets(as_df(spark, rows), slices=16)
    whole = fl.label_packets(as_df(spark, rows), slices=1)
    order = lambda df: sorted(tuple(map(str, x)) for x in df.collect())
    assert order(cut) == order(whole)
    assert sorted(tuple(x)[:6] for x in fl.flow_table(as_df(spark, rows), slices=16).select(
        "start_us", "first_index", "end_us", F.expr("`Tot Fwd Pkts` + `Tot Bwd Pkts`"), "`Tot Fwd Pkts`", "closed_reason").collect()) == fold(rows, fl.TIMEOUT_US)


def test_numbers_of_tied_and_grouped_rows(spark):
    from flowloom.functions.ordering import number_rows

    rows = [(g, t, i) for i, (g, t) in enumerate([("a", 1)] * 50 + [("b", 2)] * 30 + [(None, 3)] * 4 + [("a", 0)])]
    got = number_rows(spark.createDataFrame(rows, "g string, t int, i int"), "n", ["t", "i"], ["g"]).collect()
    for g in ("a", "b", None):
        mine = sorted((r.t, r.i, r.n) for r in got if r.g == g)
        assert [n for *_, n in mine] == list(range(len(mine)))


@pytest.mark.parametrize("slice_rows", [7, 64, 10**6])
def test_interval_join_of_a_hot_port(spark, slice_rows):
    from flowloom.operators import matching as mt

    r = random.Random(8)

    def side(n):
        return [(i, 6 if r.random() < 0.8 else 17, 443 if r.random() < 0.8 else r.randrange(3), r.randrange(40) * 500_000, r.randrange(3) * 10**6, 1, r.randrange(2), 5, 0) for i in range(n)]

    a, b = side(120), side(150)
    make = lambda rows: spark.createDataFrame(rows, "id long, protocol int, dst_port int, us long, dur long, fp long, bp long, fb long, bb long").withColumn("ts", fl.from_micros(F.col("us"))).drop("us")
    got = mt.match_flows(make(a), make(b), 2_000_000, slice_rows).select("candidate_id", "reference_id", "timestamp_diff_s", "match_score").collect()
    want = [(x[0], y[0], abs(x[3] - y[3]) / 1e6, (abs(x[4] - y[4]) < 500_000) + sum(p == q for p, q in zip(x[5:], y[5:])))
            for x in a for y in b if x[1:3] == y[1:3] and abs(x[3] - y[3]) <= 2_000_000]
    assert sorted(tuple(x) for x in got) == sorted(want) and len(want) > 1500


def test_interval_join_is_dealt_by_its_pairs(spark, monkeypatch):
    """A few rows that make many pairs are many tasks, and an empty side is no fault."""
    from flowloom.operators import matching as mt

    monkeypatch.setattr(mt, "TASK_PAIRS", 2_000, raising=False)
    rows = spark.range(600).selectExpr("id", "6 AS protocol", "443 AS dst_port", "id * 100000 AS us", "id % 3 * 1000000 AS dur", "id % 3 AS fp", "id % 2 AS bp", "5L AS fb", "0L AS bb")
    side = rows.withColumn("ts", fl.from_micros(F.col("us"))).drop("us")
    got = mt.match_flows(side, side).withColumn("task", F.spark_partition_id()).agg(F.count(F.lit(1)), F.count_distinct("candidate_id", "reference_id"), F.count_distinct("task")).first()
    assert tuple(got[:2]) == (600 * 41 - 2 * sum(range(1, 21)),) * 2 and got[2] > 4
    assert mt.match_flows(side, side.limit(0)).count() == 0
