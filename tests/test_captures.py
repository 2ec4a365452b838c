"""Capture decoding: pcap and pcapng frames, unreadable frames kept with a reason, and the models' algebra."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import models as md
from flowloom.sources import captures as cap


def ipv4(proto, seg, src=(10, 0, 0, 1), dst=(10, 0, 0, 2)):
    return bytes([0x45, 0]) + struct.pack("!H", 20 + len(seg)) + bytes(5) + bytes([proto, 0, 0]) + bytes(src) + bytes(dst) + seg


TCP = struct.pack("!HHIIBBHHH", 1234, 80, 0, 0, 0x60, 0x12, 4096, 0, 0) + bytes(4) + b"abc"
UDP = struct.pack("!HHHH", 5353, 53, 12, 0) + b"wxyz"
ETH = bytes(12)
FRAMES = [ETH + b"\x08\x00" + ipv4(6, TCP), ETH + b"\x08\x00" + ipv4(17, UDP), ETH + b"\x86\xdd" + bytes(40), ETH + b"\x08\x06" + bytes(28),
          b"\x00\x01", ETH + b"\x81\x00\x00\x05\x08\x00" + ipv4(1, b"ping")]


def pcap(frames, order="<"):
    out = struct.pack(order + "IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 100 + i, 250, len(f), len(f)) + f
    return out


def block(kind, body):
    body += bytes(-len(body) % 4)
    n = struct.pack("<I", 12 + len(body))
    return struct.pack("<I", kind) + n + body + n


def pcapng(frames):
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for i, f in enumerate(frames):
        t = (100 + i) * 1_000_000 + 250
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


@pytest.mark.parametrize("content", [pcap(FRAMES), pcap(FRAMES, ">"), pcapng(FRAMES)])
def test_decode(spark, tmp_path, content):
    (tmp_path / "x.pcap").write_bytes(content)
    d = cap.read_captures(spark, str(tmp_path)).cache()
    rows = {r["index"]: r for r in cap.packets(d).collect()}
    assert set(rows) == {0, 1, 5}
    t = rows[0]
    assert (t["timestamp_us"], t["src_ip"], t["dst_port"], t["transport_header_len"], t["payload_len"], t["tcp_flags"], t["tcp_window"]) == (
        100_000_250, "10.0.0.1", 80, 24, 3, 0x12, 4096)
    u = rows[1]
    assert (u["src_port"], u["protocol"], u["transport_header_len"], u["payload_len"], u["tcp_flags"]) == (5353, 17, 8, 4, None)
    assert rows[5]["src_port"] is None and rows[5]["protocol"] == 1
    bad = {r["index"]: r["reason"] for r in cap.malformed(d).collect()}
    assert set(bad) == {2, 3, 4} and bad[2].startswith("IPv6") and bad[3].startswith("No IPv4") and bad[4].startswith("Truncated")


def test_forecast_and_occlusion(spark):
    rng = np.random.default_rng(3)
    steps, width, n = 4, 3, 120
    x = rng.random((n, steps, width))
    w = rng.random((steps * width, width))
    y = x.reshape(n, -1) @ w + 0.5
    rows = [(i, x[i].tolist(), x[i].ravel().tolist(), y[i].tolist(), "train" if i < 90 else "validation") for i in range(n)]
    df = spark.createDataFrame(rows, "k long, history array<array<double>>, flat array<double>, nxt array<double>, split string").repartition(3)
    model = md.train_forecaster(df, "flat", "nxt", "split", penalties=(1e-6, 10.0))
    assert model.penalty == 1e-6 and model.validation_mse < 1e-6 and np.allclose(model.weights, w, atol=1e-3)
    got = {(r["k"], r["horizon"]): r["state"] for r in md.rollout(df, model, 2, "history", ["k"]).collect()}
    h = x[7].reshape(1, -1)
    for step in (1, 2):
        nxt = h @ model.weights + model.bias
        assert got[(7, step)] == pytest.approx(nxt[0].tolist())
        h = np.hstack([h[:, width:], nxt])
    coef, base = [0.4, -0.7, 0.2], [0.1, 0.2, 0.3]
    cw, b = md.composite(model, coef, -0.3)
    prob = lambda v: 1 / (1 + np.exp(-(v.ravel() @ np.asarray(cw) + b)))
    one = df.where(F.col("k") == 5)
    for r in md.occlusion(one, "history", "k", cw, b, base, False).collect():
        z = x[5].copy()
        z[r["time_step"] + steps - 1, r["feature"]] = base[r["feature"]]
        assert r["contribution"] == pytest.approx(prob(x[5]) - prob(z), abs=1e-12)
    for r in md.occlusion(one, "history", "k", cw, b, base, True).collect():
        z = x[5].copy()
        z[r["time_step"] + steps - 1] = base
        assert r["occluded_probability"] == pytest.approx(prob(z), abs=1e-12)


@pytest.mark.parametrize("content, reason, good", [
    (b"\x01\x02\x03\x04" + bytes(100), "file: unknown magic", 0), (pcap(FRAMES[:2])[:20], "file: header cut short", 0), (pcap(FRAMES[:2]) + bytes(9), "record: header cut short", 2),
    (pcap(FRAMES[:2])[:-3], "record: data cut short", 1), (pcapng(FRAMES[:2]) + block(77, bytes(8)), "block: unknown kind 77", 2), (pcapng(FRAMES[:2]) + bytes(5), "block: header cut short", 2),
    (pcapng(FRAMES[:2]) + struct.pack("<II", 6, 4) + bytes(8), "block: wrong length", 2), (pcapng(FRAMES[:1]) + block(3, struct.pack("<I", 60) + bytes(60)), "packet without a time", 1)])
def test_nothing_vanishes(spark, content, reason, good):
    """Whatever cannot be read on leaves one row with its reason, and what stands before it stays."""
    rows = cap.decode(spark.createDataFrame([("x", bytearray(content))], "capture string, content binary")).collect()
    assert [r.reason for r in rows if r.reason] == [reason] and sum(r.reason is None for r in rows) == good


def test_csv_bound_by_header(spark, tmp_path):
    """Two column orders, an embedded header, a surplus and a short line; a missing column fails."""
    from flowloom.sources import tables as tb

    (tmp_path / "a.csv").write_text("x,y,z\n1,2,3\nx,y,z\n4,5\n6,7,8,9\n")
    (tmp_path / "b.csv").write_text('z,more,y,x\n30,"a,b",20,10\n')
    raw = tb.read_flow_csv(spark, str(tmp_path), ["x", "y", "z"])
    assert sorted(map(tuple, tb.good_rows(raw).collect())) == [("1", "2", "3"), ("10", "20", "30"), ("x", "y", "z")]
    assert sorted(r.line for r in tb.rejected_lines(raw).collect()) == ["4,5", "6,7,8,9"] and tb.rejected_lines(raw).count() == 2
    with pytest.raises(ValueError, match="missing"):
        tb.read_flow_csv(spark, str(tmp_path), ["x", "w"])


@pytest.mark.parametrize("make", [pcap, lambda f: pcap(f, ">"), pcapng])
@pytest.mark.parametrize("tail", [b"", b"\x01\x02\x03"])
def test_ranges_give_the_rows_of_one_task(spark, tmp_path, make, tail):
    data = make(FRAMES * 40) + tail
    (tmp_path / "a.pcap").write_bytes(data)
    (tmp_path / "b.pcapng").write_bytes(make(FRAMES))
    (tmp_path / "c.pcap").write_bytes(b"nothing of the kind")
    (tmp_path / "d.pcap").write_bytes(make([]))
    path = "file:" + str(tmp_path)
    assert cap.capture_ranges(spark, path, range_bytes=300).count() > 40
    fields = [f for f in cap.COLUMNS if f != "capture"]
    name = F.element_at(F.split("capture", "/"), -1)
    rows = lambda df: sorted((tuple(r) for r in df.select(name.alias("capture"), *fields).collect()), key=str)
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap*").load(path).select(F.col("path").alias("capture"), "content")
    want = rows(cap.decode(whole))
    assert rows(cap.read_captures(spark, path, range_bytes=300)) == want and len(want) >= 41 * len(FRAMES)
    assert rows(cap.read_captures(spark, path)) == want


def test_rotated_files_are_one_capture(spark, tmp_path):
    from flowloom.operators import flows as fl

    frame = lambda t: struct.pack("<IIII", t, 0, len(FRAMES[0]), len(FRAMES[0])) + FRAMES[0]
    head = pcap([])
    for i in range(3):
        (tmp_path / f"eth0-{i}.pcap").write_bytes(head + frame(100 + i) + frame(101 + i))
    read = lambda **kw: cap.packets(cap.read_captures(spark, str(tmp_path), **kw)).drop("file")
    flows = lambda p: fl.flow_features(fl.label_packets(p)).select("capture", "`Tot Fwd Pkts`").collect()
    assert flows(read(link=F.lit("eth0"))) == [("eth0", 6)]
    assert len(flows(read())) == 3


def test_batches_of_long_captures_are_bounded(spark):
    """60 captures of 1 MB: a worker gets a few of them at a time, not all, and each gives its row."""
    from pyspark.sql import functions as F

    from flowloom.sources import captures as cap

    head = "d4c3b2a1020004000000000000000000ffff000001000000" + "00" * 8 + "00001000" * 2  # one record of 2^20 bytes
    files = spark.range(60).coalesce(1).select(F.col("id").cast("string").alias("capture"), F.unhex(F.concat(F.lit(head), F.repeat(F.lit("41"), 1 << 20))).alias("content"))
    rows = cap.malformed(cap.decode(files)).collect()
    assert sorted(int(r["capture"]) for r in rows) == list(range(60)) and {r["index"] for r in rows} == {0}
    assert {r["reason"] for r in rows} == {"No IPv4 layer present (e.g. ARP or other non-IP frame)."}

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows]}, pa.schema([("rows", pa.int64())]))

    assert max(r["rows"] for r in files.mapInArrow(sizes, "rows long").collect()) <= 8
