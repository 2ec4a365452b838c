"""Packets to flows: keys, closing rules, directions and the 65 flow features.

A flow of one endpoint pair ends on an idle gap, on RST, or once FIN was seen from both ends; the next
packet of the pair starts a new one. ``flowscan`` applies that sequential rule over slices of rows, so a pair or a second
with any share of the packets is as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import INF, from_micros, int_ratio
from ..functions.ordering import number_rows
from ..schema import FEATURES, INT_FEATURES, PROVENANCE, TCP_FLAGS
from .flowscan import scan

TIMEOUT_US = 120_000_000
IDLE_US = 5_000_000
KEY = ["capture", "protocol", "a_ip", "a_port", "b_ip", "b_port"]


def has_flag(flags: Column, name: str) -> Column:
    return F.coalesce(flags.bitwiseAND(TCP_FLAGS[name]) != 0, F.lit(False))


def decode_flags(flags: Column) -> Column:
    """Names of the set flags, in bit order; NULL without TCP."""
    names = F.array(*[F.when(flags.bitwiseAND(bit) != 0, F.lit(n)) for n, bit in TCP_FLAGS.items()])
    return F.when(flags.isNotNull(), F.array_compact(names))


def with_key(packets: DataFrame) -> DataFrame:
    """Order-free endpoint pair (addresses compare as text) and ``side``: 0 if sent by endpoint a."""
    src, dst = F.struct("src_ip", "src_port"), F.struct("dst_ip", "dst_port")
    first = src <= dst
    pick = lambda yes, no: F.when(first, F.col(yes)).otherwise(F.col(no))
    return packets.withColumns({
        "a_ip": pick("src_ip", "dst_ip"), "a_port": pick("src_port", "dst_port"),
        "b_ip": pick("dst_ip", "src_ip"), "b_port": pick("dst_port", "src_port"),
        "side": F.when(first, 0).otherwise(1),
    })


def assignable(packets: DataFrame) -> DataFrame:
    return packets.where("src_port IS NOT NULL AND dst_port IS NOT NULL AND protocol IS NOT NULL")


def unassigned(packets: DataFrame) -> DataFrame:
    bad = packets.where("src_port IS NULL OR dst_port IS NULL OR protocol IS NULL")
    text = F.concat(F.lit("Packet has no usable src/dst port for protocol="), F.coalesce(F.col("protocol").cast("string"), F.lit("None")), F.lit("."))
    return bad.select("capture", "index", text.alias("reason"))


def label_packets(packets: DataFrame, timeout_us: int = TIMEOUT_US, idle_us: int = IDLE_US, slices: int | None = None) -> DataFrame:
    """Packets with their flow: start position (ts, index), opening side, previous times and closing marks.

    Adds ``flow`` (struct ts, index, side of the first packet), ``prev_ts`` (packet before, any direction),
    ``same_prev`` (struct of the packet before from the same end), ``burst_ts`` / ``prev_burst_ts`` (start of
    the current / preceding burst), ``starts``, ``rst``, ``fin_close``, ``ends_pair`` (last packet of the pair).

    ``slices``: number of row ranges, as many as there are shuffle partitions if not given. The result does not depend on it.
    """
    keyed = with_key(assignable(packets)).withColumn("rst", has_flag(F.col("tcp_flags"), "RST")).withColumn(
        "fin", has_flag(F.col("tcp_flags"), "FIN") & ~F.col("rst"))
    keep = [*packets.columns, *[k for k in KEY if k not in packets.columns], "side", "rst"]
    return scan(keyed.select(*keep, "fin"), KEY, timeout_us, idle_us, slices).drop("fin")


def with_gaps(labeled: DataFrame) -> DataFrame:
    """direction, inter-arrival times of the flow and of the direction, burst lengths and idle gaps."""
    start = F.struct(F.col("flow.ts").alias("ts"), F.col("flow.ix").alias("ix"))
    inside = ~F.col("starts")
    new_burst = inside & (F.col("burst_ts") == F.col("timestamp_us")) & (F.col("prev_burst_ts") < F.col("burst_ts"))
    return labeled.withColumns({
        "direction": F.when(F.col("side") == F.col("flow.sd"), "fwd").otherwise("bwd"),
        "iat": F.when(inside, F.col("timestamp_us") - F.col("prev_ts")),
        "dir_iat": F.when(inside & (F.col("same_prev") >= start), F.col("timestamp_us") - F.col("same_prev.ts")),
        "idle_gap": F.when(new_burst, F.col("timestamp_us") - F.col("prev_ts")),
        "burst_len": F.when(new_burst, F.col("prev_ts") - F.col("prev_burst_ts")),
    })


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def flow_features(labeled: DataFrame) -> DataFrame:
    """One row per flow: identity, closing reason and the 65 features. One hash-partitioned aggregate; a hot
    flow leaves every map task as a single partial row."""
    g = with_gaps(labeled)
    fwd, bwd = F.col("direction") == "fwd", F.col("direction") == "bwd"
    size, us = F.col("ip_total_len"), F.col("timestamp_us")
    hdr = F.col("ip_header_len") + F.col("transport_header_len")
    flag = lambda n, cond=F.lit(True): F.count_if(has_flag(F.col("tcp_flags"), n) & cond)
    first_win = lambda cond: F.coalesce(F.min(F.when(cond & F.col("tcp_window").isNotNull(), F.struct(us, F.col("index"), F.col("tcp_window"))))["tcp_window"], F.lit(-1))

    def stats(name, value, cond=None, kinds=("Max", "Min", "Mean", "Std")):
        v = F.when(cond, value) if cond is not None else value
        f = {"Max": lambda: F.max(v), "Min": lambda: F.min(v), "Mean": lambda: F.avg(v), "Std": lambda: F.stddev_pop(v),
             "Tot": lambda: F.sum(v), "Var": lambda: F.var_pop(v)}
        return [_zero(f[k]()).alias(f"{name} {k}") for k in kinds]

    aggs = [
        F.max(F.struct(us, F.col("index"), F.col("rst"), F.col("fin_close"), F.col("ends_pair"))).alias("_last"),
        F.min_by(F.struct("src_ip", "src_port", "dst_ip", "dst_port"), F.struct(us, F.col("index"))).alias("_open"),
        F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.max("burst_ts").alias("_last_burst"),
        F.count_if(fwd).alias("Tot Fwd Pkts"), F.count_if(bwd).alias("Tot Bwd Pkts"),
        _zero(F.sum(F.when(fwd, size))).alias("TotLen Fwd Pkts"), _zero(F.sum(F.when(bwd, size))).alias("TotLen Bwd Pkts"),
        *[flag(n).alias(f"{n} Flag Cnt") for n in ("ACK", "SYN", "RST", "PSH", "URG", "ECE")],
        flag("PSH", fwd).alias("Fwd PSH Flags"),
        F.count_if(fwd & (F.col("payload_len") > 0)).alias("Fwd Act Data Pkts"),
        first_win(fwd).alias("Init Fwd Win Byts"), first_win(bwd).alias("Init Bwd Win Byts"),
        _zero(F.sum(F.when(fwd, hdr))).alias("Fwd Header Len"), _zero(F.sum(F.when(bwd, hdr))).alias("Bwd Header Len"),
        _zero(F.min(F.when(fwd, F.col("transport_header_len")))).alias("Fwd Seg Size Min"),
        *stats("Fwd Pkt Len", size, fwd), *stats("Bwd Pkt Len", size, bwd),
        *stats("Pkt Len", size, None, ("Max", "Min", "Mean", "Std", "Var")),
        *stats("Flow IAT", F.col("iat")),
        *stats("Fwd IAT", F.col("dir_iat"), fwd, ("Tot", "Mean", "Std", "Max", "Min")),
        *stats("Bwd IAT", F.col("dir_iat"), bwd, ("Tot", "Mean", "Std", "Max", "Min")),
        *stats("Idle", F.col("idle_gap")),
        F.count("burst_len").alias("_bn"), F.avg("burst_len").alias("_bm"), F.var_pop("burst_len").alias("_bv"),
        F.max("burst_len").alias("_bx"), F.min("burst_len").alias("_bi"),
    ]
    agg = g.groupBy(*KEY, "flow").agg(*aggs)
    dur = F.greatest(F.lit(0), F.col("end_us") - F.col("start_us"))
    sec = dur / F.lit(1_000_000.0)
    pk_f, pk_b, by_f, by_b = [F.col(f"`{x}`") for x in ("Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts")]
    n, tail = F.col("_bn"), (F.col("end_us") - F.col("_last_burst")).cast("double")
    mean = (_zero(F.col("_bm")) * n + tail) / (n + 1)
    delta = tail - _zero(F.col("_bm"))
    var = F.when(n > 0, (F.col("_bv") * n + delta * delta * n / (n + 1)) / (n + 1)).otherwise(0.0)
    per_s = lambda x, zero: F.when(sec > 0, x / sec).otherwise(zero)
    out = agg.withColumns({
        "Flow Duration": dur,
        "Down/Up Ratio": int_ratio(pk_b, pk_f),
        "Flow Byts/s": per_s(by_f + by_b, F.when(by_f + by_b == 0, F.lit(float("nan"))).otherwise(F.lit(INF))),
        "Flow Pkts/s": per_s(pk_f + pk_b, F.lit(INF)),
        "Fwd Pkts/s": per_s(pk_f, F.lit(0.0)), "Bwd Pkts/s": per_s(pk_b, F.lit(0.0)),
        "Pkt Size Avg": F.col("`Pkt Len Mean`"), "Fwd Seg Size Avg": F.col("`Fwd Pkt Len Mean`"),
        "Bwd Seg Size Avg": F.col("`Bwd Pkt Len Mean`"),
        "Subflow Fwd Pkts": pk_f, "Subflow Bwd Pkts": pk_b, "Subflow Fwd Byts": by_f, "Subflow Bwd Byts": by_b,
        "Active Mean": mean, "Active Std": F.sqrt(var),
        "Active Max": F.greatest(tail, F.col("_bx")), "Active Min": F.least(tail, F.col("_bi")),
    })
    typed = [F.col(f"`{f}`").cast("long" if f in INT_FEATURES else "double").alias(f) for f in FEATURES]
    return out.select(
        "capture", "a_ip", "a_port", "b_ip", "b_port", "protocol", F.col("flow.ts").alias("start_us"),
        F.col("flow.ix").alias("first_index"), "end_us",
        F.col("_open.src_ip").alias("initiator_ip"), F.col("_open.src_port").alias("initiator_port"),
        F.col("_open.dst_ip").alias("responder_ip"), F.col("_open.dst_port").alias("responder_port"),
        F.when(F.col("_last.rst"), "tcp_rst").when(F.col("_last.fin_close"), "tcp_fin_both")
        .when(F.col("_last.ends_pair"), "end_of_capture").otherwise("timeout").alias("closed_reason"),
        from_micros(F.col("flow.ts")).alias("Timestamp"), *typed)


def flow_table(packets: DataFrame, **kw) -> DataFrame:
    """Flows with closing reason and flow_id in order of opening."""
    return number_flows(flow_features(label_packets(packets, **kw)))


def number_flows(flows: DataFrame) -> DataFrame:
    return number_rows(flows, "flow_id", ["start_us", "first_index"], ["capture"])


SUMMARY = ["flow_id", "initiator_ip", "initiator_port", "responder_ip", "responder_port", "protocol", "start_us", "end_us",
           "packets", "bytes", "closed_reason"]


def flow_summary(flows: DataFrame) -> DataFrame:
    return flows.withColumn("packets", F.col("`Tot Fwd Pkts`") + F.col("`Tot Bwd Pkts`")).withColumn(
        "bytes", F.col("`TotLen Fwd Pkts`") + F.col("`TotLen Bwd Pkts`")).select(*SUMMARY)


def clean_flow_columns(flows: DataFrame) -> DataFrame:
    """The label-free model table: Timestamp, Protocol, 65 features."""
    return flows.select("Timestamp", F.col("protocol").alias("Protocol"), *[F.col(f"`{x}`") for x in FEATURES])


def contract_rejections(df: DataFrame, required: Sequence[str] = FEATURES) -> DataFrame:
    """One row: accepted and the list of rejection reasons, from the schema and one aggregate over the rows."""
    have = set(df.columns)
    missing = [x for x in ["Timestamp", "Protocol", *required] if x not in have]
    none = F.lit(0).cast("long")
    bad_ts = F.count_if(F.col("Timestamp").cast("string").try_cast("timestamp_ntz").isNull()) if "Timestamp" in have else F.lit(1).cast("long")
    proto = F.col("Protocol").try_cast("double") if "Protocol" in have else None
    bad_proto = F.count_if(proto.isNotNull() & ~F.isnan(proto) & ~F.floor(proto).isin(0, 6, 17)) if proto is not None else none
    text = [x for x in required if x in have and df.schema[x].dataType.typeName() == "string"]
    bad_num = none
    if text:
        broken = F.lit(False)
        for x in text:
            broken = broken | (F.col(f"`{x}`").isNotNull() & F.col(f"`{x}`").try_cast("double").isNull())
        bad_num = F.count_if(broken)
    one = df.agg(bad_ts.alias("t"), bad_proto.alias("p"), bad_num.alias("v"))
    reasons = F.array_compact(F.array(
        F.when(F.lit(bool(missing)), F.lit("missing_required_column")),
        F.when(F.col("t") > 0, F.lit("timestamp_missing_or_unparseable")),
        F.when(F.col("p") > 0, F.lit("unsupported_protocol_other")),
        F.when(F.lit("Label" in have), F.lit("label_column_present_and_required_absent")),
        F.when(F.col("v") > 0, F.lit("feature_value_type_mismatch"))))
    return one.select((F.size(reasons) == 0).alias("accepted"), F.array_join(reasons, ",").alias("reasons"),
                      F.col("t").alias("bad_timestamps"), F.col("p").alias("bad_protocols"), F.col("v").alias("bad_value_rows"))


# Fields a packet table must declare.
PACKET_FIELDS = ["timestamp_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ip_total_len", "ip_header_len",
                 "transport_header_len", "payload_len", "tcp_flags", "tcp_window"]


def missing_packet_fields(df: DataFrame) -> list[str]:
    return [x for x in PACKET_FIELDS if x not in df.columns]


def with_provenance(df: DataFrame, kind: str) -> DataFrame:
    """Tags every row; a kind that the data model does not know is an error."""
    if kind not in PROVENANCE:
        raise ValueError(f"unknown provenance {kind!r}, one of {PROVENANCE}")
    return df.withColumn("provenance", F.lit(kind))
