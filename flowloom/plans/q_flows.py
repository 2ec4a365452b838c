"""Queries: packets, flow rebuilding, flow features, flow matching and the flow-table contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import c, int_ratio
from ..operators import flows as fl
from ..operators import matching as mt
from ..operators import windows as wn
from ..schema import FEATURES, INT_FEATURES, PROVENANCE
from . import mapping as m
from . import q_windows as qw
from .registry import query

KEYED = f"""{m.packets_sql()}, ok AS (SELECT * FROM packets WHERE src_port IS NOT NULL AND dst_port IS NOT NULL AND protocol IS NOT NULL),
keyed AS (SELECT *, CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_ip ELSE dst_ip END AS a_ip,
 CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_port ELSE dst_port END AS a_port,
 CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN dst_ip ELSE src_ip END AS b_ip,
 CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN dst_port ELSE src_port END AS b_port FROM ok)"""
# The sequential rule as written: one packet per pair and step of a recursive query.
FLOWED = f"""RECURSIVE {KEYED}, r AS (SELECT *, concat_ws('|', protocol, a_ip, a_port, b_ip, b_port) AS pair,
 row_number() OVER (PARTITION BY protocol, a_ip, a_port, b_ip, b_port ORDER BY timestamp_us, "index") AS rn FROM keyed),
st AS (SELECT pair, rn, timestamp_us, "index", 1 AS no, src_ip || ':' || src_port AS opener,
  coalesce(tcp_flags & 5, 0) = 1 AS ff, false AS fb, coalesce(tcp_flags & 4, 0) <> 0 AS rst, false AS fin2 FROM r WHERE rn = 1
 UNION ALL SELECT n.pair, n.rn, n.timestamp_us, n."index", n.no, n.opener, n.ff, n.fb, n.rst, n.ff AND n.fb AS fin2 FROM (
  SELECT r.pair, r.rn, r.timestamp_us, r."index", CASE WHEN fresh THEN s.no + 1 ELSE s.no END AS no,
   CASE WHEN fresh THEN r.src_ip || ':' || r.src_port ELSE s.opener END AS opener,
   (NOT fresh AND s.ff) OR (coalesce(r.tcp_flags & 5, 0) = 1 AND (fresh OR r.src_ip || ':' || r.src_port = s.opener)) AS ff,
   (NOT fresh AND s.fb) OR (coalesce(r.tcp_flags & 5, 0) = 1 AND NOT fresh AND r.src_ip || ':' || r.src_port <> s.opener) AS fb,
   coalesce(r.tcp_flags & 4, 0) <> 0 AS rst
  FROM (SELECT st.*, r0.timestamp_us AS nts, st.rst OR st.fin2 OR r0.timestamp_us - st.timestamp_us > 120000000 AS fresh FROM st JOIN r r0 ON r0.pair = st.pair AND r0.rn = st.rn + 1) s
  JOIN r ON r.pair = s.pair AND r.rn = s.rn + 1) n),
fp AS (SELECT r.*, st.no, st.rst, st.fin2, CASE WHEN r.src_ip || ':' || r.src_port = st.opener THEN 'fwd' ELSE 'bwd' END AS direction,
 max(r.rn) OVER (PARTITION BY r.pair) AS last_rn FROM st JOIN r ON r.pair = st.pair AND r.rn = st.rn)"""
FLOWS = f"""{FLOWED}, fl AS (SELECT pair, no, protocol, min(timestamp_us) AS start_us, max(timestamp_us) AS end_us, min_by("index", rn) AS first_index,
 min_by(src_ip, rn) AS initiator_ip, min_by(src_port, rn) AS initiator_port, min_by(dst_ip, rn) AS responder_ip, min_by(dst_port, rn) AS responder_port,
 count(*) AS packets, CAST(sum(ip_total_len) AS BIGINT) AS bytes, CASE WHEN max_by(rst, rn) THEN 'tcp_rst' WHEN max_by(fin2, rn) THEN 'tcp_fin_both'
 WHEN max(rn) = max(last_rn) THEN 'end_of_capture' ELSE 'timeout' END AS closed_reason FROM fp GROUP BY ALL),
fln AS (SELECT *, row_number() OVER (ORDER BY start_us, first_index) - 1 AS flow_id FROM fl)"""


@query("decode_tcp_flags", f"""WITH {m.packets_sql()} SELECT "index" AS packet, CASE WHEN tcp_flags IS NULL THEN NULL ELSE concat_ws(',',
{", ".join(f"CASE WHEN tcp_flags & {b} <> 0 THEN '{n}' END" for n, b in (("FIN", 1), ("SYN", 2), ("RST", 4), ("PSH", 8), ("ACK", 16), ("URG", 32), ("ECE", 64), ("CWR", 128)))}) END AS flags FROM packets""")
def decode_tcp_flags(spark, d):
    return m.packets(spark, d).select(F.col("index").alias("packet"), F.array_join(fl.decode_flags(F.col("tcp_flags")), ",").alias("flags"))


@query("canonical_key", f'WITH {KEYED} SELECT "index" AS packet, a_ip, a_port, b_ip, b_port, protocol FROM keyed')
def canonical_key(spark, d):
    return fl.with_key(fl.assignable(m.packets(spark, d))).select(F.col("index").alias("packet"), "a_ip", "a_port", "b_ip", "b_port", "protocol")


@query("unassigned_packets", f"""WITH {m.packets_sql()} SELECT "index" AS packet, 'Packet has no usable src/dst port for protocol=' || protocol || '.' AS reason FROM packets WHERE src_port IS NULL OR dst_port IS NULL""")
def unassigned_packets(spark, d):
    return fl.unassigned(m.packets(spark, d)).select(F.col("index").alias("packet"), "reason")


@query("sessionize_flows", f"WITH {FLOWS} SELECT start_us, first_index, end_us, packets, closed_reason FROM fln")
def sessionize_flows(spark, d):
    full = fl.flow_features(fl.label_packets(m.packets(spark, d)))
    n = (c("Tot Fwd Pkts") + c("Tot Bwd Pkts")).alias("packets")
    return full.select("start_us", "first_index", "end_us", n, "closed_reason")


@query("flow_direction", f'WITH {FLOWED} SELECT "index" AS packet, direction FROM fp')
def flow_direction(spark, d):
    return fl.with_gaps(fl.label_packets(m.packets(spark, d))).select(F.col("index").alias("packet"), "direction")


@query("flow_ids_order", f"WITH {FLOWS} SELECT flow_id, start_us, first_index FROM fln")
def flow_ids_order(spark, d):
    starts = fl.label_packets(m.packets(spark, d)).where("starts").select(
        "capture", F.col("timestamp_us").alias("start_us"), F.col("index").alias("first_index"))
    return fl.number_flows(starts).select("flow_id", "start_us", "first_index")


@query("flow_summary", f"WITH {FLOWS} SELECT flow_id, initiator_ip, initiator_port, responder_ip, responder_port, protocol, start_us, end_us, packets, bytes, closed_reason FROM fln")
def flow_summary(spark, d):
    return fl.flow_summary(fl.flow_table(m.packets(spark, d)))


GAPS = f"""{FLOWED}, gp AS (SELECT *, timestamp_us - lag(timestamp_us) OVER (PARTITION BY pair, no ORDER BY rn) AS iat,
 timestamp_us - lag(timestamp_us) OVER (PARTITION BY pair, no, direction ORDER BY rn) AS dir_iat FROM fp)"""


@query("iat_series", f'WITH {GAPS} SELECT "index" AS packet, direction, iat, dir_iat FROM gp')
def iat_series(spark, d):
    return fl.with_gaps(fl.label_packets(m.packets(spark, d))).select(F.col("index").alias("packet"), "direction", "iat", "dir_iat")


BURSTS = f"""{GAPS}, br AS (SELECT *, sum(CASE WHEN iat >= 5000000 THEN 1 ELSE 0 END) OVER (PARTITION BY pair, no ORDER BY rn) AS burst FROM gp),
bl AS (SELECT pair, no, burst, max(timestamp_us) - min(timestamp_us) AS len FROM br GROUP BY ALL),
act AS (SELECT pair, no, CAST(avg(len) AS DOUBLE) AS am, CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_pop(len) END AS asd, max(len) AS ax, min(len) AS ai FROM bl GROUP BY ALL),
idl AS (SELECT pair, no, coalesce(avg(iat) FILTER (WHERE iat >= 5000000), 0.0) AS im, coalesce(CASE WHEN count(*) FILTER (WHERE iat >= 5000000) > 1 THEN stddev_pop(iat) FILTER (WHERE iat >= 5000000) END, 0.0) AS isd,
 coalesce(max(iat) FILTER (WHERE iat >= 5000000), 0) AS ix, coalesce(min(iat) FILTER (WHERE iat >= 5000000), 0) AS ii FROM gp GROUP BY ALL)"""
_START = 'st0 AS (SELECT pair, no, min(timestamp_us) AS start_us, min_by("index", rn) AS first_index FROM fp GROUP BY ALL)'
BURST_COLS = ["Active Mean", "Active Std", "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min"]


@query("active_idle_bursts", f"""WITH {BURSTS}, {_START} SELECT start_us, first_index, round(am, 3) AS "Active Mean", round(asd, 3) AS "Active Std", ax AS "Active Max", ai AS "Active Min",
round(im, 3) AS "Idle Mean", round(isd, 3) AS "Idle Std", ix AS "Idle Max", ii AS "Idle Min" FROM st0 JOIN act USING (pair, no) JOIN idl USING (pair, no)""")
def active_idle_bursts(spark, d):
    f = fl.flow_features(fl.label_packets(m.packets(spark, d)))
    return f.select("start_us", "first_index", *[(F.round(c(x), 3) if x[-4:] in ("Mean", " Std") else c(x)).alias(x) for x in BURST_COLS])


def _stat_sql(name, expr, cond, kinds):
    w = f"FILTER (WHERE {cond})" if cond else ""
    f = {"Max": f"coalesce(max({expr}) {w}, 0)", "Min": f"coalesce(min({expr}) {w}, 0)", "Tot": f"coalesce(sum({expr}) {w}, 0)",
         "Mean": f"coalesce(avg({expr}) {w}, 0)", "Std": f"coalesce(stddev_pop({expr}) {w}, 0)", "Var": f"coalesce(var_pop({expr}) {w}, 0)"}
    return [f'{f[k]} AS "{name} {k}"' for k in kinds]


M4 = ["Max", "Min", "Mean", "Std"]
FLAG_SQL = ", ".join(f'count(*) FILTER (WHERE tcp_flags & {b} <> 0) AS "{n} Flag Cnt"' for n, b in (("SYN", 2), ("RST", 4), ("PSH", 8), ("ACK", 16), ("URG", 32), ("ECE", 64)))
FEATURES_SQL = f"""{BURSTS}, raw65 AS (SELECT pair, no, min(timestamp_us) AS start_us, min_by("index", rn) AS first_index, max(timestamp_us) - min(timestamp_us) AS dur,
 any_value(protocol) AS proto, {FLAG_SQL}, count(*) FILTER (WHERE direction = 'fwd' AND tcp_flags & 8 <> 0) AS "Fwd PSH Flags",
 count(*) FILTER (WHERE direction = 'fwd') AS f, count(*) FILTER (WHERE direction = 'bwd') AS b,
 coalesce(sum(ip_total_len) FILTER (WHERE direction = 'fwd'), 0) AS fby, coalesce(sum(ip_total_len) FILTER (WHERE direction = 'bwd'), 0) AS bby,
 count(*) FILTER (WHERE direction = 'fwd' AND payload_len > 0) AS "Fwd Act Data Pkts",
 coalesce(min_by(tcp_window, rn) FILTER (WHERE direction = 'fwd' AND tcp_window IS NOT NULL), -1) AS "Init Fwd Win Byts",
 coalesce(min_by(tcp_window, rn) FILTER (WHERE direction = 'bwd' AND tcp_window IS NOT NULL), -1) AS "Init Bwd Win Byts",
 coalesce(sum(ip_header_len + transport_header_len) FILTER (WHERE direction = 'fwd'), 0) AS "Fwd Header Len",
 coalesce(sum(ip_header_len + transport_header_len) FILTER (WHERE direction = 'bwd'), 0) AS "Bwd Header Len",
 coalesce(min(transport_header_len) FILTER (WHERE direction = 'fwd'), 0) AS "Fwd Seg Size Min",
 {", ".join(_stat_sql("Fwd Pkt Len", "ip_total_len", "direction = 'fwd'", M4) + _stat_sql("Bwd Pkt Len", "ip_total_len", "direction = 'bwd'", M4)
            + _stat_sql("Pkt Len", "ip_total_len", "", M4 + ["Var"]) + _stat_sql("Flow IAT", "iat", "", M4)
            + _stat_sql("Fwd IAT", "dir_iat", "direction = 'fwd'", M4 + ["Tot"]) + _stat_sql("Bwd IAT", "dir_iat", "direction = 'bwd'", M4 + ["Tot"]))}
 FROM gp GROUP BY pair, no),
f65 AS (SELECT *, dur AS "Flow Duration", f AS "Tot Fwd Pkts", b AS "Tot Bwd Pkts", fby AS "TotLen Fwd Pkts", bby AS "TotLen Bwd Pkts",
 f AS "Subflow Fwd Pkts", b AS "Subflow Bwd Pkts", fby AS "Subflow Fwd Byts", bby AS "Subflow Bwd Byts",
 CASE WHEN f > 0 THEN CAST(b // f AS BIGINT) ELSE 0 END AS "Down/Up Ratio", "Pkt Len Mean" AS "Pkt Size Avg", "Fwd Pkt Len Mean" AS "Fwd Seg Size Avg", "Bwd Pkt Len Mean" AS "Bwd Seg Size Avg",
 CASE WHEN dur > 0 THEN (fby + bby) / (dur / 1000000.0E0) WHEN fby + bby = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST('Infinity' AS DOUBLE) END AS "Flow Byts/s",
 CASE WHEN dur > 0 THEN (f + b) / (dur / 1000000.0E0) ELSE CAST('Infinity' AS DOUBLE) END AS "Flow Pkts/s",
 CASE WHEN dur > 0 THEN f / (dur / 1000000.0E0) ELSE 0.0 END AS "Fwd Pkts/s", CASE WHEN dur > 0 THEN b / (dur / 1000000.0E0) ELSE 0.0 END AS "Bwd Pkts/s",
 am AS "Active Mean", asd AS "Active Std", ax AS "Active Max", ai AS "Active Min", im AS "Idle Mean", isd AS "Idle Std", ix AS "Idle Max", ii AS "Idle Min"
 FROM raw65 JOIN act USING (pair, no) JOIN idl USING (pair, no))"""
_F65_SEL = ", ".join(f'CAST("{x}" AS BIGINT) AS "{x}"' if x in INT_FEATURES else f'round(CAST("{x}" AS DOUBLE), 3) AS "{x}"' for x in FEATURES)


@query("flow_features_65", f"WITH {FEATURES_SQL} SELECT start_us, first_index, {_F65_SEL} FROM f65")
def flow_features_65(spark, d):
    f = fl.flow_features(fl.label_packets(m.packets(spark, d)))
    return f.select("start_us", "first_index", *[c(x) if x in INT_FEATURES else F.round(c(x), 3).alias(x) for x in FEATURES])


RATE_COLS = ["Flow Byts/s", "Flow Pkts/s", "Fwd Pkts/s", "Bwd Pkts/s"]


@query("rate_conventions", f"""WITH {FEATURES_SQL} SELECT start_us, first_index, {", ".join(f'round(CAST("{x}" AS DOUBLE), 4) AS "{x}"' for x in RATE_COLS)} FROM f65""")
def rate_conventions(spark, d):
    f = fl.flow_features(fl.label_packets(m.packets(spark, d)))
    return f.select("start_us", "first_index", *[F.round(c(x), 4).alias(x) for x in RATE_COLS])


@query("int_ratio", f"WITH {m.flows_sql(['row_id', 'Tot Fwd Pkts', 'Tot Bwd Pkts'])} SELECT row_id, CAST(\"Tot Bwd Pkts\" // \"Tot Fwd Pkts\" AS BIGINT) AS ratio FROM flows")
def int_ratio_q(spark, d):
    f = m.flows(spark, d, ["row_id", "Tot Fwd Pkts", "Tot Bwd Pkts"])
    return f.select("row_id", int_ratio(c("Tot Bwd Pkts"), c("Tot Fwd Pkts")).alias("ratio"))


@query("flow_table", f"""WITH {FEATURES_SQL} SELECT make_timestamp(start_us) AS "Timestamp", proto AS "Protocol", {_F65_SEL} FROM f65""")
def flow_table(spark, d):
    t = fl.clean_flow_columns(fl.flow_features(fl.label_packets(m.packets(spark, d))))
    return t.select("Timestamp", "Protocol", *[c(x) if x in INT_FEATURES else F.round(c(x), 3).alias(x) for x in FEATURES])


@query("packets_to_states", f"""WITH {FEATURES_SQL}, s AS (SELECT time_bucket(INTERVAL '1 second', make_timestamp(start_us)) AS window_start, count(*) AS observation_count,
 sum(f) AS fwd, avg(dur) AS duration, avg(CASE WHEN isfinite("Flow Pkts/s") THEN "Flow Pkts/s" END) AS pps FROM f65 GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY window_start) - 1 AS window_id,
 CASE WHEN window_start - lag(window_start) OVER (ORDER BY window_start) > INTERVAL '1 second' THEN 1 ELSE 0 END AS cut FROM s)
SELECT window_id, window_start, observation_count, CAST(fwd AS DOUBLE) AS fwd, round(duration, 3) AS duration, round(pps, 3) AS pps, CAST(sum(cut) OVER (ORDER BY window_start) AS BIGINT) AS segment_id FROM i""")
def packets_to_states(spark, d):
    from ..functions.numeric import finite
    from ..operators.cleaning import onehot

    t = fl.clean_flow_columns(fl.flow_features(fl.label_packets(m.packets(spark, d))))
    st = onehot(t, "Protocol").select(F.col("Timestamp").alias("timestamp"), F.lit(None).cast("string").alias("label"),
                                      *[finite(c(x)).alias(x) for x in FEATURES], "Protocol_0", "Protocol_6", "Protocol_17")
    w = wn.index_windows(wn.window_features(st, "1 second"), 1)
    return w.select("window_id", "window_start", "observation_count", c("Tot Fwd Pkts").alias("fwd"),
                    F.round(c("Flow Duration"), 3).alias("duration"), F.round(c("Flow Pkts/s"), 3).alias("pps"), "segment_id")


_RAW_BAD = " OR ".join(f'("{x}" IS NOT NULL AND TRY_CAST("{x}" AS DOUBLE) IS NULL)' for x in FEATURES)


@query("contract_flow_table", f"""WITH {m.raw_text_sql(["Protocol", "Timestamp", *FEATURES])}, a AS (SELECT count(*) FILTER (WHERE try_strptime("Timestamp", '%Y-%m-%d %H:%M:%S') IS NULL) AS t,
count(*) FILTER (WHERE TRY_CAST("Protocol" AS DOUBLE) NOT IN (0, 6, 17)) AS p, count(*) FILTER (WHERE {_RAW_BAD}) AS v FROM rawt), o AS (SELECT count(*) FILTER (WHERE row_id % 97 = 3) AS p FROM flows)
SELECT 'raw' AS candidate, false AS accepted, 'timestamp_missing_or_unparseable,label_column_present_and_required_absent,feature_value_type_mismatch' AS reasons, t AS bad_timestamps, p AS bad_protocols, v AS bad_value_rows FROM a
UNION ALL SELECT 'clean', true, '', 0, 0, 0 UNION ALL SELECT 'incomplete', false, 'missing_required_column', 0, 0, 0
UNION ALL SELECT 'other_protocol', p = 0, CASE WHEN p > 0 THEN 'unsupported_protocol_other' ELSE '' END, 0, p, 0 FROM o""")
def contract_flow_table(spark, d):
    """The contract of all 65 features over four tables: as captured, cleaned, without one feature, with another protocol."""
    clean = m.flows(spark, d).select(F.col("timestamp").alias("Timestamp"), F.col("protocol").alias("Protocol"), "row_id", *[c(x) for x in FEATURES])
    other = clean.withColumn("Protocol", F.when(F.col("row_id") % 97 == 3, 1).otherwise(F.col("Protocol")))
    tables = {"raw": m.raw_text(spark, d), "clean": clean, "incomplete": clean.drop("Flow Duration"), "other_protocol": other}
    out = None
    for name, df in tables.items():
        one = fl.contract_rejections(df).select(F.lit(name).alias("candidate"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("provenance_tag", f"""WITH {qw.seq_sql()} SELECT 'observed_lab_traffic' AS provenance, event_id AS id FROM events UNION ALL SELECT 'derived_flow_feature', row_id FROM states UNION ALL SELECT 'model_state', window_id FROM win
UNION ALL SELECT 'model_forecast', sequence_id FROM seq UNION ALL SELECT 'attack_probability', event_id FROM events UNION ALL SELECT 'mitre_evidence', window_id FROM win""")
def provenance_tag(spark, d):
    """Rows of all six kinds stacked, each tagged with where it comes from."""
    w = qw.windows(spark, d, [])
    rows = [m.packets(spark, d).select(F.col("index").alias("id")), m.states(spark, d, []).select(F.col("row_id").alias("id")), w.select(F.col("window_id").alias("id")),
            qw.sequences(spark, d, [], states=False, w=w).select(F.col("sequence_id").alias("id")), m.scores(spark, d).select(F.col("sequence_id").alias("id")),
            w.select(F.col("window_id").alias("id"))]
    out = None
    for kind, df in zip(PROVENANCE, rows):
        one = fl.with_provenance(df, kind)
        out = one if out is None else out.unionByName(one)
    return out


# Candidates: the rebuilt flows. Reference rows: the event flow table on the clock of the capture.
_CAND = f"""{FLOWS}, cand AS (SELECT fln.flow_id AS id, fln.protocol, responder_port AS dst_port, make_timestamp(start_us) AS ts, end_us - start_us AS dur,
 count(*) FILTER (WHERE direction = 'fwd') AS fp, count(*) FILTER (WHERE direction = 'bwd') AS bp, CAST(coalesce(sum(ip_total_len) FILTER (WHERE direction = 'fwd'), 0) AS BIGINT) AS fb,
 CAST(coalesce(sum(ip_total_len) FILTER (WHERE direction = 'bwd'), 0) AS BIGINT) AS bb FROM fln JOIN fp USING (pair, no) GROUP BY ALL)"""


def _candidates(spark, d):
    f = fl.flow_table(m.packets(spark, d))
    return f.select(F.col("flow_id").alias("id"), "protocol", F.col("responder_port").alias("dst_port"), F.col("Timestamp").alias("ts"),
                    c("Flow Duration").alias("dur"), c("Tot Fwd Pkts").alias("fp"), c("Tot Bwd Pkts").alias("bp"),
                    c("TotLen Fwd Pkts").alias("fb"), c("TotLen Bwd Pkts").alias("bb"))


def _reference_rows(spark, d):
    p = m.packets(spark, d).where("dst_port IS NOT NULL")
    return p.select(F.col("index").alias("id"), "protocol", "dst_port", fl.from_micros(F.col("timestamp_us")).alias("ts"),
                    (F.col("index") % 5 * 1_000_000).alias("dur"), (F.col("index") % 3).alias("fp"), (F.col("index") % 2).alias("bp"),
                    F.col("ip_total_len").cast("long").alias("fb"), F.lit(0).cast("long").alias("bb"))


@query("join_interval_match", f"""WITH {_CAND}, ref AS (SELECT "index" AS id, protocol, dst_port, make_timestamp(timestamp_us) AS ts, ("index" % 5) * 1000000 AS dur, "index" % 3 AS fp, "index" % 2 AS bp,
 CAST(ip_total_len AS BIGINT) AS fb, CAST(0 AS BIGINT) AS bb FROM packets WHERE dst_port IS NOT NULL)
SELECT a.id AS candidate_id, b.id AS reference_id, round(abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1000000.0, 6) AS timestamp_diff_s, round(abs(a.dur / 1000000.0 - b.dur / 1000000.0), 6) AS duration_diff_s,
abs(a.fp - b.fp) AS fwd_pkt_diff, abs(a.bp - b.bp) AS bwd_pkt_diff, abs(a.fb - b.fb) AS fwd_byt_diff, abs(a.bb - b.bb) AS bwd_byt_diff,
CAST(abs(a.dur / 1000000.0 - b.dur / 1000000.0) < 0.5 AS INTEGER) + CAST(a.fp = b.fp AS INTEGER) + CAST(a.bp = b.bp AS INTEGER) + CAST(a.fb = b.fb AS INTEGER) + CAST(a.bb = b.bb AS INTEGER) AS match_score
FROM cand a JOIN ref b ON a.protocol = b.protocol AND a.dst_port = b.dst_port AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 2000000""")
def join_interval_match(spark, d):
    x = mt.match_flows(_candidates(spark, d), _reference_rows(spark, d))
    return x.withColumn("timestamp_diff_s", F.round("timestamp_diff_s", 6)).withColumn("duration_diff_s", F.round("duration_diff_s", 6))


_TUPLES = """SELECT src_ip, dst_ip, src_port, dst_port, protocol, count(*) AS n, CAST(sum(ip_total_len) AS BIGINT) AS bytes FROM ok WHERE {} GROUP BY ALL"""


@query("join_flow_key", f"""WITH {KEYED}, a AS ({_TUPLES.format("coalesce(tcp_flags & 4, 0) = 0")}), b AS ({_TUPLES.format("payload_len > 0")})
SELECT src_ip, dst_ip, src_port, dst_port, protocol, a.n AS left_n, a.bytes AS left_bytes, b.n AS right_n, b.bytes AS right_bytes FROM a JOIN b USING (src_ip, dst_ip, src_port, dst_port, protocol)""")
def join_flow_key(spark, d):
    p = fl.assignable(m.packets(spark, d))

    def tuples(df):
        return df.groupBy(*mt.FIVE_TUPLE).agg(F.count(F.lit(1)).alias("n"), F.sum("ip_total_len").alias("bytes"))

    return mt.join_flow_key(tuples(p.where(~fl.has_flag(F.col("tcp_flags"), "RST"))), tuples(p.where("payload_len > 0")))
