"""The given tables seen as flow telemetry.

``events`` is the flow table (one event = one flow), and also the packet capture (one event = one
packet). The column formulas below are plain SQL that Spark and DuckDB read alike; they define inputs only,
no operator under test is shared between the two sides. All amounts are whole or dyadic numbers, so sums do
not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import c, finite
from ..session import tune
from ..schema import DST_PORT, EXCLUDED, FEATURES, INT_FEATURES, LABEL, ONEHOT, PROTOCOL, PROTOCOLS, STATE, TIMESTAMP

WIDTH = "10 minutes"
STEP = 600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# Helper columns over (e event_id, u user_id, k props.k, t event_type, ts).
BASE = {
    "fp": "CAST(1 + k % 7 AS BIGINT)",
    "bp": "CAST(u % 5 AS BIGINT)",
    "dur": "CASE WHEN k % 10 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(15625 * power(2, k % 10) AS BIGINT) END",
    "fb": "CASE WHEN k % 20 = 0 THEN CAST(0 AS BIGINT) ELSE CAST((1 + k % 7) * (40 + u % 60) * (CASE WHEN e % 50 = 0 THEN 1000 ELSE 1 END) AS BIGINT) END",
    "bb": "CASE WHEN k % 20 = 0 THEN CAST(0 AS BIGINT) ELSE CAST((u % 5) * (40 + e % 30) AS BIGINT) END",
}

NAN = "CAST('NaN' AS DOUBLE)"
INFINITY = "CAST('Infinity' AS DOUBLE)"

SPECIAL = {
    "Flow Duration": "dur",
    "Tot Fwd Pkts": "fp",
    "Tot Bwd Pkts": "bp",
    "TotLen Fwd Pkts": "fb",
    "TotLen Bwd Pkts": "bb",
    "Subflow Fwd Pkts": "fp + CASE WHEN e % 17 = 0 THEN 1 ELSE 0 END",
    "Subflow Bwd Pkts": "bp",
    "Subflow Fwd Byts": "fb",
    "Subflow Bwd Byts": "bb",
    "Flow Byts/s": f"CASE WHEN dur > 0 THEN (fb + bb) * 64.0E0 / (dur / 15625.0E0) WHEN fb + bb = 0 THEN {NAN} ELSE {INFINITY} END",
    "Flow Pkts/s": f"CASE WHEN dur > 0 THEN (fp + bp) * 64.0E0 / (dur / 15625.0E0) ELSE {INFINITY} END",
    "Fwd Pkts/s": "CASE WHEN dur > 0 THEN fp * 64.0E0 / (dur / 15625.0E0) ELSE 0.0E0 END",
    "Bwd Pkts/s": "CASE WHEN dur > 0 THEN bp * 64.0E0 / (dur / 15625.0E0) ELSE 0.0E0 END",
    "Down/Up Ratio": "CAST(floor(bp / (fp * 1.0E0)) AS BIGINT)",
    "Fwd Pkt Len Max": "CAST(60 + u % 40 AS BIGINT)",
    "Bwd Pkt Len Max": "CAST(CASE WHEN bp = 0 THEN 0 ELSE 50 + e % 60 END AS BIGINT)",
    "Pkt Len Max": "CAST(greatest(60 + u % 40, CASE WHEN bp = 0 THEN 0 ELSE 50 + e % 60 END) AS BIGINT)",
    "Fwd Pkt Len Min": "CAST(40 + u % 4 AS BIGINT)",
    "Bwd Pkt Len Min": "CAST(CASE WHEN bp = 0 THEN 0 ELSE 40 + e % 8 END AS BIGINT)",
    "Pkt Len Min": "CAST(CASE WHEN bp = 0 THEN 40 + u % 4 ELSE least(40 + u % 4, 40 + e % 8) END AS BIGINT)",
    "Fwd Pkt Len Mean": "fb / (fp * 1.0E0)",
    "Bwd Pkt Len Mean": "CASE WHEN bp = 0 THEN 0.0E0 WHEN e % 13 = 0 THEN 1.0E0 + bb / (bp * 1.0E0) ELSE bb / (bp * 1.0E0) END",
    "Fwd Seg Size Avg": "fb / (fp * 1.0E0)",
    "Bwd Seg Size Avg": "CASE WHEN bp = 0 THEN 0.0E0 ELSE bb / (bp * 1.0E0) END",
    "Fwd Seg Size Min": "CAST(CASE u % 3 WHEN 0 THEN 0 WHEN 1 THEN 20 + 4 * (e % 3) ELSE 8 END AS BIGINT)",
    "Pkt Len Mean": "CAST(44 + (e + u) % 32 AS DOUBLE) * 0.5E0",
    "Pkt Size Avg": "CAST(44 + (e + u) % 33 AS DOUBLE) * 0.5E0",
    "Init Fwd Win Byts": "CAST(CASE WHEN u % 3 = 1 THEN 8192 + k ELSE -1 END AS BIGINT)",
    "Init Bwd Win Byts": "CAST(CASE WHEN u % 3 = 1 AND bp > 0 THEN 29200 - k ELSE -1 END AS BIGINT)",
    "SYN Flag Cnt": "CAST(CASE WHEN u % 3 = 1 THEN k % 3 ELSE 0 END AS BIGINT)",
    "ACK Flag Cnt": "CAST(CASE WHEN u % 3 = 1 THEN e % 4 ELSE 0 END AS BIGINT)",
    "ECE Flag Cnt": "CAST(CASE WHEN e % 997 = 0 THEN 1 ELSE 0 END AS BIGINT)",
    "Active Min": "CAST(0 AS BIGINT)",
    "Flow IAT Mean": "CAST((k * 11 + e) % 64 AS DOUBLE) * 0.25E0",
    "Flow IAT Std": "CAST((k * 5 + u) % 24 AS DOUBLE) * 0.25E0",
}


def _formula(name: str) -> str:
    if name in SPECIAL:
        return SPECIAL[name]
    i = FEATURES.index(name)
    mix = f"(e * {i % 5 + 1} + u * {i % 7 + 2} + k * {i % 3 + 3}) % {23 + i}"
    return f"CAST({mix} AS BIGINT)" if name in INT_FEATURES else f"CAST({mix} AS DOUBLE) * 0.25E0"


FLOW_COLUMNS = {
    "row_id": "e",
    "timestamp": "ts",
    "label": "CASE t WHEN 'error' THEN 'Infilteration' WHEN 'signup' THEN 'SSH-Bruteforce' ELSE 'Benign' END",
    "protocol": "CASE u % 3 WHEN 0 THEN 0 WHEN 1 THEN 6 ELSE 17 END",
    "dst_port": "k",
    "capture_day": "CAST(ts AS DATE)",
} | {f: _formula(f) for f in FEATURES}


def _projection(cols) -> list[str]:
    return [f'{FLOW_COLUMNS[x]} AS "{x}"' for x in cols]


def flows(spark: SparkSession, sf_dir: str, cols=None) -> DataFrame:
    """The cleaned flow table: real NaN and infinities in the rate columns, one row per event."""
    cols = list(cols) if cols else list(FLOW_COLUMNS)
    base = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("e"), F.col("user_id").alias("u"), F.col("event_type").alias("t"), "ts", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    base = base.selectExpr("*", *[f"{x} AS {n}" for n, x in BASE.items()])
    return base.selectExpr(*[f"{FLOW_COLUMNS[x]} AS `{x}`" for x in cols])


def onehot(protocol: str = "protocol"):
    return [(F.col(protocol) == p).cast("int").alias(n) for p, n in zip(PROTOCOLS, ONEHOT)]


def states(spark: SparkSession, sf_dir: str, features=None) -> DataFrame:
    """Per-flow state: non-finite numbers are NULL, protocol is one-hot."""
    feats = list(features) if features is not None else FEATURES
    df = flows(spark, sf_dir, ["row_id", "timestamp", "label", "protocol", "dst_port", "capture_day", *feats])
    return df.select("row_id", "timestamp", "label", "dst_port", "capture_day",
                     *[finite(c(x)).alias(x) for x in feats], *onehot())


# ---- the same inputs for DuckDB -------------------------------------------------------------------------

_RAW_SQL = ("raw AS (SELECT event_id AS e, user_id AS u, event_type AS t, ts, value, "
            "CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
_BASE_SQL = "base AS (SELECT *, " + ", ".join(f"{x} AS {n}" for n, x in BASE.items()) + " FROM raw)"


def flows_sql(cols=None) -> str:
    """CTEs ending in ``flows``."""
    cols = list(cols) if cols else list(FLOW_COLUMNS)
    return f"{_RAW_SQL}, {_BASE_SQL}, flows AS (SELECT {', '.join(_projection(cols))} FROM base)"


def states_sql(features=None) -> str:
    """CTEs ending in ``states``."""
    feats = list(features) if features is not None else FEATURES
    cols = ["row_id", "timestamp", "label", "protocol", "dst_port", "capture_day", *feats]
    num = [f'CASE WHEN isfinite(CAST("{x}" AS DOUBLE)) THEN CAST("{x}" AS DOUBLE) END AS "{x}"' for x in feats]
    hot = [f'CASE WHEN protocol = {p} THEN 1 ELSE 0 END AS "{n}"' for p, n in zip(PROTOCOLS, ONEHOT)]
    return (flows_sql(cols) + ", states AS (SELECT row_id, timestamp, label, dst_port, capture_day, "
            + ", ".join(num + hot) + " FROM flows)")


# A raw 80-column text line per event, as a capture tool would have written it.
def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string 80-column table with the faults a raw day file has: repeated header rows, broken numbers,
    broken times and repeated rows (each a rule over the whole table, not a sample)."""
    text = {
        DST_PORT: "CAST(dst_port AS STRING)",
        PROTOCOL: "CAST(protocol AS STRING)",
        TIMESTAMP: "CASE WHEN row_id % 503 = 11 THEN 'not a time' ELSE date_format(timestamp, 'dd/MM/yyyy HH:mm:ss') END",
        LABEL: "label",
    }
    text |= {f: f"CAST(`{f}` AS STRING)" for f in FEATURES}
    text["Active Min"] = "CASE WHEN row_id % 211 = 3 THEN 'oops' ELSE CAST(`Active Min` AS STRING) END"
    text |= {f: "'0'" for f in EXCLUDED}
    names = [DST_PORT, PROTOCOL, TIMESTAMP, *FEATURES, *EXCLUDED, LABEL]
    return flows(spark, sf_dir).selectExpr(
        "row_id", *[f"CASE WHEN row_id % 401 = 7 THEN '{n}' ELSE {text[n]} END AS `{n}`" for n in names])


def raw_text_sql(cols) -> str:
    """CTEs ending in ``rawt`` with the given text columns (row_id always)."""
    out = ["row_id"]
    for n in cols:
        if n == DST_PORT:
            x = "CAST(dst_port AS VARCHAR)"
        elif n == PROTOCOL:
            x = "CAST(protocol AS VARCHAR)"
        elif n == TIMESTAMP:
            x = "CASE WHEN row_id % 503 = 11 THEN 'not a time' ELSE strftime(timestamp, '%d/%m/%Y %H:%M:%S') END"
        elif n == LABEL:
            x = "label"
        elif n == "Active Min":
            x = "CASE WHEN row_id % 211 = 3 THEN 'oops' ELSE CAST(\"Active Min\" AS VARCHAR) END"
        elif n in EXCLUDED:
            x = "'0'"
        elif n in ("Flow Byts/s", "Flow Pkts/s"):
            x = f'CASE WHEN isnan("{n}") THEN \'NaN\' WHEN isinf("{n}") THEN \'Infinity\' ELSE CAST("{n}" AS VARCHAR) END'
        else:
            x = f'CAST("{n}" AS VARCHAR)'
        out.append(f"CASE WHEN row_id % 401 = 7 THEN '{n}' ELSE {x} END AS \"{n}\"")
    need = ["row_id", "timestamp", "label", "protocol", "dst_port"] + [x for x in cols if x in FEATURES]
    return flows_sql(need) + ", rawt AS (SELECT " + ", ".join(out) + " FROM flows)"


# Scored sequences: a probability that is a plain function of the row, so no model is needed to check metrics.
SCORE = "CAST((e * 7919 + u * 104729 + k * 31) % 1001 AS DOUBLE) / 1000.0E0"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sequence_id, horizon, day, family, y, p): one row per event; horizon 1, 2, 3, 5 by user."""
    base = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("e"), F.col("user_id").alias("u"), F.col("event_type").alias("t"), "ts",
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    return base.select(
        F.col("e").alias("sequence_id"),
        F.expr("CASE u % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 5 END").alias("horizon"),
        F.expr("CAST(ts AS DATE)").alias("day"),
        F.expr(FLOW_COLUMNS["label"]).alias("family"),
        F.expr("CASE WHEN t IN ('error', 'signup') THEN 1 ELSE 0 END").alias("y"),
        F.expr(SCORE).alias("p"))


SCORES_SQL = (
    _RAW_SQL + ", scores AS (SELECT e AS sequence_id, CASE u % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 5 END "
    f"AS horizon, CAST(ts AS DATE) AS day, {FLOW_COLUMNS['label']} AS family, "
    f"CASE WHEN t IN ('error', 'signup') THEN 1 ELSE 0 END AS y, {SCORE} AS p FROM raw)"
)

# Packets: one per event; endpoints from (user, k), direction by the event number, RST = error, FIN = signup.
PACKET_COLUMNS = {
    "capture": "'events'",
    "index": "e",
    "src_ip": "CASE WHEN e % 2 = 0 THEN concat('10.0.0.', CAST(u % 20 AS STRING)) ELSE concat('192.168.0.', CAST(k % 5 AS STRING)) END",
    "dst_ip": "CASE WHEN e % 2 = 0 THEN concat('192.168.0.', CAST(k % 5 AS STRING)) ELSE concat('10.0.0.', CAST(u % 20 AS STRING)) END",
    "src_port": "CASE WHEN k = 99 THEN NULL WHEN e % 2 = 0 THEN CAST(40000 + u % 3 AS INTEGER) ELSE CAST(80 + k % 4 AS INTEGER) END",
    "dst_port": "CASE WHEN k = 99 THEN NULL WHEN e % 2 = 0 THEN CAST(80 + k % 4 AS INTEGER) ELSE CAST(40000 + u % 3 AS INTEGER) END",
    "protocol": "CASE WHEN k = 99 THEN 1 WHEN u % 4 = 3 THEN 17 ELSE 6 END",
    "ip_header_len": "20",
    "transport_header_len": "CASE WHEN k = 99 THEN 0 WHEN u % 4 = 3 THEN 8 ELSE CAST(20 + 4 * (k % 3) AS INTEGER) END",
    "payload_len": "CAST(k % 50 AS INTEGER)",
    "tcp_flags": "CASE WHEN k = 99 OR u % 4 = 3 THEN NULL ELSE CAST(CASE t WHEN 'error' THEN (CASE WHEN e % 3 = 0 THEN 20 ELSE 24 END) WHEN 'signup' THEN 17 WHEN 'click' THEN 2 WHEN 'view' THEN 16 ELSE 56 END AS INTEGER) END",
    "tcp_window": "CASE WHEN k = 99 OR u % 4 = 3 THEN NULL ELSE CAST(1024 + k * 7 AS INTEGER) END",
}
# The capture clock runs 1000 times faster than the event clock, so idle gaps, bursts and timeouts all occur.
SPEED = 1000


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("e"), F.col("user_id").alias("u"), F.col("event_type").alias("t"), "ts",
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    out = base.select(F.floor(us / SPEED).cast("long").alias("timestamp_us"),
                      *[F.expr(x).alias(n) for n, x in PACKET_COLUMNS.items()])
    return out.withColumn("ip_total_len", (F.col("ip_header_len") + F.col("transport_header_len") + F.col("payload_len")).cast("int"))


def packets_sql() -> str:
    cols = ", ".join(f'{x.replace("AS STRING", "AS VARCHAR")} AS "{n}"' for n, x in PACKET_COLUMNS.items())
    return (_RAW_SQL + f", pk0 AS (SELECT CAST(floor(epoch_us(ts) / {SPEED}.0E0) AS BIGINT) AS timestamp_us, {cols} FROM raw), "
            "packets AS (SELECT *, ip_header_len + transport_header_len + payload_len AS ip_total_len FROM pk0)")


WINDOWS_STATE = STATE
