"""Column names, types and lists of the flow-telemetry data model.

Everything in this module is a fixed value: the names, groups and codes must be spelled
exactly like this for tables to be interchangeable with published flow data.
"""

from __future__ import annotations

from pyspark.sql import types as T

TIMESTAMP = "Timestamp"
LABEL = "Label"
PROTOCOL = "Protocol"
DST_PORT = "Dst Port"
BENIGN = "Benign"
ATTACK = "Infilteration"
TS_FORMATS = ["dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]

# Whole-number features of a flow.
INT_FEATURES = [
    "ACK Flag Cnt", "Active Max", "Active Min", "Bwd Header Len", "Bwd IAT Max", "Bwd IAT Min", "Bwd IAT Tot",
    "Bwd Pkt Len Max", "Bwd Pkt Len Min", "Down/Up Ratio", "ECE Flag Cnt", "Flow Duration", "Flow IAT Max",
    "Flow IAT Min", "Fwd Act Data Pkts", "Fwd Header Len", "Fwd IAT Max", "Fwd IAT Min", "Fwd IAT Tot",
    "Fwd PSH Flags", "Fwd Pkt Len Max", "Fwd Pkt Len Min", "Fwd Seg Size Min", "Idle Max", "Idle Min",
    "Init Bwd Win Byts", "Init Fwd Win Byts", "PSH Flag Cnt", "Pkt Len Max", "Pkt Len Min", "RST Flag Cnt",
    "SYN Flag Cnt", "Subflow Bwd Byts", "Subflow Bwd Pkts", "Subflow Fwd Byts", "Subflow Fwd Pkts",
    "Tot Bwd Pkts", "Tot Fwd Pkts", "TotLen Bwd Pkts", "TotLen Fwd Pkts", "URG Flag Cnt",
]

# Real-valued features of a flow.
REAL_FEATURES = [
    "Active Mean", "Active Std", "Bwd IAT Mean", "Bwd IAT Std", "Bwd Pkt Len Mean", "Bwd Pkt Len Std",
    "Bwd Pkts/s", "Bwd Seg Size Avg", "Flow Byts/s", "Flow IAT Mean", "Flow IAT Std", "Flow Pkts/s",
    "Fwd IAT Mean", "Fwd IAT Std", "Fwd Pkt Len Mean", "Fwd Pkt Len Std", "Fwd Pkts/s", "Fwd Seg Size Avg",
    "Idle Mean", "Idle Std", "Pkt Len Mean", "Pkt Len Std", "Pkt Len Var", "Pkt Size Avg",
]

FEATURES = sorted(INT_FEATURES + REAL_FEATURES)
PROTOCOLS = [0, 6, 17]
ONEHOT = [f"Protocol_{p}" for p in PROTOCOLS]
STATE = FEATURES + ONEHOT

# Features added up over a window; every other feature is averaged.
SUM_FEATURES = [
    "ACK Flag Cnt", "Bwd Header Len", "ECE Flag Cnt", "Fwd Act Data Pkts", "Fwd Header Len", "Fwd PSH Flags",
    "PSH Flag Cnt", "RST Flag Cnt", "SYN Flag Cnt", "Subflow Bwd Byts", "Subflow Bwd Pkts", "Subflow Fwd Byts",
    "Subflow Fwd Pkts", "Tot Bwd Pkts", "Tot Fwd Pkts", "TotLen Bwd Pkts", "TotLen Fwd Pkts", "URG Flag Cnt",
]
MEAN_FEATURES = [c for c in STATE if c not in SUM_FEATURES]

# Columns of the raw table that the feature plan leaves out.
EXCLUDED = [
    "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags", "FIN Flag Cnt", "CWE Flag Count", "Fwd Byts/b Avg",
    "Fwd Pkts/b Avg", "Fwd Blk Rate Avg", "Bwd Byts/b Avg", "Bwd Pkts/b Avg", "Bwd Blk Rate Avg",
]
RAW_COLUMNS = [DST_PORT, PROTOCOL, TIMESTAMP] + FEATURES + EXCLUDED + [LABEL]

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

PACKET_SCHEMA = T.StructType([
    T.StructField("capture", T.StringType()),
    T.StructField("index", T.LongType()),
    T.StructField("timestamp_us", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("ip_total_len", T.IntegerType()),
    T.StructField("ip_header_len", T.IntegerType()),
    T.StructField("transport_header_len", T.IntegerType()),
    T.StructField("payload_len", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("tcp_window", T.IntegerType()),
])

# Bits of the TCP flag byte.
TCP_FLAGS = {"FIN": 0x01, "SYN": 0x02, "RST": 0x04, "PSH": 0x08, "ACK": 0x10, "URG": 0x20, "ECE": 0x40, "CWR": 0x80}

# Provenance tags.
PROVENANCE = [
    "observed_lab_traffic", "derived_flow_feature", "model_state", "model_forecast", "attack_probability",
    "mitre_evidence",
]

HISTORY = 10
HORIZONS = [1, 2, 3, 5]
