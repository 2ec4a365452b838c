"""Queries: scans and sinks, cleaning, duplicates, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import c, minmax_scaled
from ..functions.ordering import number_rows
from ..operators import chain
from ..operators import cleaning as cl
from ..operators import dedup as dd
from ..operators import profiling as pf
from ..operators import windows as wn
from ..schema import ATTACK, BENIGN, DST_PORT, EXCLUDED, FEATURES, INT_FEATURES, LABEL, PROTOCOL, RAW_COLUMNS, REAL_FEATURES, STATE, TIMESTAMP
from ..sources import tables as tb
from . import mapping as m
from .registry import query

DAY = "CAST(capture_day AS VARCHAR)"


def _staged_csv(spark, d):
    """The raw table as files of two column orders, among them files with lines that are too short or too long."""
    path = tb.staging_dir(spark, "flows_csv")
    raw = m.raw_text(spark, d).withColumn("Extra", F.lit("a, b"))
    orders = {"all": RAW_COLUMNS, "turned": [*RAW_COLUMNS[40:], "Extra", *RAW_COLUMNS[:40]]}
    even = F.coalesce(F.col("row_id") % 2 == 0, F.lit(False))  # a negative or missing number is in the other files
    for part, (name, columns) in zip((even, ~even), orders.items()):
        day = f"{path}/capture_day={name}"
        raw.where(part).select(*[c(x) for x in columns]).write.option("header", True).csv(day)
    short = F.when(F.col("row_id") % 307 == 5, "cut, short").when(F.col("row_id") % 311 == 6, ",".join(["0"] * len(RAW_COLUMNS) + ["one,more"]))
    # a CSV writer cannot write such lines: they go out as one-column lines under a header of the right names
    faulty = raw.select(short.alias(",".join(RAW_COLUMNS))).where(F.col(f"`{','.join(RAW_COLUMNS)}`").isNotNull())
    faulty.write.option("header", True).option("sep", "\t").option("quote", "").csv(f"{path}/capture_day=faulty")
    return path


SCAN = [DST_PORT, PROTOCOL, TIMESTAMP, *INT_FEATURES, *EXCLUDED, LABEL]
_scan_real = ", ".join(f'TRY_CAST("{x}" AS DOUBLE) AS "{x}"' for x in REAL_FEATURES)


@query("scan_csv_flows", f"""WITH {m.raw_text_sql(RAW_COLUMNS)}
SELECT {", ".join(f'"{x}"' for x in SCAN)}, {_scan_real} FROM rawt""")
def scan_csv_flows(spark, d):
    """All 80 columns of files with two column orders; the real-valued ones as numbers, as engines spell them differently."""
    df = tb.good_rows(tb.read_flow_csv(spark, _staged_csv(spark, d)))
    return df.select(*[c(x) for x in SCAN], *[c(x).try_cast("double").alias(x) for x in REAL_FEATURES])


@query("scan_csv_rejects", """SELECT CASE WHEN event_id % 307 = 5 THEN 'short' ELSE 'long' END AS kind, count(*) AS n FROM events
WHERE event_id % 307 = 5 OR event_id % 311 = 6 GROUP BY 1""")
def scan_csv_rejects(spark, d):
    lines = tb.rejected_lines(tb.read_flow_csv(spark, _staged_csv(spark, d)))
    return lines.groupBy(F.when(F.col("line") == "cut, short", "short").when(F.col("line").endswith(",one,more"), "long").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_csv_chunked", f"""WITH {m.raw_text_sql([LABEL, TIMESTAMP, "Flow Byts/s"])}
SELECT "Label" AS label_text, count(*) AS row_count, count(DISTINCT "Timestamp") AS distinct_ts,
 CAST(sum(CASE WHEN "Flow Byts/s" = 'NaN' THEN 1 ELSE 0 END) AS BIGINT) AS nan_text,
 CAST(sum(CASE WHEN "Flow Byts/s" = 'Infinity' THEN 1 ELSE 0 END) AS BIGINT) AS inf_text
FROM rawt GROUP BY 1""")
def scan_csv_chunked(spark, d):
    df = tb.good_rows(tb.read_flow_csv(spark, _staged_csv(spark, d)))
    return df.groupBy(c(LABEL).alias("label_text")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct(c(TIMESTAMP)).alias("distinct_ts"),
        F.count_if(c("Flow Byts/s") == "NaN").alias("nan_text"), F.count_if(c("Flow Byts/s") == "Infinity").alias("inf_text"))


@query("scan_projected", "SELECT user_id, ts FROM events")
def scan_projected(spark, d):
    return m.table(spark, d, "events").select("user_id", "ts")


REGISTRY = [("1", "training day", "none"), ("2", "external day", "truncated file"), ("3", "external day", "ends early")]


@query("scan_multi_day", f"""WITH {m.flows_sql(["row_id", "timestamp", "label"])},
days AS (SELECT *, CAST(CASE WHEN timestamp < TIMESTAMP '2024-01-11' THEN 1 WHEN timestamp < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END AS VARCHAR) AS capture_day FROM flows),
reg(capture_day, role, caveat) AS (VALUES ('1','training day','none'),('2','external day','truncated file'),('3','external day','ends early'))
SELECT capture_day, role, caveat, count(*) AS n, min(timestamp) AS lo, max(timestamp) AS hi FROM days LEFT JOIN reg USING (capture_day) GROUP BY ALL""")
def scan_multi_day(spark, d):
    df = m.flows(spark, d, ["row_id", "timestamp", "label"])
    t = F.col("timestamp")
    cut1, cut2 = [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-11", "2024-01-21")]
    days = {"1": df.where(t < cut1), "2": df.where((t >= cut1) & (t < cut2)), "3": df.where(t >= cut2)}
    reg = spark.createDataFrame(REGISTRY, "capture_day string, role string, caveat string")
    return tb.tag_days(days, reg).groupBy("capture_day", "role", "caveat").agg(
        F.count(F.lit(1)).alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"))


@query("sink_tables", f"WITH {m.flows_sql(['row_id', 'capture_day', 'Tot Fwd Pkts'])} SELECT {DAY} AS capture_day, count(*) AS n, CAST(sum(\"Tot Fwd Pkts\") AS BIGINT) AS fwd FROM flows GROUP BY 1")
def sink_tables(spark, d):
    path = tb.write_stage(m.flows(spark, d), tb.staging_dir(spark, "stage"), "capture_day")
    return spark.read.parquet(path).groupBy(F.col("capture_day").cast("string").alias("capture_day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(c("Tot Fwd Pkts")).alias("fwd"))


@query("sink_reports", f"WITH {m.flows_sql(['label'])} SELECT label, count(*) AS n FROM flows GROUP BY 1")
def sink_reports(spark, d):
    path = tb.write_report(pf.count_by(m.flows(spark, d, ["label"]), "label"), tb.staging_dir(spark, "report"))
    return spark.read.schema("label string, n long").json(path)


@query("reload_check", "SELECT count(*) AS rows_before, count(*) AS rows_after, true AS equal FROM events")
def reload_check(spark, d):
    return tb.reload_check(m.flows(spark, d, ["row_id", "timestamp", "label"]), tb.staging_dir(spark, "reload"))


# ---- cleaning --------------------------------------------------------------------------------------------

KEEP = [DST_PORT, PROTOCOL, TIMESTAMP, "Active Min", "Flow Byts/s", LABEL]


@query("drop_embedded_headers", f"""WITH {m.raw_text_sql(RAW_COLUMNS)}
SELECT row_id, "Timestamp" AS ts_text FROM rawt WHERE NOT ({" AND ".join(f'"{x}" = ' + chr(39) + x + chr(39) for x in RAW_COLUMNS)})""")
def drop_embedded_headers(spark, d):
    return cl.drop_embedded_headers(m.raw_text(spark, d), RAW_COLUMNS).select("row_id", c(TIMESTAMP).alias("ts_text"))


CHAIN = ["Flow Duration", "Tot Fwd Pkts", "Flow Byts/s", "Active Min", "Protocol_6"]
_chain_num = lambda x: f'(CASE WHEN isfinite(TRY_CAST("{x}" AS DOUBLE)) THEN TRY_CAST("{x}" AS DOUBLE) END)'


@query("clean_chain", f"""WITH {m.raw_text_sql(RAW_COLUMNS)}, whole AS (SELECT DISTINCT * EXCLUDE row_id FROM rawt WHERE "Label" <> 'Label'),
t AS (SELECT time_bucket(INTERVAL '10 minutes', try_strptime("Timestamp", '%d/%m/%Y %H:%M:%S')) AS window_start, * FROM whole WHERE try_strptime("Timestamp", '%d/%m/%Y %H:%M:%S') IS NOT NULL)
SELECT window_start, count(*) AS observation_count, count(*) FILTER (WHERE "Label" = 'Infilteration') AS infiltration_count, round(avg({_chain_num("Flow Duration")}), 6) AS "Flow Duration", round(sum({_chain_num("Tot Fwd Pkts")}), 6) AS "Tot Fwd Pkts",
round(avg({_chain_num("Flow Byts/s")}) + 1e-8, 6) AS "Flow Byts/s", round(avg({_chain_num("Active Min")}), 6) AS "Active Min", round(avg(CASE WHEN "Protocol" = '6' THEN 1.0E0 ELSE 0 END), 6) AS "Protocol_6" FROM t GROUP BY 1""")
def clean_chain(spark, d):
    """From dirty CSV files, with every row written twice, to windows."""
    path = _staged_csv(spark, d)
    raw = tb.good_rows(tb.read_flow_csv(spark, path)).select(*[c(x) for x in RAW_COLUMNS])
    states = chain.clean_states(raw.unionByName(raw), [BENIGN, ATTACK, "SSH-Bruteforce"])
    w = wn.window_features(states, m.WIDTH, columns=CHAIN)
    off = {"Flow Byts/s": 1e-8}
    return w.select("window_start", "observation_count", "infiltration_count", *[F.round(c(x) + F.lit(off[x]) if x in off else c(x), 6).alias(x) for x in CHAIN])


def _numeric_sql(x):
    v = f'TRY_CAST("{x}" AS DOUBLE)'
    miss = f'("{x}" IS NULL OR lower(trim("{x}")) IN (\'\', \'nan\', \'null\'))'
    bad = f"({v} IS NULL OR isnan({v}))"
    return (f"SELECT '{x}' AS column_name, count(*) FILTER (WHERE {miss}) AS raw_missing, count(*) FILTER (WHERE {bad}) AS missing_after, "
            f"count(*) FILTER (WHERE {bad} AND NOT {miss}) AS introduced, count(*) FILTER (WHERE isinf({v})) AS infinite FROM rawt")


NUM_COLS = [DST_PORT, PROTOCOL, *FEATURES]


@query("coerce_numeric", f"WITH {m.raw_text_sql(NUM_COLS)} " + " UNION ALL ".join(_numeric_sql(x) for x in NUM_COLS))
def coerce_numeric(spark, d):
    return cl.numeric_report(m.raw_text(spark, d), NUM_COLS)


@query("parse_ts_explicit", f"""WITH {m.raw_text_sql([TIMESTAMP])}
SELECT row_id, try_strptime("Timestamp", '%d/%m/%Y %H:%M:%S') AS parsed, try_strptime("Timestamp", '%d/%m/%Y %H:%M:%S') IS NULL AS failed FROM rawt""")
def parse_ts_explicit(spark, d):
    p = cl.parse_ts(c(TIMESTAMP))
    return m.raw_text(spark, d).select("row_id", p.alias("parsed"), p.isNull().alias("failed"))


@query("parse_ts_candidates", f"""WITH {m.raw_text_sql([TIMESTAMP])}, f AS (
SELECT 0 AS position, 'dd/MM/yyyy HH:mm:ss' AS format, count(*) FILTER (WHERE try_strptime("Timestamp", '%d/%m/%Y %H:%M:%S') IS NULL) AS failures FROM rawt UNION ALL
SELECT 1, 'yyyy-MM-dd HH:mm:ss', count(*) FILTER (WHERE try_strptime("Timestamp", '%Y-%m-%d %H:%M:%S') IS NULL) FROM rawt)
SELECT format, failures FROM f ORDER BY failures, position LIMIT 1""")
def parse_ts_candidates(spark, d):
    return cl.choose_format(cl.ts_failures(m.raw_text(spark, d), TIMESTAMP))


@query("label_guard", f"""WITH {m.raw_text_sql([LABEL])} SELECT "Label" AS label_text, count(*) AS n FROM rawt
WHERE "Label" IS NULL OR "Label" NOT IN ('Benign', 'Infilteration') GROUP BY 1""")
def label_guard(spark, d):
    return cl.unexpected_labels(m.raw_text(spark, d), LABEL, [BENIGN, ATTACK]).select(
        c(LABEL).alias("label_text"), F.col("rows").alias("n"))


_RATES = ["Flow Byts/s", "Flow Pkts/s", "Fwd Pkts/s", "Bwd Pkts/s"]


@query("inf_to_null", f"""WITH {m.flows_sql(["row_id", *_RATES])}, r AS (
{" UNION ALL ".join(f"SELECT '{x}' AS column_name, count(*) FILTER (WHERE isinf(" + '"' + x + '"' + ")) AS infinite FROM flows" for x in _RATES)}
UNION ALL SELECT '(rows)', count(*) FILTER (WHERE {" OR ".join('isinf("' + x + '")' for x in _RATES)}) FROM flows)
SELECT * FROM r WHERE infinite > 0""")
def inf_to_null(spark, d):
    return cl.infinity_report(m.flows(spark, d), FEATURES)


def _missing_sql(x):
    bad = f'NOT coalesce(isfinite(CAST("{x}" AS DOUBLE)), false)'
    raw = f'("{x}" IS NULL OR isnan(CAST("{x}" AS DOUBLE)))'
    rel = ", ".join(f'CAST({f}("{r}") AS DOUBLE) AS "{r}_{f}"' for r in cl.RELATED for f in ("min", "max"))
    return (f"SELECT '{x}' AS feature, count(*) FILTER (WHERE {raw}) AS missing_before, count(*) AS missing_after, "
            f'count(*) FILTER (WHERE "Flow Duration" = 0) AS zero_duration, count(*) FILTER (WHERE "Flow Duration" = 0) = count(*) AS all_zero_duration, {rel} '
            f"FROM flows WHERE {bad} HAVING count(*) > 0")


@query("missing_investigation", f"WITH {m.flows_sql(FEATURES)} " + " UNION ALL ".join(_missing_sql(x) for x in FEATURES))
def missing_investigation(spark, d):
    return cl.missing_investigation(m.flows(spark, d))


@query("onehot_fixed", f"""WITH {m.flows_sql(["row_id", "protocol"])} SELECT row_id, CASE WHEN protocol = 0 THEN 1 ELSE 0 END AS "Protocol_0",
CASE WHEN protocol = 6 THEN 1 ELSE 0 END AS "Protocol_6", CASE WHEN protocol = 17 THEN 1 ELSE 0 END AS "Protocol_17" FROM flows""")
def onehot_fixed(spark, d):
    return cl.onehot(m.flows(spark, d, ["row_id", "protocol"])).drop("protocol")


@query("onehot_unseen", """SELECT CAST(l_linenumber AS VARCHAR) AS l_linenumber, count(*) AS n FROM lineitem
WHERE l_linenumber NOT IN (0, 6, 17) GROUP BY 1""")
def onehot_unseen(spark, d):
    return cl.unseen_values(m.table(spark, d, "lineitem"), "l_linenumber", [0, 6, 17]).withColumnRenamed("rows", "n")


@query("encode_label", f"""WITH {m.flows_sql(["row_id", "label"])} SELECT row_id, CASE WHEN label = 'Benign' THEN 0 ELSE 1 END AS binary_target,
CASE label WHEN 'Benign' THEN 0 WHEN 'Infilteration' THEN 1 END AS training_target FROM flows""")
def encode_label(spark, d):
    lab = F.col("label")
    return m.flows(spark, d, ["row_id", "label"]).select(
        "row_id", cl.encode_label(lab, "binary").alias("binary_target"), cl.encode_label(lab, "compatible").alias("training_target"))


@query("assign_row_id", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id FROM events")
def assign_row_id(spark, d):
    return number_rows(m.table(spark, d, "events").select("event_id", "ts"), "row_id", ["ts", "event_id"]).select("event_id", "row_id")


@query("minmax_normalize", f"""WITH {m.flows_sql(["row_id", "Flow Duration"])}, r AS (SELECT min("Flow Duration") AS lo, max("Flow Duration") AS hi FROM flows)
SELECT row_id, round(CASE WHEN hi - lo = 0 THEN CASE WHEN "Flow Duration" > 0 THEN 1.0 ELSE 0.0 END
ELSE greatest(0.0, least(1.0, ("Flow Duration" - lo) / CAST(hi - lo AS DOUBLE))) END, 6) AS scaled FROM flows, r""")
def minmax_normalize(spark, d):
    df = m.flows(spark, d, ["row_id", "Flow Duration"])
    r = df.agg(F.min(c("Flow Duration")).alias("lo"), F.max(c("Flow Duration")).alias("hi"))
    v = [x.cast("double") for x in (c("Flow Duration"), F.col("lo"), F.col("hi"))]
    return df.crossJoin(F.broadcast(r)).select("row_id", F.round(minmax_scaled(*v), 6).alias("scaled"))


# ---- duplicates ------------------------------------------------------------------------------------------

_DUP_SQL = "dup AS (SELECT user_id, event_type, json_extract_string(props, '$.k') AS k FROM events)"


def _dup(spark, d):
    return m.table(spark, d, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


FULL = ["timestamp", "label", "dst_port", *STATE]
_FULL_COLS = ", ".join(f'"{x}"' for x in FULL)
_FULL_SQL = f"""{m.states_sql()}, whole AS (SELECT {_FULL_COLS} FROM states UNION ALL SELECT {_FULL_COLS} FROM states WHERE row_id % 10 = 3 UNION ALL SELECT {_FULL_COLS} FROM states WHERE row_id % 30 = 3)"""
_FULL_GROUPS = f"g AS (SELECT count(*) AS n FROM whole GROUP BY {_FULL_COLS})"


def _whole(spark, d):
    """Every column of the flow states, with a tenth of the rows once and a thirtieth twice more."""
    s = m.states(spark, d)
    rows = F.explode(F.when(F.col("row_id") % 30 == 3, F.array_repeat(F.lit(1), 3)).when(F.col("row_id") % 10 == 3, F.array_repeat(F.lit(1), 2)).otherwise(F.array(F.lit(1))))
    return s.withColumn("_copy", rows).select(*[c(x) for x in FULL])


@query("dedup_full_row", f"WITH {_FULL_SQL} SELECT DISTINCT * FROM whole")
def dedup_full_row(spark, d):
    return dd.drop_full_duplicates(_whole(spark, d), FULL)


@query("dup_stats", f"""WITH {_FULL_SQL}, {_FULL_GROUPS}
SELECT CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS extra_rows, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_involved,
count(*) FILTER (WHERE n > 1) AS groups FROM g""")
def dup_stats(spark, d):
    return dd.duplicate_stats(_whole(spark, d), FULL)


@query("label_conflicts", f"""WITH {_DUP_SQL} SELECT user_id, k, count(DISTINCT event_type) AS labels, count(*) AS rows,
min(event_type) AS first_label, max(event_type) AS last_label FROM dup GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 1""")
def label_conflicts(spark, d):
    return dd.label_conflicts(_dup(spark, d), ["user_id", "k"], "event_type")


@query("dup_hash", f"""WITH {_FULL_SQL}, {_FULL_GROUPS}
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g""")
def dup_hash(spark, d):
    return dd.duplicate_hash_count(_whole(spark, d), FULL)


@query("distinct_pairs", f"WITH {m.flows_sql(['label', 'protocol'])} SELECT DISTINCT label, protocol FROM flows")
def distinct_pairs(spark, d):
    return m.flows(spark, d, ["label", "protocol"]).distinct()


# ---- key joins and set operations ------------------------------------------------------------------------

@query("join_row_id_1to1", f"""WITH {m.flows_sql(["row_id", "timestamp", "label", "Tot Fwd Pkts"])} SELECT row_id, timestamp, label, "Tot Fwd Pkts" AS fwd FROM flows""")
def join_row_id_1to1(spark, d):
    feats = m.flows(spark, d, ["row_id", "Tot Fwd Pkts"]).withColumnRenamed("Tot Fwd Pkts", "fwd")
    return feats.join(m.flows(spark, d, ["row_id", "label"]), "row_id").join(m.flows(spark, d, ["row_id", "timestamp"]), "row_id")


@query("join_alignment", """SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(*) FROM lineitem) AS right_rows,
(SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS left_repeated,
(SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS right_repeated,
(SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS left_only,
(SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS right_only""")
def join_alignment(spark, d):
    return dd.alignment(m.table(spark, d, "orders").select(F.col("o_orderkey").alias("key")),
                        m.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("key_set_diff", """WITH a AS (SELECT DISTINCT o_custkey AS key FROM orders), b AS (SELECT DISTINCT c_custkey AS key FROM customer)
SELECT (SELECT count(*) FROM a WHERE key NOT IN (SELECT key FROM b)) AS left_only, (SELECT count(*) FROM b WHERE key NOT IN (SELECT key FROM a)) AS right_only,
(SELECT count(*) FROM a WHERE key IN (SELECT key FROM b)) AS "both" """)
def key_set_diff(spark, d):
    return dd.key_overlap(m.table(spark, d, "orders").select(F.col("o_custkey").alias("key")),
                          m.table(spark, d, "customer").select(F.col("c_custkey").alias("key")), ["key"])


@query("except_rows", """WITH a AS (SELECT o_custkey AS x, o_orderstatus AS s FROM orders), b AS (SELECT user_id AS x, substr(upper(event_type), 1, 1) AS s FROM events)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right""")
def except_rows(spark, d):
    a = m.table(spark, d, "orders").select(F.col("o_custkey").alias("x"), F.col("o_orderstatus").alias("s"))
    b = m.table(spark, d, "events").select(F.col("user_id").alias("x"), F.substring(F.upper("event_type"), 1, 1).alias("s"))
    return dd.difference_counts(a, b, ["x", "s"])


@query("table_fingerprint", "SELECT count(*) AS rows, 0 AS changed FROM lineitem")
def table_fingerprint(spark, d):
    """The fingerprint itself is engine-specific; what is compared is that two differently ordered reads agree."""
    li = m.table(spark, d, "lineitem")
    a = dd.fingerprint(li, li.columns)
    b = dd.fingerprint(li.repartition("l_suppkey"), li.columns).select(
        F.col("hash_xor").alias("x2"), F.col("hash_sum").alias("s2"))
    same = (F.col("hash_xor") == F.col("x2")) & (F.col("hash_sum") == F.col("s2"))
    return a.crossJoin(F.broadcast(b)).select("rows", F.when(same, 0).otherwise(1).alias("changed"))


@query("union_days", f"""WITH {m.flows_sql(["row_id", "timestamp", "label"])} SELECT CASE WHEN timestamp < TIMESTAMP '2024-01-16' THEN 'first' ELSE 'second' END AS capture_day, row_id, label FROM flows""")
def union_days(spark, d):
    df = m.flows(spark, d, ["row_id", "timestamp", "label"])
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    a = df.where(F.col("timestamp") < cut).withColumn("capture_day", F.lit("first"))
    b = df.where(F.col("timestamp") >= cut).withColumn("capture_day", F.lit("second"))
    return a.unionByName(b).select("capture_day", "row_id", "label")


