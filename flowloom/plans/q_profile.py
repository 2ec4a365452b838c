"""Queries: column inventory, leakage evidence, correlations, distributions, identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import c
from ..operators import dedup as dd
from ..operators import cleaning as cl
from ..operators import profiling as pf
from ..operators import validation as vd
from ..schema import ATTACK, BENIGN, DST_PORT, EXCLUDED, FEATURES, LABEL, PROTOCOL, RAW_COLUMNS, TIMESTAMP
from ..sources import tables as tb
from . import mapping as m
from .registry import query

LABELS = [BENIGN, ATTACK, "SSH-Bruteforce"]
Q = chr(39)


def _r(df, names, k=6):
    return df.select(*[F.round(x, k).alias(x) if x in names else F.col(x) for x in df.columns])


def _inv_sql(x, numeric=True):
    if not numeric:
        return (f"SELECT '{x}' AS column_name, count(DISTINCT \"{x}\") AS num_unique, round(count(DISTINCT \"{x}\") / CAST(count(*) AS DOUBLE) * 100, 6) AS pct_unique, count(*) - count(\"{x}\") AS missing, "
                f"round((count(*) - count(\"{x}\")) / CAST(count(*) AS DOUBLE) * 100, 6) AS missing_pct, 0 AS infinite, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std FROM flows")
    v = f'CAST("{x}" AS DOUBLE)'
    fin = f"(CASE WHEN isfinite({v}) THEN {v} END)"
    nan = f"({v} IS NULL OR isnan({v}))"
    nu = f"count(DISTINCT CASE WHEN NOT isnan({v}) THEN {v} END)"
    return (f"SELECT '{x}' AS column_name, {nu} AS num_unique, round({nu} / CAST(count(*) AS DOUBLE) * 100, 6) AS pct_unique, count(*) FILTER (WHERE {nan}) AS missing, "
            f"round(count(*) FILTER (WHERE {nan}) / CAST(count(*) AS DOUBLE) * 100, 6) AS missing_pct, count(*) FILTER (WHERE isinf({v})) AS infinite, min({fin}) AS min, max({fin}) AS max, "
            f"round(avg({fin}), 6) AS mean, round(stddev_samp({fin}), 4) AS std FROM flows")


@query("column_inventory", f"WITH {m.flows_sql(['label', 'protocol', *FEATURES])} " + " UNION ALL ".join([_inv_sql(x) for x in FEATURES] + [_inv_sql("label", False)]))
def column_inventory(spark, d):
    i = pf.inventory(m.flows(spark, d), FEATURES, ["label"])
    return _r(_r(i, ["mean"], 6), ["std"], 4)


LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe", " UNION ALL ".join(f"SELECT '{x}' AS column_name, count({x}) AS count, round(avg({x}), 5) AS mean, round(stddev_samp({x}), 5) AS std, min({x}) AS min, max({x}) AS max, round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50, round(quantile_cont({x}, 0.75), 6) AS p75 FROM lineitem" for x in LI))
def describe(spark, d):
    t = pf.describe(m.table(spark, d, "lineitem"), LI)
    return _r(_r(t, ["mean", "std"], 5), ["p25", "p50", "p75"], 6)


_PROFILED = [x for x in RAW_COLUMNS if x not in (TIMESTAMP, LABEL)]
#: Columns whose counts are one aggregate: more would be a method that the JVM does not compile.
AT_ONCE = 13


@query("profile_csv", f"""WITH {m.raw_text_sql(RAW_COLUMNS)},
x AS (UNPIVOT (SELECT {", ".join(f'"{x}"' for x in _PROFILED)} FROM rawt) ON COLUMNS(*) INTO NAME column_name VALUE v)
SELECT column_name, count(*) AS rows, count(*) FILTER (WHERE trim(v) = '') AS missing, count(*) FILTER (WHERE trim(v) <> '' AND NOT coalesce(isfinite(TRY_CAST(v AS DOUBLE)), false)) AS numeric_issues,
(SELECT count(DISTINCT "Label") FROM rawt) AS labels, (SELECT count(*) FROM events WHERE event_id % 307 = 5 OR event_id % 311 = 6) AS malformed_rows,
(SELECT count(*) FROM rawt) - (SELECT count(*) FROM (SELECT DISTINCT {", ".join(f'"{x}"' for x in RAW_COLUMNS)} FROM rawt)) AS duplicate_rows FROM x GROUP BY 1""")
def profile_csv(spark, d):
    """Profile of written CSV files: row, missing and numeric-issue counts of all columns, labels, malformed lines, rows that repeat others."""
    from ..operators.reports import column_report
    from .q_tables import _staged_csv

    parsed = tb.read_flow_csv(spark, _staged_csv(spark, d))
    # parsed once; the counts below read only the columns that they need
    raw = spark.read.schema(parsed.schema).parquet(tb.write_stage(parsed, tb.staging_dir(spark, "parsed_csv")))
    bad = lambda x: ~F.coalesce(F.abs(c(x).try_cast("double")) < float("inf"), F.lit(False))
    empty = lambda x: c(x).isNull() | (F.trim(c(x)) == "")
    good = tb.good_rows(raw)
    counts = {"rows": lambda x: F.count(F.lit(1)), "missing": lambda x: F.count_if(empty(x)), "numeric_issues": lambda x: F.count_if(~empty(x) & bad(x))}
    rep = None
    for i in range(0, len(_PROFILED), AT_ONCE):
        part = column_report(good, _PROFILED[i:i + AT_ONCE], counts)
        rep = part if rep is None else rep.unionByName(part)
    labels = good.select(c(LABEL)).distinct().agg(F.count(LABEL).alias("labels"))
    lines = tb.rejected_lines(raw).agg(F.count(F.lit(1)).alias("malformed_rows"))
    repeats = dd.duplicate_stats(dd.repeat_suspects(good, RAW_COLUMNS), RAW_COLUMNS).select(F.col("extra_rows").alias("duplicate_rows"))
    return rep.crossJoin(F.broadcast(labels)).crossJoin(F.broadcast(lines)).crossJoin(F.broadcast(repeats))


@query("profile_labels", f"""WITH {m.raw_text_sql([LABEL])} SELECT trim("Label") AS label, count(*) AS n, round(100 * count(*) / CAST((SELECT count(*) FROM rawt) AS DOUBLE), 6) AS pct FROM rawt GROUP BY 1""")
def profile_labels(spark, d):
    """Label counts of the written CSV files, header lines among the data included, as the files have them."""
    from .q_tables import _staged_csv

    per = tb.good_rows(tb.read_flow_csv(spark, _staged_csv(spark, d))).groupBy(F.trim(c(LABEL)).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    all_rows = per.agg(F.sum("n").alias("_n"))
    return per.crossJoin(F.broadcast(all_rows)).select("label", "n", F.round(100 * F.col("n") / F.col("_n"), 6).alias("pct"))


_HEADERS = f"""{m.raw_text_sql([DST_PORT, TIMESTAMP, LABEL, "Flow Byts/s"])}, h AS (SELECT row_id, "Dst Port" AS a, "Timestamp" AS b, "Label" AS c, "Flow Byts/s" AS d FROM rawt WHERE "Label" = 'Label')"""


def _header_rows(spark, d):
    """Header lines that stand among the data, each with its cells."""
    raw = m.raw_text(spark, d)
    return raw.where(c(LABEL) == LABEL).select("row_id", F.array(*[c(x) for x in RAW_COLUMNS]).alias("cells"))


@query("name_detect", f"WITH {_HEADERS} SELECT c AS label_column, b AS timestamp_column, count(*) AS headers FROM h GROUP BY 1, 2")
def name_detect(spark, d):
    """Label and time column of every header line found among the rows."""
    h = _header_rows(spark, d)
    return h.select(pf.detect_cell("cells", pf.LABEL_NAMES).alias("label_column"), pf.detect_cell("cells", pf.TIME_NAMES).alias("timestamp_column")).groupBy(
        "label_column", "timestamp_column").agg(F.count(F.lit(1)).alias("headers"))


CONST = FEATURES


@query("constant_columns", f"""WITH {m.flows_sql(CONST)}, f AS ({" UNION ALL ".join(f"SELECT '{x}' AS column_name, CAST(" + '"' + x + '"' + f" AS VARCHAR) AS v, count(*) AS n FROM flows GROUP BY 2" for x in CONST)}),
s AS (SELECT column_name, count(*) FILTER (WHERE v IS NOT NULL AND v <> 'nan') AS num_unique, max(n) AS top, sum(n) AS r FROM f GROUP BY 1)
SELECT column_name, CASE WHEN num_unique <= 1 THEN 'CONSTANT' ELSE 'NEAR_CONSTANT' END AS status, num_unique, round(top / CAST(r AS DOUBLE), 6) AS dominant_fraction FROM s WHERE num_unique <= 1 OR top / CAST(r AS DOUBLE) >= 0.99""")
def constant_columns(spark, d):
    return pf.constant_columns(m.flows(spark, d, CONST), CONST)


_ct = ", ".join(f"count(*) FILTER (WHERE label = '{x}') AS \"{x}\"" for x in LABELS)


@query("crosstab_hour_label", f"""WITH {m.flows_sql(['timestamp', 'label'])} SELECT CAST(hour(timestamp) AS INTEGER) AS hour_of_day, {_ct},
CASE WHEN count(*) FILTER (WHERE label = 'Infilteration') = 0 AND count(*) FILTER (WHERE label = 'Benign') > 0 THEN 'benign_only' WHEN count(*) FILTER (WHERE label = 'Benign') = 0 AND count(*) FILTER (WHERE label = 'Infilteration') > 0 THEN 'attack_only' ELSE 'mixed' END AS purity FROM flows GROUP BY 1""")
def crosstab_hour_label(spark, d):
    t = pf.crosstab(m.flows(spark, d, ["timestamp", "label"]), F.hour("timestamp"), "label", LABELS, "hour_of_day")
    return pf.pure_hours(t, BENIGN, ATTACK)


@query("crosstab_protocol_label", f"WITH {m.flows_sql(['protocol', 'label'])} SELECT protocol, {_ct} FROM flows GROUP BY 1")
def crosstab_protocol_label(spark, d):
    return pf.crosstab(m.flows(spark, d, ["protocol", "label"]), F.col("protocol"), "label", LABELS, "protocol")


@query("identifier_purity", f"WITH {m.flows_sql(['dst_port', 'label'])}, n AS (SELECT dst_port, label, count(*) AS n FROM flows GROUP BY 1, 2), v AS (SELECT dst_port, max(n) AS mx, sum(n) AS s FROM n GROUP BY 1) SELECT count(*) AS num_values, round(sum(mx) / CAST(sum(s) AS DOUBLE), 6) AS weighted_purity FROM v")
def identifier_purity(spark, d):
    return _r(pf.identifier_purity(m.flows(spark, d, ["dst_port", "label"]), "dst_port", "label"), ["weighted_purity"])


CORR = FEATURES
_fin = lambda x: f'(CASE WHEN isfinite(CAST("{x}" AS DOUBLE)) THEN CAST("{x}" AS DOUBLE) END)'
_corr1 = " UNION ALL ".join(f"SELECT '{x}' AS column_name, corr({_fin(x)}, CASE WHEN label = 'Infilteration' THEN 1.0E0 ELSE 0.0E0 END) AS correlation, min({_fin(x)}) < max({_fin(x)}) AS varies FROM flows" for x in CORR)


@query("feature_label_corr", f"WITH {m.flows_sql(['label', *CORR])}, r AS ({_corr1}) SELECT column_name, round(correlation, 6) AS correlation FROM r WHERE varies AND NOT isnan(correlation) ORDER BY round(abs(correlation), 9) DESC, column_name LIMIT 15")
def feature_label_corr(spark, d):
    r = pf.feature_label_correlation(m.flows(spark, d, ["label", *CORR]), CORR, F.col("label") == ATTACK)
    return _r(pf.top_correlations(r), ["correlation"])


_pairs = [(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1:]]
_corr2 = ", ".join(f"{{'column_a': '{a}', 'column_b': '{b}', 'correlation': corr(\"{a}\", \"{b}\")}}" for a, b in _pairs)


@query("corr_pairs", f"WITH {m.flows_sql(CORR)}, z AS (SELECT {', '.join(f'{_fin(x)} AS {chr(34)}{x}{chr(34)}' for x in CORR)} FROM flows), r AS (SELECT unnest([{_corr2}], recursive := true) FROM z) SELECT column_a, column_b, round(correlation, 6) AS correlation FROM r WHERE NOT isnan(correlation) AND abs(correlation) >= 0.95")
def corr_pairs(spark, d):
    return _r(pf.correlated_pairs(m.flows(spark, d, CORR), CORR), ["correlation"])


CLASSED = [TIMESTAMP, LABEL, DST_PORT, PROTOCOL, *FEATURES, *EXCLUDED]


@query("classify_columns", f"""WITH {m.flows_sql(FEATURES).replace(" flows AS (", " fl AS (")}, flows AS (SELECT *, {", ".join(f'0 AS "{x}"' for x in EXCLUDED)} FROM fl), s AS ({" UNION ALL ".join(f"SELECT '{x}' AS column_name, (SELECT count(DISTINCT " + '"' + x + '"' + f") FROM flows) AS u, (SELECT max(n) FROM (SELECT count(*) AS n FROM flows GROUP BY " + '"' + x + '"' + ")) / CAST((SELECT count(*) FROM flows) AS DOUBLE) AS share" for x in CLASSED[4:])})
SELECT column_name, CASE WHEN u <= 1 OR share >= 0.99 THEN 'CONSTANT_OR_NEAR_CONSTANT' ELSE 'NETWORK_FEATURE' END AS category, NOT (u <= 1 OR share >= 0.99) AS core FROM s
UNION ALL SELECT * FROM (VALUES ('Timestamp', 'TIMESTAMP', false), ('Label', 'TARGET', false), ('Dst Port', 'NETWORK_IDENTIFIER', false), ('Protocol', 'NETWORK_IDENTIFIER', true))""")
def classify_columns(spark, d):
    f = m.flows(spark, d, ["row_id", *FEATURES]).withColumns({x: F.lit(0) for x in EXCLUDED})
    names = f.sparkSession.createDataFrame([(x,) for x in CLASSED], "column_name string")
    return pf.classify_columns(names, pf.constant_columns(f, CLASSED[4:]))


@query("value_counts", f"WITH {m.flows_sql(['label', 'protocol'])} SELECT label, protocol, count(*) AS n FROM flows GROUP BY 1, 2")
def value_counts(spark, d):
    return m.flows(spark, d, ["label", "protocol"]).groupBy("label", "protocol").agg(F.count(F.lit(1)).alias("n"))


@query("implausible_ts", f"WITH {m.flows_sql(['row_id', 'timestamp', 'capture_day'])} SELECT CAST(capture_day AS VARCHAR) AS capture_day, count(*) AS n, min(timestamp) AS lo, max(timestamp) AS hi FROM flows WHERE timestamp < TIMESTAMP '2024-01-02' OR timestamp > TIMESTAMP '2024-01-30' GROUP BY 1")
def implausible_ts(spark, d):
    bad = cl.implausible(m.flows(spark, d, ["row_id", "timestamp", "capture_day"]), "timestamp", "2024-01-02 00:00:00", "2024-01-30 00:00:00")
    return bad.groupBy(F.col("capture_day").cast("string").alias("capture_day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))


@query("temporal_report", """WITH f AS (SELECT event_id AS row_id, date_trunc('hour', ts) AS t FROM events), n AS (SELECT t, count(*) AS n FROM f GROUP BY 1), l AS (SELECT t, lag(t) OVER (ORDER BY row_id) AS p FROM f)
SELECT min(t) AS min_ts, max(t) AS max_ts, count(*) AS unique_ts, count(*) FILTER (WHERE n > 1) AS repeated_ts, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_at_repeated_ts,
min(n) AS obs_min, max(n) AS obs_max, round(avg(n), 4) AS obs_mean, quantile_cont(n, 0.5) AS obs_median, (SELECT count(*) FROM l WHERE t < p) = 0 AS monotonic FROM n""")
def temporal_report(spark, d):
    f = m.table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t"))
    return pf.time_report(f, "t", "row_id")


IDENT = ["Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Subflow Fwd Pkts", "Subflow Bwd Pkts", "Subflow Fwd Byts", "Subflow Bwd Byts",
         "Fwd Seg Size Avg", "Bwd Seg Size Avg", "Fwd Pkt Len Mean", "Bwd Pkt Len Mean", "Fwd Seg Size Min", "Fwd Pkt Len Min", "Bwd Pkt Len Min", "Fwd Pkt Len Max",
         "Bwd Pkt Len Max", "Pkt Len Max", "Pkt Len Min", "Pkt Size Avg", "Pkt Len Mean", "Down/Up Ratio"]
_n = lambda x: f'"{x}"'
_EX = {"subflow_fwd_pkts_eq_tot_fwd_pkts": ("Subflow Fwd Pkts", _n("Tot Fwd Pkts")), "subflow_fwd_byts_eq_totlen_fwd_pkts": ("Subflow Fwd Byts", _n("TotLen Fwd Pkts")),
       "subflow_bwd_pkts_eq_tot_bwd_pkts": ("Subflow Bwd Pkts", _n("Tot Bwd Pkts")), "subflow_bwd_byts_eq_totlen_bwd_pkts": ("Subflow Bwd Byts", _n("TotLen Bwd Pkts")),
       "down_up_ratio_eq_int_bwd_over_fwd": ("Down/Up Ratio", 'CASE WHEN "Tot Fwd Pkts" > 0 THEN "Tot Bwd Pkts" // "Tot Fwd Pkts" ELSE 0 END'),
       "pkt_len_max_eq_max_fwd_bwd": ("Pkt Len Max", 'greatest("Fwd Pkt Len Max", "Bwd Pkt Len Max")'),
       "pkt_len_min_eq_min_fwd_bwd_naive": ("Pkt Len Min", 'least("Fwd Pkt Len Min", "Bwd Pkt Len Min")')}
_CL = {"fwd_seg_size_avg_eq_fwd_pkt_len_mean": ("Fwd Seg Size Avg", _n("Fwd Pkt Len Mean")), "bwd_seg_size_avg_eq_bwd_pkt_len_mean": ("Bwd Seg Size Avg", _n("Bwd Pkt Len Mean")),
       "fwd_seg_size_min_eq_fwd_pkt_len_min": ("Fwd Seg Size Min", _n("Fwd Pkt Len Min")), "pkt_size_avg_eq_pkt_len_mean": ("Pkt Size Avg", _n("Pkt Len Mean")),
       "fwd_pkt_len_mean_eq_totlen_over_count": ("Fwd Pkt Len Mean", '"TotLen Fwd Pkts" / CAST(nullif("Tot Fwd Pkts", 0) AS DOUBLE)'),
       "bwd_pkt_len_mean_eq_totlen_over_count": ("Bwd Pkt Len Mean", '"TotLen Bwd Pkts" / CAST(nullif("Tot Bwd Pkts", 0) AS DOUBLE)')}
CHECK_SQL = "chk AS (" + " UNION ALL ".join(
    [f"SELECT '{k}' AS check_name, count(*) FILTER (WHERE \"{a}\" = {b}) AS matches, count(*) AS total, CAST(NULL AS DOUBLE) AS max_abs_diff FROM flows" for k, (a, b) in _EX.items()]
    + [f"SELECT '{k}', count(*) FILTER (WHERE abs(\"{a}\" - {b}) < 1e-6), count(*), CAST(max(abs(\"{a}\" - {b})) AS DOUBLE) FROM flows" for k, (a, b) in _CL.items()]) + ")"


@query("consistency_checks", f"WITH {m.flows_sql(IDENT)}, {CHECK_SQL} SELECT check_name, matches, total, round(matches / CAST(total AS DOUBLE), 8) AS match_rate, round(max_abs_diff, 6) AS max_abs_diff FROM chk")
def consistency_checks(spark, d):
    return _r(_r(pf.consistency_checks(m.flows(spark, d, IDENT)), ["match_rate"], 8), ["max_abs_diff"])


_RT = {"Flow Byts/s": '"TotLen Fwd Pkts" + "TotLen Bwd Pkts"', "Flow Pkts/s": '"Tot Fwd Pkts" + "Tot Bwd Pkts"', "Fwd Pkts/s": '"Tot Fwd Pkts"', "Bwd Pkts/s": '"Tot Bwd Pkts"'}
RATE_IN = ["Flow Duration", "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Tot Fwd Pkts", "Tot Bwd Pkts", *_RT]


@query("rate_checks", f"WITH {m.flows_sql(RATE_IN)} " + " UNION ALL ".join(
    f"""SELECT '{x}' AS column_name, count(*) FILTER (WHERE isinf("{x}")) AS inf_total, count(*) FILTER (WHERE isinf("{x}") AND "Flow Duration" = 0) AS inf_zero_duration, count(*) FILTER (WHERE isinf("{x}") AND "Flow Duration" <> 0) AS inf_nonzero_duration,
count(*) FILTER (WHERE "Flow Duration" = 0) AS zero_duration_rows, count(*) FILTER (WHERE "Flow Duration" = 0 AND {e} = 0) AS zero_numerator_rows, count(*) FILTER (WHERE "Flow Duration" = 0 AND {e} = 0 AND isinf("{x}")) AS of_those_inf FROM flows""" for x, e in _RT.items()))
def rate_checks(spark, d):
    return pf.rate_checks(m.flows(spark, d, RATE_IN))


RANGE_IN = ["Init Fwd Win Byts", "Init Bwd Win Byts", "Flow Duration", "Active Max", "Idle Max", "Pkt Len Min", "Fwd Pkt Len Min", "Bwd Pkt Len Min", "Tot Bwd Pkts"]


@query("range_checks", f"""WITH {m.flows_sql(RANGE_IN)} SELECT count(*) FILTER (WHERE "Init Fwd Win Byts" = -1) AS init_fwd_minus1, min("Init Fwd Win Byts") AS init_fwd_min, count(*) FILTER (WHERE "Init Bwd Win Byts" = -1) AS init_bwd_minus1,
min("Init Bwd Win Byts") AS init_bwd_min, max("Flow Duration") AS flow_duration_max, max("Active Max") AS active_max_max, max("Idle Max") AS idle_max_max,
count(*) FILTER (WHERE "Pkt Len Min" <> least("Fwd Pkt Len Min", "Bwd Pkt Len Min") AND "Tot Bwd Pkts" <> 0) AS len_min_mismatch_unexplained FROM flows""")
def range_checks(spark, d):
    return pf.range_checks(m.flows(spark, d, RANGE_IN))


_cond = {"udp_value_8": ("protocol = 17", "v = 8"), "protocol0_value_0": ("protocol = 0", "v = 0"), "tcp_ge20_multiple_of_4": ("protocol = 6", "v >= 20 AND v % 4 = 0")}


@query("conditional_checks", f"""WITH {m.flows_sql(['protocol', 'Fwd Seg Size Min'])}, x AS (SELECT protocol, "Fwd Seg Size Min" AS v FROM flows) """ + " UNION ALL ".join(
    f"SELECT '{k}' AS check_name, count(*) FILTER (WHERE {p} AND {q}) AS matches, count(*) FILTER (WHERE {p}) AS total, round(count(*) FILTER (WHERE {p} AND {q}) / CAST(count(*) FILTER (WHERE {p}) AS DOUBLE), 8) AS match_rate FROM x" for k, (p, q) in _cond.items()))
def conditional_checks(spark, d):
    return _r(pf.conditional_checks(m.flows(spark, d, ["protocol", "Fwd Seg Size Min"])), ["match_rate"], 8)


_BYTES = '("TotLen Fwd Pkts" + "TotLen Bwd Pkts")'
_SINCE = '"Flow Duration" = 0 AND'
MORE_SQL = f"""more AS (SELECT 'pkt_len_mean_eq_totlen_over_count' AS check_name, count(*) FILTER (WHERE abs("Pkt Len Mean" - {_BYTES} / CAST(nullif("Tot Fwd Pkts" + "Tot Bwd Pkts", 0) AS DOUBLE)) < 1e-6) AS matches, count(*) AS total FROM flows
 UNION ALL SELECT 'rate_convention__Flow Byts/s', count(*) FILTER (WHERE isinf("Flow Byts/s") AND {_SINCE} {_BYTES} > 0), count(*) FILTER (WHERE isinf("Flow Byts/s") OR {_SINCE} {_BYTES} > 0) FROM flows
 UNION ALL SELECT 'rate_convention__Flow Pkts/s', count(*) FILTER (WHERE isinf("Flow Pkts/s") AND {_SINCE} "Tot Fwd Pkts" + "Tot Bwd Pkts" > 0), count(*) FILTER (WHERE isinf("Flow Pkts/s") OR {_SINCE} "Tot Fwd Pkts" + "Tot Bwd Pkts" > 0) FROM flows
 UNION ALL SELECT 'rate_convention__Fwd Pkts/s', count(*) FILTER (WHERE NOT isinf("Fwd Pkts/s")), count(*) FROM flows UNION ALL SELECT 'rate_convention__Bwd Pkts/s', count(*) FILTER (WHERE NOT isinf("Bwd Pkts/s")), count(*) FROM flows
 UNION ALL SELECT 'init_fwd_win_byts_minus1_present', CASE WHEN bool_or("Init Fwd Win Byts" = -1) THEN 1 ELSE 0 END, 1 FROM flows UNION ALL SELECT 'init_bwd_win_byts_minus1_present', CASE WHEN bool_or("Init Bwd Win Byts" = -1) THEN 1 ELSE 0 END, 1 FROM flows)"""
# Standings as numbers, best first; the rules are said anew here, by the shape of the names.
_RULE_SQL = """ru AS (SELECT feature, CASE WHEN feature LIKE '%Header Len' OR feature = 'Fwd Seg Size Min' THEN 'D' WHEN feature IN ('Bwd Pkt Len Mean', 'Pkt Len Mean', 'Pkt Size Avg', 'Flow Byts/s', 'Fwd Pkts/s', 'Bwd Pkts/s', 'Bwd Seg Size Avg') THEN 'C'
 WHEN feature LIKE 'Init %' OR feature IN ('Fwd Pkt Len Mean', 'Pkt Len Max', 'Pkt Len Min', 'Down/Up Ratio', 'Flow Pkts/s', 'Fwd Seg Size Avg') THEN 'A' ELSE 'B' END AS classification,
 CASE WHEN feature LIKE 'Subflow %' THEN 'subflow_' || lower(split_part(feature, ' ', 2)) || '_' || lower(split_part(feature, ' ', 3)) || CASE WHEN feature LIKE '%Pkts' THEN '_eq_tot_' ELSE '_eq_totlen_' END || lower(split_part(feature, ' ', 2)) || '_pkts'
  WHEN feature LIKE '%/s' THEN 'rate_convention__' || feature WHEN feature LIKE '_wd Seg Size Avg' THEN lower(replace(feature, ' ', '_')) || '_eq_' || lower(left(feature, 3)) || '_pkt_len_mean' WHEN feature LIKE '%Pkt Len Mean' THEN lower(replace(feature, ' ', '_')) || '_eq_totlen_over_count'
  WHEN feature LIKE 'Init %' THEN lower(replace(feature, ' ', '_')) || '_minus1_present' WHEN feature = 'Pkt Len Max' THEN 'pkt_len_max_eq_max_fwd_bwd' WHEN feature = 'Pkt Len Min' THEN 'pkt_len_min_eq_min_fwd_bwd_naive'
  WHEN feature = 'Pkt Size Avg' THEN 'pkt_size_avg_eq_pkt_len_mean' WHEN feature = 'Down/Up Ratio' THEN 'down_up_ratio_eq_int_bwd_over_fwd' WHEN feature = 'Fwd Seg Size Min' THEN 'fwd_seg_size_min_eq_fwd_pkt_len_min' END AS check_name,
 CASE WHEN feature LIKE 'Subflow %Pkts' THEN 'Tot ' || split_part(feature, ' ', 2) || ' Pkts' WHEN feature LIKE 'Subflow %' THEN 'TotLen ' || split_part(feature, ' ', 2) || ' Pkts' WHEN feature LIKE '_wd Pkt Len M__' OR feature LIKE '_wd Pkt Len Std' OR feature LIKE '_wd Seg Size Avg' THEN left(feature, 3) || ' Pkt Len Mean'
  WHEN feature IN ('Pkt Len Std', 'Pkt Len Var', 'Pkt Size Avg') THEN 'Pkt Len Mean' END AS base,
 CASE WHEN feature LIKE '%IAT%' OR feature LIKE 'Active %' OR feature LIKE 'Idle %' OR feature LIKE '%Header Len' OR feature = 'Fwd Act Data Pkts' THEN 2 WHEN feature LIKE 'Init %' THEN 1 ELSE 0 END AS passed FROM f),
own AS (SELECT ru.*, k.matches, k.total, CASE WHEN ru.check_name IS NULL THEN greatest(passed, 1) WHEN k.matches = k.total THEN passed WHEN feature LIKE 'Subflow %' THEN 1 WHEN feature = 'Fwd Seg Size Min' THEN 3 ELSE 2 END AS lvl
 FROM ru LEFT JOIN (SELECT check_name, matches, total FROM chk UNION ALL SELECT * FROM more) k USING (check_name))"""


@query("validation_matrix", f"""WITH {m.flows_sql()}, {CHECK_SQL}, {MORE_SQL}, f(feature) AS (VALUES {", ".join(f"('{x}')" for x in FEATURES)}), {_RULE_SQL},
n(i, s) AS (VALUES (0, 'VALIDATED'), (1, 'PARTIALLY_VALIDATED'), (2, 'UNVALIDATED'), (3, 'NOT_REPRODUCIBLE'))
SELECT o.feature, o.classification, o.check_name, o.matches, o.total, a.s AS own_status, z.s AS status, CASE WHEN b.lvl > o.lvl THEN b.feature END AS inherited_from,
o.feature LIKE 'Fwd %' OR o.feature LIKE 'Bwd %' OR o.feature = 'Down/Up Ratio' AS direction_dependent,
o.feature = 'Flow Duration' OR o.feature LIKE '%IAT%' OR o.feature LIKE 'Active %' OR o.feature LIKE 'Idle %' OR o.feature LIKE '%Pkts/s' OR o.feature LIKE '%Byts/s' AS temporal
FROM own o LEFT JOIN own b ON b.feature = o.base JOIN n a ON a.i = o.lvl JOIN n z ON z.i = greatest(o.lvl, coalesce(b.lvl, 0))""")
def validation_matrix(spark, d):
    return vd.validation_matrix(m.flows(spark, d))


@query("topk_global", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def topk_global(spark, d):
    return pf.top_values(m.table(spark, d, "lineitem"), "l_partkey", 10)


@query("limit_examples", f"WITH {m.raw_text_sql([TIMESTAMP])} SELECT row_id, \"Timestamp\" AS ts_text FROM rawt WHERE try_strptime(\"Timestamp\", '%d/%m/%Y %H:%M:%S') IS NULL ORDER BY row_id LIMIT 20")
def limit_examples(spark, d):
    raw = m.raw_text(spark, d)
    return raw.where(cl.parse_ts(c(TIMESTAMP)).isNull()).orderBy("row_id").limit(20).select("row_id", c(TIMESTAMP).alias("ts_text"))
