"""Queries: stage evidence, rule table, attribution, triage, header checks, comparisons, small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions.numeric import c, evidence_band, ratio, sigmoid, variation
from ..operators import attribution as at
from ..operators import compare as cp
from ..operators import rules as ru
from ..operators import schemas as sh
from ..operators import sequences as sq
from ..operators import triage as tr
from ..operators import windows as wn
from ..schema import FEATURES, PROTOCOL, RAW_COLUMNS, STATE, TIMESTAMP
from . import mapping as m
from . import q_metrics as qm
from . import q_windows as qw
from .registry import query

EV_IN = ["Flow Duration", "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Flow IAT Mean", "Flow IAT Std", "Tot Fwd Pkts", "Tot Bwd Pkts",
         "Flow Byts/s", "Flow Pkts/s", "SYN Flag Cnt", "ACK Flag Cnt"]


def evidence(spark, d, external=False):
    w = qw.windows(spark, d, EV_IN)
    if not external:
        ports = wn.distinct_ports(m.flows(spark, d, ["timestamp", "dst_port"]), m.WIDTH)
        growth = sq.growth_baseline(w, "Flow Pkts/s").select("window_id", "traffic_growth_pct")
        w = w.join(ports, "window_start", "left").join(growth, "window_id", "left")
    return ru.observed_evidence(w, external)


def _ev_sql(external=False):
    none = "CAST(NULL AS DOUBLE)"
    ports = none if external else "CAST(dst_port_nunique AS DOUBLE)"
    growth = none if external else "CASE WHEN g > 0 THEN (\"Flow Pkts/s\" - g) / g * 100.0E0 END"
    inf = none if external else """CASE WHEN "TotLen Fwd Pkts" > 0 THEN CAST('Infinity' AS DOUBLE) END"""
    return f"""{qw.windows_sql(EV_IN)}, prt AS (SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS window_start, count(DISTINCT dst_port) AS dst_port_nunique FROM states GROUP BY 1),
gro AS (SELECT window_id, avg("Flow Pkts/s") OVER (PARTITION BY segment_id ORDER BY window_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS g FROM win),
ev AS (SELECT win.window_id, win.window_start, {ports} AS dst_port_nunique, "Flow Duration" AS flow_duration_mean_us, CAST(observation_count AS DOUBLE) AS observation_count,
 "TotLen Fwd Pkts" / observation_count AS avg_bytes_per_flow, CASE WHEN "Flow IAT Mean" > 0 THEN "Flow IAT Std" / "Flow IAT Mean" END AS flow_iat_coefficient_of_variation,
 "Tot Fwd Pkts" AS tot_fwd_pkts, "Tot Bwd Pkts" AS tot_bwd_pkts, "Flow Byts/s" AS flow_byts_per_s, "Flow Pkts/s" AS flow_pkts_per_s,
 CASE WHEN "TotLen Bwd Pkts" > 0 THEN "TotLen Fwd Pkts" / "TotLen Bwd Pkts" ELSE {inf} END AS outbound_inbound_byte_ratio, {growth} AS traffic_growth_pct,
 CAST(observation_count AS DOUBLE) AS connection_frequency, "SYN Flag Cnt" AS syn_flag_cnt, "ACK Flag Cnt" AS ack_flag_cnt FROM win LEFT JOIN prt USING (window_start) LEFT JOIN gro USING (window_id))"""


_EV_SEL = "window_id, window_start, " + ", ".join(f"round({x}, 4) AS {x}" for x in ru.EVIDENCE)


def _ev_out(df, *keys):
    return df.select(*keys, *[F.round(x, 4).alias(x) for x in ru.EVIDENCE])


@query("stage_evidence_observed", f"WITH {_ev_sql()} SELECT {_EV_SEL} FROM ev")
def stage_evidence_observed(spark, d):
    return _ev_out(evidence(spark, d), "window_id", "window_start")


@query("stage_evidence_external", f"WITH {_ev_sql(True)} SELECT {_EV_SEL} FROM ev")
def stage_evidence_external(spark, d):
    return _ev_out(evidence(spark, d, True), "window_id", "window_start")


# The window one step ahead stands in for a forecast state, so the variant can be checked without a model.
_FC_SQL = f"""{qw.windows_sql(EV_IN)}, fc AS (SELECT a.window_id, b.*, a."Flow Pkts/s" AS seen FROM win a JOIN (SELECT window_id - 1 AS wid, {", ".join('"' + x + '"' for x in EV_IN)} FROM win) b ON b.wid = a.window_id)
SELECT window_id, CAST(NULL AS DOUBLE) AS dst_port_nunique, round("Flow Duration", 4) AS flow_duration_mean_us, CAST(NULL AS DOUBLE) AS observation_count, CAST(NULL AS DOUBLE) AS avg_bytes_per_flow,
round(CASE WHEN "Flow IAT Mean" > 0 THEN "Flow IAT Std" / "Flow IAT Mean" END, 4) AS flow_iat_coefficient_of_variation, round("Tot Fwd Pkts", 4) AS tot_fwd_pkts, round("Tot Bwd Pkts", 4) AS tot_bwd_pkts,
round("Flow Byts/s", 4) AS flow_byts_per_s, round("Flow Pkts/s", 4) AS flow_pkts_per_s, round(CASE WHEN "TotLen Bwd Pkts" > 0 THEN "TotLen Fwd Pkts" / "TotLen Bwd Pkts" WHEN "TotLen Fwd Pkts" > 0 THEN CAST('Infinity' AS DOUBLE) END, 4) AS outbound_inbound_byte_ratio,
round(CASE WHEN seen > 0 THEN ("Flow Pkts/s" - seen) / seen * 100.0E0 END, 4) AS traffic_growth_pct, CAST(NULL AS DOUBLE) AS connection_frequency, round("SYN Flag Cnt", 4) AS syn_flag_cnt, round("ACK Flag Cnt", 4) AS ack_flag_cnt FROM fc"""


def forecast_stand_in(spark, d):
    w = qw.windows(spark, d, EV_IN)
    nxt = w.select((F.col("window_id") - 1).alias("window_id"), *[c(x) for x in EV_IN])
    return w.select("window_id", c("Flow Pkts/s").alias("observed_pkts_per_s")).join(nxt, "window_id")


@query("stage_evidence_forecast", f"WITH {_FC_SQL}")
def stage_evidence_forecast(spark, d):
    return _ev_out(ru.forecast_evidence(forecast_stand_in(spark, d), "window_id"), "window_id")


_CASES = {
    "discovery_score": ["CASE WHEN dst_port_nunique >= 10 THEN 40 ELSE 0 END", "CASE WHEN observation_count >= 5 AND flow_duration_mean_us <= 1000000 THEN 30 ELSE 0 END", "CASE WHEN avg_bytes_per_flow <= 200 THEN 15 ELSE 0 END"],
    "command_and_control_score": ["CASE WHEN flow_iat_coefficient_of_variation <= 0.3E0 THEN 35 ELSE 0 END", "CASE WHEN tot_fwd_pkts > 0 AND tot_bwd_pkts > 0 AND observation_count >= 2 THEN 25 ELSE 0 END"],
    "exfiltration_score": ["CASE WHEN flow_byts_per_s >= 500000 THEN 40 ELSE 0 END", "CASE WHEN outbound_inbound_byte_ratio >= 10 THEN 35 ELSE 0 END"],
    "impact_score": ["CASE WHEN flow_pkts_per_s >= 200 AND traffic_growth_pct >= 150 THEN 50 ELSE 0 END", "CASE WHEN flow_pkts_per_s >= 200 OR flow_byts_per_s >= 500000 OR connection_frequency >= 15 THEN 30 ELSE 0 END"],
    "reconnaissance_score": ["CASE WHEN dst_port_nunique >= 5 AND flow_duration_mean_us <= 1000000 THEN 45 ELSE 0 END"],
    "initial_access_score": ["CASE WHEN syn_flag_cnt > 0 AND ack_flag_cnt < syn_flag_cnt THEN 40 ELSE 0 END"],
    "lateral_movement_score": ["0"],
}
_SC_COLS = ", ".join(f"CAST({' + '.join(v)} AS DOUBLE) AS {k}" for k, v in _CASES.items())
_best = "greatest(" + ", ".join(_CASES) + ")"
_names = ["Discovery", "Command and Control", "Exfiltration", "Impact", "Reconnaissance", "Initial Access", "Lateral Movement"]
_prim = "CASE WHEN best < 30 THEN 'UNKNOWN / INSUFFICIENT_EVIDENCE' " + " ".join(f"WHEN {k} = best THEN '{n}'" for k, n in zip(_CASES, _names)) + " END"
SCORED = f"{_ev_sql()}, sc AS (SELECT *, {_SC_COLS} FROM ev), pr AS (SELECT *, {_prim} AS primary_stage FROM (SELECT *, {_best} AS best FROM sc))"


def scored(spark, d):
    return ru.primary_stage(ru.stage_scores(evidence(spark, d)))


@query("stage_rules", f"WITH {SCORED} SELECT window_id, {', '.join(_CASES)} FROM sc")
def stage_rules(spark, d):
    return scored(spark, d).select("window_id", *_CASES)


@query("primary_stage", f"WITH {SCORED} SELECT window_id, primary_stage, best AS primary_score FROM pr")
def primary_stage(spark, d):
    return scored(spark, d).select("window_id", "primary_stage", "primary_score")


_band = "CASE WHEN {0} < 30 THEN 'LOW' WHEN {0} < 60 THEN 'MEDIUM' WHEN {0} < 80 THEN 'HIGH' ELSE 'VERY HIGH' END"


@query("stage_audit", f"WITH {SCORED} " + " UNION ALL ".join(
    f"SELECT window_id, '{n}' AS stage, {k} AS evidence_score, {_band.format(k)} AS evidence_label, primary_stage = '{n}' AS is_primary FROM pr" for k, n in zip(_CASES, _names)))
def stage_audit(spark, d):
    a = ru.stage_audit(scored(spark, d)).select("window_id", F.explode("stages").alias("stage", "r"))
    return a.select("window_id", "stage", "r.evidence_score", "r.evidence_label", "r.is_primary")


@query("json_ops", f"WITH {SCORED} SELECT window_id, primary_stage, impact_score FROM pr")
def json_ops(spark, d):
    """Audit records as JSON text and back."""
    j = ru.audit_json(ru.stage_audit(scored(spark, d)), "window_id")
    schema = "primary_stage string, stages map<string, struct<technique_id string, evidence_score double, evidence_label string, triggered_rules array<string>, is_primary boolean>>"
    x = j.select("window_id", F.from_json("record", schema).alias("r"))
    return x.select("window_id", "r.primary_stage", F.col("r.stages")["Impact"]["evidence_score"].alias("impact_score"))


_RULE_SQL = [(r.id, r.stage, case) for r, case in zip(ru.RULES, [x for v in _CASES.values() for x in v])]


@query("rule_coverage", f"WITH {_ev_sql()} " + " UNION ALL ".join(
    f"SELECT '{i}' AS rule_id, '{s}' AS stage, count(*) FILTER (WHERE ({k}) > 0) AS times_fired FROM ev" for i, s, k in _RULE_SQL))
def rule_coverage(spark, d):
    return ru.rule_coverage(ru.stage_scores(evidence(spark, d)))


@query("stage_distribution", f"WITH {SCORED} SELECT primary_stage, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM pr) AS DOUBLE), 8) AS share FROM pr GROUP BY 1")
def stage_distribution(spark, d):
    from ..operators.profiling import shares

    return shares(scored(spark, d), "primary_stage").withColumn("share", F.round("share", 8)).orderBy(F.desc("n"))


@query("sparse_evidence_availability", f"WITH {_ev_sql()} " + " UNION ALL ".join(
    f"SELECT '{x}' AS field, round(count({x}) / CAST(count(*) AS DOUBLE) * 100, 6) AS available_pct FROM ev" for x in ru.EVIDENCE))
def sparse_evidence_availability(spark, d):
    return ru.availability(evidence(spark, d)).withColumn("available_pct", F.round("available_pct", 6))


# ---- attribution over embeddings as states ---------------------------------------------------------------

DIM = 64
COEF = [((i * 37) % 21 - 10) / 16 for i in range(DIM)]
INTERCEPT = 0.25
NAMES = [f"f{i}" for i in range(DIM)]
ATTR_SQL = f"""co AS (SELECT [{", ".join(f"{x!r}E0" for x in COEF)}] AS w), cell AS (SELECT vec_id, label, unnest(range({DIM})) AS i, unnest(embedding) AS x, unnest(w) AS w FROM embeddings, co),
ct AS (SELECT vec_id, label, i, CAST(x AS DOUBLE) * w AS v FROM cell)"""


def attributed(spark, d):
    e = m.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("state"))
    return at.linear(e, "state", COEF, INTERCEPT)


@query("attribution_linear", f"WITH {ATTR_SQL} SELECT vec_id, round(sum(v) + {INTERCEPT}E0, 8) AS logit, round(1 / (1 + exp(-(sum(v) + {INTERCEPT}E0))), 8) AS probability, count(*) FILTER (WHERE v > 0) AS toward_attack FROM ct GROUP BY 1")
def attribution_linear(spark, d):
    a = attributed(spark, d)
    up = F.size(F.filter("contributions", lambda x: x > 0)).cast("long")
    return a.select("vec_id", F.round("logit", 8).alias("logit"), F.round("probability", 8).alias("probability"), up.alias("toward_attack"))


@query("attribution_grounding", "SELECT count(*) AS n, true AS grounded FROM embeddings")
def attribution_grounding(spark, d):
    p = sigmoid(ar.dot(F.col("state"), ar.literal_vector(COEF)) + F.lit(INTERCEPT))
    return at.grounding(attributed(spark, d), p).select("n", "grounded")


@query("topk_per_row", f"WITH {ATTR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, i) AS rank FROM ct) SELECT vec_id, CAST(rank AS INTEGER) AS rank, 'f' || i AS feature, round(v, 8) AS contribution, CASE WHEN v > 0 THEN 'attack' WHEN v < 0 THEN 'benign' ELSE 'neutral' END AS direction FROM r WHERE rank <= 5")
def topk_per_row(spark, d):
    t = at.top_contributions(attributed(spark, d), NAMES, 5, "vec_id")
    return t.withColumn("contribution", F.round("contribution", 8))


@query("attribution_global", f"WITH {ATTR_SQL} SELECT CAST(i AS INTEGER) AS feature, round(avg(v), 8) AS mean_contribution, round(avg(abs(v)), 8) AS mean_abs_contribution FROM ct GROUP BY 1")
def attribution_global(spark, d):
    g = at.global_attribution(attributed(spark, d))
    return g.select("feature", *[F.round(x, 8).alias(x) for x in ("mean_contribution", "mean_abs_contribution")])


@query("sigmoid_logit", "SELECT event_id, round(1 / (1 + exp(-(value - 20) / 10)), 8) AS p FROM events")
def sigmoid_logit(spark, d):
    return m.table(spark, d, "events").select("event_id", F.round(sigmoid((F.col("value") - 20) / 10), 8).alias("p"))


@query("dot_contrib", f"WITH {ATTR_SQL} SELECT vec_id, round(sum(v), 8) AS score FROM ct GROUP BY 1")
def dot_contrib(spark, d):
    e = m.table(spark, d, "embeddings")
    return e.select("vec_id", F.round(ar.dot(F.col("embedding").cast("array<double>"), ar.literal_vector(COEF)), 8).alias("score"))


@query("array_ops", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, round(list_avg(v), 8) AS mean, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS argmax, round(list_sum(v[2:]) + 1.0, 8) AS shifted_sum FROM e""")
def array_ops(spark, d):
    v = F.col("embedding").cast("array<double>")
    shifted = F.concat(F.slice(v, 2, DIM - 1), F.array(F.lit(1.0)))
    return m.table(spark, d, "embeddings").select(
        "vec_id", F.round(ar.average(v), 8).alias("mean"), ar.argmax(v).alias("argmax"), F.round(ar.total(shifted), 8).alias("shifted_sum"))


@query("occlusion_rollup", f"WITH {ATTR_SQL} SELECT label, round(avg(v), 8) AS mean_contribution, round(sum(v), 6) AS sum_contribution, round(sum(abs(v)), 6) AS sum_abs_contribution FROM ct GROUP BY 1")
def occlusion_rollup(spark, d):
    cells = attributed(spark, d).select("label", F.explode("contributions").alias("contribution"))
    r = at.rollup(cells, "label")
    return r.select("label", F.round("mean_contribution", 8).alias("mean_contribution"), *[F.round(x, 6).alias(x) for x in ("sum_contribution", "sum_abs_contribution")])


@query("importance_rollup", f"WITH {ATTR_SQL} SELECT 'f' || i AS feature, round(sum(abs(v)), 6) AS sum_importance, round(avg(abs(v)), 8) AS mean_importance, round(max(abs(v)), 8) AS max_importance FROM ct GROUP BY 1")
def importance_rollup(spark, d):
    cells = attributed(spark, d).select("label", F.posexplode("contributions").alias("i", "v"))
    named = cells.select(F.concat(F.lit("t-"), F.col("label"), F.lit("__f"), F.col("i")).alias("name"), F.abs("v").alias("importance"))
    r = at.importance_by(named, 1, "feature")
    return r.select("feature", F.round("sum_importance", 6).alias("sum_importance"), *[F.round(x, 8).alias(x) for x in ("mean_importance", "max_importance")])


@query("occlusion_baseline", f"""WITH {qw.seq_sql(STATE)}, {qw.PURGE_SQL} {" ".join(
    ("" if i == 0 else "UNION ALL ") + ("SELECT" if i else ", x AS (SELECT w.* FROM pseq q JOIN win w ON w.window_id BETWEEN q.input_start_window AND q.input_end_window WHERE q.partition = 'train') SELECT")
    + f" {i} AS feature, round(avg(" + '"' + f + '"' + "), 6) AS baseline FROM x" for i, f in enumerate(STATE))}""")
def occlusion_baseline(spark, d):
    s = qw.partitioned_sequences(spark, d, features=STATE, states=True)
    return at.baseline(s.where("partition = 'train'")).withColumn("baseline", F.round("baseline", 6))


# ---- evidence join and triage ----------------------------------------------------------------------------

STAGE_SQL = """stg AS (SELECT event_id AS sequence_id, CASE WHEN value < 20 THEN 'UNKNOWN / INSUFFICIENT_EVIDENCE' WHEN event_type = 'error' THEN 'Impact' WHEN event_type = 'signup' THEN 'Discovery'
 WHEN event_type = 'view' THEN 'Reconnaissance' ELSE 'Exfiltration' END AS primary_stage, CAST(least(100, floor(value)) AS DOUBLE) AS primary_score FROM events)"""


def stage_table(spark, d):
    return m.table(spark, d, "events").selectExpr(
        "event_id AS sequence_id",
        "CASE WHEN value < 20 THEN 'UNKNOWN / INSUFFICIENT_EVIDENCE' WHEN event_type = 'error' THEN 'Impact' WHEN event_type = 'signup' THEN 'Discovery' "
        "WHEN event_type = 'view' THEN 'Reconnaissance' ELSE 'Exfiltration' END AS primary_stage",
        "CAST(least(100, floor(value)) AS DOUBLE) AS primary_score")


TRIN_SQL = f"""{qm.HORIZON_SQL}, {STAGE_SQL}, pv AS (SELECT sequence_id, max(p) FILTER (WHERE horizon = 1) AS p1, max(p) FILTER (WHERE horizon = 2) AS p2, max(p) FILTER (WHERE horizon = 3) AS p3, max(p) FILTER (WHERE horizon = 5) AS p5 FROM hs GROUP BY 1),
tri AS (SELECT sequence_id, p1, p2, p3, p5, CASE WHEN primary_stage NOT LIKE 'UNKNOWN%' THEN primary_stage END AS stage, CASE WHEN primary_stage NOT LIKE 'UNKNOWN%' THEN primary_score END AS stage_score,
 CASE WHEN primary_stage IN ('Impact', 'Discovery', 'Exfiltration', 'Command and Control') THEN 'mapped' WHEN primary_stage = 'Reconnaissance' THEN 'candidate' END AS stage_status FROM pv FULL JOIN stg USING (sequence_id))"""


@query("triage_inputs", f"WITH {TRIN_SQL} SELECT * FROM tri")
def triage_inputs(spark, d):
    return tr.triage_inputs(qm.horizon_scores(spark, d), stage_table(spark, d))


@query("triage_level", f"""WITH {TRIN_SQL}, {ATTR_SQL}, why AS (SELECT DISTINCT vec_id FROM ct WHERE v > 0.5), a AS (SELECT *, sequence_id IN (SELECT vec_id FROM why) AS attribution_available, coalesce(p5, p3, p2) - p1 AS dl, CASE WHEN p1 >= 0.62 THEN 3 WHEN p1 >= 0.5576 THEN 2 WHEN p1 >= 0.52 THEN 1 ELSE 0 END AS s0 FROM tri),
b AS (SELECT *, CASE WHEN dl IS NULL THEN 'unknown' WHEN dl >= 0.02 THEN 'rising' WHEN dl <= -0.02 THEN 'falling' ELSE 'flat' END AS trend FROM a),
g AS (SELECT *, s0 + CASE WHEN trend = 'rising' THEN 1 WHEN trend = 'falling' AND s0 > 0 THEN -1 ELSE 0 END AS s1 FROM b),
h AS (SELECT *, CASE WHEN stage IS NULL THEN s1 ELSE s1 + CASE WHEN stage_score >= 60 THEN 1 WHEN stage_score < 30 THEN -1 ELSE 0 END + CASE WHEN stage_status = 'candidate' THEN -1 ELSE 0 END + CASE WHEN stage = 'Impact' THEN 1 ELSE 0 END END AS s2 FROM g),
i AS (SELECT *, greatest(0, least(4, s2)) AS s FROM h)
SELECT sequence_id, trend, CASE WHEN p1 IS NULL AND stage IS NULL THEN NULL ELSE s END AS severity,
CASE WHEN p1 IS NULL AND stage IS NULL THEN 'MONITOR' WHEN ((p1 IS NULL OR stage IS NULL) AND s >= 2) OR (p1 IS NOT NULL AND stage IS NOT NULL AND trend = 'falling' AND stage_score >= 60) THEN 'ESCALATE'
 WHEN s = 0 THEN 'MONITOR' WHEN s = 1 THEN 'ALERT' WHEN s = 2 THEN 'RATE_LIMIT' ELSE 'TEMPORARY_BLOCK' END AS level,
CASE WHEN p1 IS NULL AND stage IS NULL THEN 'INSUFFICIENT' ELSE CASE CASE WHEN p1 IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN stage IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN stage_status = 'mapped' THEN 1 ELSE 0 END + CASE WHEN stage_score >= 60 THEN 1 ELSE 0 END + CASE WHEN attribution_available THEN 1 ELSE 0 END
 WHEN 5 THEN 'HIGH' WHEN 4 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END END AS evidence_quality, attribution_available FROM i""")
def triage_level(spark, d):
    """Levels with all evidence joined; a sequence is explained where a cell of its state pushes the score up by more than a half."""
    why = attributed(spark, d).where(F.exists("contributions", lambda v: v > 0.5)).select(F.col("vec_id").alias("sequence_id"))
    t = tr.triage(tr.triage_inputs(qm.horizon_scores(spark, d), stage_table(spark, d), attribution=why), F.col("attribution_available"))
    return t.select("sequence_id", "trend", "severity", "level", "evidence_quality", "attribution_available")


@query("join_evidence", f"WITH {TRIN_SQL} SELECT sequence_id, stage, round(p1, 6) AS p1, round(p5, 6) AS p5, (SELECT count(*) FROM hs WHERE hs.sequence_id = tri.sequence_id) AS horizons FROM tri WHERE p1 IS NOT NULL OR p2 IS NOT NULL OR p3 IS NOT NULL OR p5 IS NOT NULL")
def join_evidence(spark, d):
    """One explanation record per sequence: probabilities by horizon as a map, joined with the stage."""
    probs = qm.horizon_scores(spark, d).groupBy("sequence_id").agg(
        F.map_from_entries(F.collect_list(F.struct("horizon", "p"))).alias("by_horizon"))
    j = probs.join(stage_table(spark, d), "sequence_id")
    stage = F.when(F.col("primary_stage") != ru.UNKNOWN, F.col("primary_stage"))
    return j.select("sequence_id", stage.alias("stage"), F.round(F.try_element_at("by_horizon", F.lit(1)), 6).alias("p1"),
                    F.round(F.try_element_at("by_horizon", F.lit(5)), 6).alias("p5"), F.size("by_horizon").cast("long").alias("horizons"))


# ---- headers ---------------------------------------------------------------------------------------------

# One "file" per source: the known header with the columns of the languages seen in that source renamed.
def _header_table(spark, d):
    docs = m.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(x) for x in RAW_COLUMNS])
    x = docs.select(F.col("source").alias("file"), "n", F.posexplode(names).alias("position", "name"))
    return x.select("file", "position", F.when(F.col("position") < (F.col("n") * 7) % 81, F.concat(F.lit("x_"), F.col("name"))).otherwise(F.col("name")).alias("column_name"))


_known = ", ".join(f"({i}, '{x}')" for i, x in enumerate(RAW_COLUMNS))
_feat = ", ".join(f"'{x}'" for x in FEATURES)
HEAD_SQL = f"""k(position, name) AS (VALUES {_known}), dsrc AS (SELECT source AS file, count(*) AS n FROM documents GROUP BY 1),
hd AS (SELECT file, position, CASE WHEN position < (n * 7) % 81 THEN 'x_' || name ELSE name END AS column_name FROM dsrc, k)"""


@query("schema_family", f"""WITH {HEAD_SQL}, a AS (SELECT file, count(*) FILTER (WHERE column_name IN (SELECT name FROM k)) AS overlap, count(*) FILTER (WHERE column_name NOT IN (SELECT name FROM k)) AS extra, count(*) AS columns FROM hd GROUP BY 1)
SELECT file, overlap, extra, columns, round(overlap / 80.0E0, 6) AS overlap_ratio, CASE WHEN overlap = 80 AND extra = 0 AND columns = 80 THEN 'exact' WHEN overlap / 80.0E0 >= 0.9 THEN 'strong' WHEN overlap / 80.0E0 >= 0.4 THEN 'partial' ELSE 'unrecognized' END AS confidence FROM a""")
def schema_family(spark, d):
    return sh.schema_family(_header_table(spark, d)).withColumn("overlap_ratio", F.round("overlap_ratio", 6))


@query("schema_equal", f"WITH {HEAD_SQL}, ref AS (SELECT position, column_name AS name FROM hd WHERE file = 'src0') SELECT file, count(*) FILTER (WHERE column_name <> ref.name) AS differing, count(*) AS columns, count(*) FILTER (WHERE column_name <> ref.name) = 0 AS equal FROM hd JOIN ref USING (position) GROUP BY 1")
def schema_equal(spark, d):
    return sh.schema_equal(_header_table(spark, d), "src0")


@query("schema_compat", f"""WITH {HEAD_SQL}, a AS (SELECT file, count(*) FILTER (WHERE column_name IN ({_feat})) AS direct, 65 - count(*) FILTER (WHERE column_name IN ({_feat})) AS missing, bool_or(column_name = '{PROTOCOL}') AS protocol, bool_or(column_name = '{TIMESTAMP}') AS timestamp,
bool_or(column_name = 'Label') AS label_available, count(*) FILTER (WHERE column_name LIKE 'x\\_%' ESCAPE '\\') AS unsupported FROM hd GROUP BY 1)
SELECT *, CASE WHEN missing = 0 AND protocol AND timestamp THEN 'SUPPORTED' WHEN missing = 0 THEN 'SUPPORTED_WITH_LIMITATIONS' WHEN missing / 65.0E0 < 0.5 THEN 'REQUIRES_FEATURE_MAPPING' ELSE 'INCOMPATIBLE' END AS status, missing = 0 AND protocol AND timestamp AS ready FROM a""")
def schema_compat(spark, d):
    return sh.schema_compat(_header_table(spark, d))


# ---- comparison of two versions --------------------------------------------------------------------------

#: The second version changes five features by rules over all rows, lacks one, misses some rows and has others of its own.
CHANGED = {"Flow Byts/s": "CASE WHEN isnan({0}) THEN 0.0E0 WHEN dst_port < 30 THEN {0} + 1 ELSE {0} END", "Bwd Pkt Len Mean": "{0} * (1 + CASE WHEN dst_port > 50 THEN 0.0005E0 ELSE 0.5E0 END)",
           "Flow IAT Std": "{0} + 4e-7", "Down/Up Ratio": "{0} + CASE WHEN dst_port % 9 = 4 THEN 1 ELSE 0 END", "Flow Pkts/s": "CASE WHEN dst_port % 20 = 10 THEN -{0} ELSE {0} END"}
UNMAPPED = "Fwd Seg Size Min"
BOTH = [x for x in FEATURES if x != UNMAPPED]
_LEFT_OUT, _OF_ITS_OWN = "row_id % 1009 <> 5", "row_id % 1013 = 7"


def _versions(spark, d):
    a = m.flows(spark, d, ["row_id", "dst_port", *FEATURES])
    b = a.withColumns({k: F.expr(v.format(f"`{k}`")) for k, v in CHANGED.items()}).drop(UNMAPPED)
    return a, b.where(_LEFT_OUT).unionByName(b.where(_OF_ITS_OWN).withColumn("row_id", -F.col("row_id") - 1))


_cells = lambda src, cols, names: f"SELECT row_id, feature, v FROM (SELECT row_id, {cols} FROM {src}) UNPIVOT INCLUDE NULLS (v FOR feature IN ({names}))"
_names = lambda cols: ", ".join(f'"{x}"' for x in cols)
_second = ", ".join(f'CAST({CHANGED.get(x, "{0}").format(chr(34) + x + chr(34))} AS DOUBLE) AS "{x}"' for x in BOTH)
CELL_SQL = f"""{m.flows_sql(["row_id", "dst_port", *FEATURES])}, v1c AS ({_cells("flows", ", ".join(f'CAST("{x}" AS DOUBLE) AS "{x}"' for x in FEATURES), _names(FEATURES))}),
v2 AS (SELECT row_id, {_second} FROM flows WHERE {_LEFT_OUT} UNION ALL SELECT -row_id - 1, {_second} FROM flows WHERE {_OF_ITS_OWN}),
v2c AS ({_cells("v2", _names(BOTH), _names(BOTH))}),
cells AS (SELECT a.row_id, a.feature, a.v AS x, b.v AS y, b.feature IS NOT NULL AS mapped FROM v1c a SEMI JOIN v2 ON v2.row_id = a.row_id LEFT JOIN v2c b ON b.row_id = a.row_id AND b.feature = a.feature),
df0 AS (SELECT *, isinf(x) OR coalesce(isinf(y), false) OR isnan(x) AS odd, coalesce((isinf(x) AND isinf(y)) OR (isnan(x) AND isnan(y)), false) AS same_kind FROM cells),
df1 AS (SELECT row_id, feature, mapped, odd, same_kind, CASE WHEN mapped AND NOT odd THEN abs(x - y) END AS abs_diff, CASE WHEN mapped AND NOT odd THEN CASE WHEN y <> 0 THEN abs(x - y) / abs(y) WHEN abs(x - y) = 0 THEN 0 END END AS rel_diff FROM df0),
df AS (SELECT row_id, feature, mapped, abs_diff, rel_diff, mapped AND CASE WHEN odd THEN same_kind ELSE abs_diff = 0 END AS exact_match, mapped AND CASE WHEN odd THEN same_kind ELSE abs_diff < 1e-6 OR coalesce(rel_diff < 1e-3, false) END AS tolerance_match FROM df1),
sta AS (SELECT *, CASE WHEN NOT mapped THEN 'NOT_REPRODUCIBLE' WHEN exact_match THEN 'VALIDATED' WHEN feature = 'Flow Byts/s' THEN 'UNVALIDATED' WHEN tolerance_match THEN 'PARTIALLY_VALIDATED' ELSE 'UNVALIDATED' END AS status FROM df)"""


def _diffs(spark, d):
    a, b = _versions(spark, d)
    return cp.cell_differences(cp.paired_cells(a, b, ["row_id"], FEATURES))


def _statuses(spark, d):
    causes = spark.createDataFrame([("Flow Byts/s", "other packet length basis")], "feature string, cause string")
    return cp.with_status(_diffs(spark, d), causes)


@query("abs_rel_diff", f"WITH {CELL_SQL} SELECT row_id, feature, round(abs_diff, 6) AS abs_diff, round(rel_diff, 6) AS rel_diff, exact_match, tolerance_match FROM df")
def abs_rel_diff(spark, d):
    # most cells do not differ: rounding goes through decimal text and is left to those that do
    rounded = [F.when(F.col(x) == 0, F.lit(0.0)).otherwise(F.round(x, 6)).alias(x) for x in ("abs_diff", "rel_diff")]
    return _diffs(spark, d).select("row_id", "feature", *rounded, "exact_match", "tolerance_match")


@query("diff_classify", f"WITH {CELL_SQL} SELECT feature, status, count(*) AS n FROM sta GROUP BY 1, 2")
def diff_classify(spark, d):
    return _statuses(spark, d).groupBy("feature", "status").agg(F.count(F.lit(1)).alias("n"))


@query("status_rollup", f"""WITH {CELL_SQL} SELECT feature, count(*) AS rows, CASE WHEN bool_and(status = 'VALIDATED') THEN 'VALIDATED' WHEN bool_or(status = 'NOT_REPRODUCIBLE') THEN 'NOT_REPRODUCIBLE'
WHEN bool_and(status IN ('VALIDATED', 'PARTIALLY_VALIDATED')) THEN 'PARTIALLY_VALIDATED' ELSE 'UNVALIDATED' END AS status FROM sta GROUP BY 1""")
def status_rollup(spark, d):
    return cp.status_rollup(_statuses(spark, d))


@query("before_after_diff", f"""WITH {CELL_SQL}, p AS (SELECT feature, count(*) FILTER (WHERE NOT (x IS NOT DISTINCT FROM y OR (isfinite(x) AND isfinite(y) AND abs(x - y) <= 1e-6))) AS k FROM cells WHERE mapped GROUP BY 1)
SELECT feature, k AS rows_differing, k = 0 AS identical, feature = 'Flow Byts/s' AS expected_to_change, feature <> 'Flow Byts/s' AND k > 0 AS unrelated_change FROM p""")
def before_after_diff(spark, d):
    a, b = _versions(spark, d)
    return cp.before_after(a, b, ["row_id"], FEATURES, ["Flow Byts/s"])


@query("version_coverage", f"""WITH {m.flows_sql(["row_id"])}, v2 AS (SELECT row_id FROM flows WHERE {_LEFT_OUT} UNION ALL SELECT -row_id - 1 FROM flows WHERE {_OF_ITS_OWN})
SELECT count(*) FILTER (WHERE a.row_id = b.row_id) AS matched, count(*) FILTER (WHERE b.row_id IS NULL) AS left_only, count(*) FILTER (WHERE a.row_id IS NULL) AS right_only, 0 AS repeated FROM flows a FULL JOIN v2 b ON a.row_id = b.row_id""")
def version_coverage(spark, d):
    """Rows that the comparison pairs, and rows that only one of the versions has."""
    return cp.key_coverage(*_versions(spark, d), ["row_id"])


# ---- small scalar functions ------------------------------------------------------------------------------

@query("safe_div", f"WITH {m.flows_sql(['row_id', 'Tot Fwd Pkts', 'Tot Bwd Pkts'])} SELECT row_id, round(coalesce(\"Tot Fwd Pkts\" / CAST(nullif(\"Tot Bwd Pkts\", 0) AS DOUBLE), 0.0), 8) AS zero_default, round(\"Tot Fwd Pkts\" / CAST(nullif(\"Tot Bwd Pkts\", 0) AS DOUBLE), 8) AS null_default FROM flows")
def safe_div(spark, d):
    a, b = c("Tot Fwd Pkts"), c("Tot Bwd Pkts")
    return m.flows(spark, d, ["row_id", "Tot Fwd Pkts", "Tot Bwd Pkts"]).select(
        "row_id", F.round(ratio(a, b, 0.0), 8).alias("zero_default"), F.round(ratio(a, b), 8).alias("null_default"))


@query("iat_cv", f"WITH {m.flows_sql(['row_id', 'Flow IAT Mean', 'Flow IAT Std'])} SELECT row_id, round(CASE WHEN \"Flow IAT Mean\" > 0 THEN \"Flow IAT Std\" / \"Flow IAT Mean\" END, 8) AS cv FROM flows")
def iat_cv(spark, d):
    f = m.flows(spark, d, ["row_id", "Flow IAT Mean", "Flow IAT Std"])
    return f.select("row_id", F.round(variation(c("Flow IAT Std"), c("Flow IAT Mean")), 8).alias("cv"))


@query("evidence_band", "SELECT event_id, CASE WHEN value < 30 THEN 'LOW' WHEN value < 60 THEN 'MEDIUM' WHEN value < 80 THEN 'HIGH' ELSE 'VERY HIGH' END AS band FROM events")
def evidence_band_q(spark, d):
    return m.table(spark, d, "events").select("event_id", evidence_band(F.col("value")).alias("band"))


@query("string_ops", """SELECT doc_id, lower(trim(source)) AS source_name, contains(lower(text), 'license') AS mentions, split_part(lang || '__' || source, '__', 2) AS tail,
array_to_string(list_distinct([lang, source, lang]), ' ') IS NOT NULL AS joined FROM documents""")
def string_ops(spark, d):
    parts = F.array_distinct(F.array("lang", "source", "lang"))
    return m.table(spark, d, "documents").select(
        "doc_id", F.lower(F.trim("source")).alias("source_name"), F.lower("text").contains("license").alias("mentions"),
        F.split(F.concat_ws("__", "lang", "source"), "__", 2)[1].alias("tail"), F.array_join(parts, " ").isNotNull().alias("joined"))


@query("sample_even", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS n FROM events) SELECT event_id, pos FROM r WHERE pos IN (SELECT CAST(floor(i * ((n - 1) / 24.0E0)) AS BIGINT) FROM range(25) t(i), (SELECT any_value(n) AS n FROM r))")
def sample_even(spark, d):
    from ..operators.sampling import sample_even as pick

    ev = m.table(spark, d, "events").select("event_id")
    return pick(ev, "event_id", 25, F.floor(F.col("event_id") / 4096)).select("event_id", "pos")


