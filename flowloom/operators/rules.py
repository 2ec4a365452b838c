"""Attack-stage evidence and the transparent rule table, as expressions.

A rule is data: (id, stage, points, predicate over evidence columns). Missing evidence makes a predicate
false. All scores of a row come out of one projection; there is no UDF and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import INF, c, evidence_band, ratio, true_only, variation

# Evidence fields.
EVIDENCE = [
    "dst_port_nunique", "flow_duration_mean_us", "observation_count", "avg_bytes_per_flow",
    "flow_iat_coefficient_of_variation", "tot_fwd_pkts", "tot_bwd_pkts", "flow_byts_per_s", "flow_pkts_per_s",
    "outbound_inbound_byte_ratio", "traffic_growth_pct", "connection_frequency", "syn_flag_cnt", "ack_flag_cnt",
]
# Stages in tie-breaking order with their score caps.
STAGE_CAPS = {
    "Discovery": 100, "Command and Control": 100, "Exfiltration": 100, "Impact": 100,
    "Reconnaissance": 55, "Initial Access": 50, "Lateral Movement": 0,
}
TECHNIQUES = {
    "Discovery": "T1046", "Command and Control": "T1071", "Exfiltration": "T1041", "Impact": "T1498",
    "Reconnaissance": "T1595", "Initial Access": "T1190", "Lateral Movement": "T1021",
}
CANDIDATE_STAGES = ["Reconnaissance", "Initial Access", "Lateral Movement"]
UNKNOWN = "UNKNOWN / INSUFFICIENT_EVIDENCE"
MIN_EVIDENCE = 30


@dataclass(frozen=True)
class Rule:
    id: str
    stage: str
    points: int
    condition: str


# Thresholds and points of the rule table.
RULES = [
    Rule("discovery_high_port_diversity", "Discovery", 40, "dst_port_nunique >= 10"),
    Rule("discovery_repeated_short_flows", "Discovery", 30, "observation_count >= 5 AND flow_duration_mean_us <= 1000000"),
    Rule("discovery_low_bytes_per_flow", "Discovery", 15, "avg_bytes_per_flow <= 200"),
    Rule("c2_regular_beacon_timing", "Command and Control", 35, "flow_iat_coefficient_of_variation <= 0.30D"),
    Rule("c2_persistent_bidirectional_traffic", "Command and Control", 25, "tot_fwd_pkts > 0 AND tot_bwd_pkts > 0 AND observation_count >= 2"),
    Rule("exfil_high_outbound_volume", "Exfiltration", 40, "flow_byts_per_s >= 500000"),
    Rule("exfil_high_outbound_inbound_ratio", "Exfiltration", 35, "outbound_inbound_byte_ratio >= 10"),
    Rule("impact_high_rate_and_growth", "Impact", 50, "flow_pkts_per_s >= 200 AND traffic_growth_pct >= 150"),
    Rule("impact_elevated_volume_or_frequency", "Impact", 30, "flow_pkts_per_s >= 200 OR flow_byts_per_s >= 500000 OR connection_frequency >= 15"),
    Rule("recon_port_scanning_pattern", "Reconnaissance", 45, "dst_port_nunique >= 5 AND flow_duration_mean_us <= 1000000"),
    Rule("initial_access_suspicious_connection_pattern", "Initial Access", 40, "syn_flag_cnt > 0 AND ack_flag_cnt < syn_flag_cnt"),
    Rule("lateral_movement_internal_destination_count", "Lateral Movement", 0, "false"),
]


def stage_key(stage: str) -> str:
    return stage.lower().replace(" ", "_")


def _fired(rule: Rule) -> Column:
    return true_only(F.expr(rule.condition))


def _ids(rules: list[Rule]) -> Column:
    return F.array_compact(F.array(*[F.when(_fired(r), F.lit(r.id)) for r in rules]))


def stage_scores(evidence: DataFrame) -> DataFrame:
    """Adds ``<stage>_score`` for every stage and ``fired``, the ids of all rules that hold, in table order."""
    out = evidence.withColumn("fired", _ids(RULES))
    scores = {}
    for stage, cap in STAGE_CAPS.items():
        points = [F.when(_fired(r), F.lit(r.points)).otherwise(0) for r in RULES if r.stage == stage]
        scores[f"{stage_key(stage)}_score"] = F.least(F.lit(cap), sum(points[1:], points[0])).cast("double")
    return out.withColumns(scores)


def primary_stage(scored: DataFrame) -> DataFrame:
    """Stage with the largest score, ties to the first in table order, unknown below the minimum."""
    ranked = F.array(*[F.struct(F.col(f"{stage_key(s)}_score").alias("v"), F.lit(-i).alias("o"), F.lit(s).alias("s"))
                       for i, s in enumerate(STAGE_CAPS)])
    best = F.array_max(ranked)
    return scored.withColumn("primary_score", best["v"]).withColumn(
        "primary_stage", F.when(best["v"] < MIN_EVIDENCE, F.lit(UNKNOWN)).otherwise(best["s"]))


def stage_audit(scored: DataFrame) -> DataFrame:
    """Adds ``stages``: MAP stage -> struct(technique, score, band, fired rules, is_primary)."""
    entries = []
    for s in STAGE_CAPS:
        v = F.col(f"{stage_key(s)}_score")
        entries += [F.lit(s), F.struct(
            F.lit(TECHNIQUES[s]).alias("technique_id"), F.round(v, 2).alias("evidence_score"), evidence_band(v).alias("evidence_label"),
            _ids([r for r in RULES if r.stage == s]).alias("triggered_rules"), (F.col("primary_stage") == s).alias("is_primary"))]
    return scored.withColumn("stages", F.create_map(*entries))


def audit_json(audited: DataFrame, *keys: str) -> DataFrame:
    return audited.select(*keys, F.to_json(F.struct("primary_stage", "stages")).alias("record"))


def rule_coverage(scored: DataFrame) -> DataFrame:
    """How often each rule fired, 0 for rules that never did; the rule table has a fixed size."""
    n = scored.select(F.explode("fired").alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    rules = scored.sparkSession.createDataFrame([(r.id, r.stage) for r in RULES], "rule_id string, stage string")
    return rules.join(n, "rule_id", "left").select("rule_id", "stage", F.coalesce("n", F.lit(0)).alias("times_fired"))


def _byte_ratio(out_: Column, in_: Column, unbounded: bool) -> Column:
    inf = F.when(out_ > 0, F.lit(INF)) if unbounded else F.lit(None).cast("double")
    return F.when(in_ > 0, out_ / in_).otherwise(inf)


def observed_evidence(windows: DataFrame, external: bool = False) -> DataFrame:
    """Evidence of a window. ``windows`` carries the aggregates and, unless external, dst_port_nunique and
    traffic_growth_pct. External days have neither and keep a missing byte ratio when nothing came in."""
    n, fwd, bwd = F.col("observation_count").cast("double"), c("TotLen Fwd Pkts"), c("TotLen Bwd Pkts")
    none = F.lit(None).cast("double")
    cols = {
        "dst_port_nunique": none if external else F.col("dst_port_nunique").cast("double"),
        "flow_duration_mean_us": c("Flow Duration"), "observation_count": n, "avg_bytes_per_flow": ratio(fwd, n),
        "flow_iat_coefficient_of_variation": variation(c("Flow IAT Std"), c("Flow IAT Mean")),
        "tot_fwd_pkts": c("Tot Fwd Pkts"), "tot_bwd_pkts": c("Tot Bwd Pkts"),
        "flow_byts_per_s": c("Flow Byts/s"), "flow_pkts_per_s": c("Flow Pkts/s"),
        "outbound_inbound_byte_ratio": _byte_ratio(fwd, bwd, not external),
        "traffic_growth_pct": none if external else F.col("traffic_growth_pct"), "connection_frequency": n,
        "syn_flag_cnt": c("SYN Flag Cnt"), "ack_flag_cnt": c("ACK Flag Cnt"),
    }
    return windows.select("window_id", "window_start", *[v.alias(k) for k, v in cols.items()])


def forecast_evidence(forecast: DataFrame, *keys: str) -> DataFrame:
    """Evidence of a forecast state in raw units; growth is against ``observed_pkts_per_s``, and the four fields
    that are no state features are missing."""
    none = F.lit(None).cast("double")
    fwd, bwd, pps, seen = c("TotLen Fwd Pkts"), c("TotLen Bwd Pkts"), c("Flow Pkts/s"), F.col("observed_pkts_per_s")
    cols = {
        "dst_port_nunique": none, "flow_duration_mean_us": c("Flow Duration"), "observation_count": none, "avg_bytes_per_flow": none,
        "flow_iat_coefficient_of_variation": variation(c("Flow IAT Std"), c("Flow IAT Mean")),
        "tot_fwd_pkts": c("Tot Fwd Pkts"), "tot_bwd_pkts": c("Tot Bwd Pkts"), "flow_byts_per_s": c("Flow Byts/s"),
        "flow_pkts_per_s": pps, "outbound_inbound_byte_ratio": _byte_ratio(fwd, bwd, True),
        "traffic_growth_pct": F.when(seen > 0, (pps - seen) / seen * 100.0), "connection_frequency": none,
        "syn_flag_cnt": c("SYN Flag Cnt"), "ack_flag_cnt": c("ACK Flag Cnt"),
    }
    return forecast.select(*keys, *[v.alias(k) for k, v in cols.items()])


def availability(evidence: DataFrame, *by: str) -> DataFrame:
    """Share of rows with a value, per evidence field."""
    cells = F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).isNotNull().alias("has")) for x in EVIDENCE])
    long = evidence.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.*")
    return long.groupBy(*by, "field").agg((F.avg(F.col("has").cast("double")) * 100).alias("available_pct"))
