"""Alert triage: a severity level from probability, its trend and stage evidence. No action is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import CANDIDATE_STAGES, STAGE_CAPS, UNKNOWN

# Thresholds of the triage policy.
ELEVATED, HIGH, VERY_HIGH = 0.52, 0.5576, 0.62
TREND_DELTA = 0.02
SEVERE, MINIMUM = 60, 30
LADDER = ["MONITOR", "ALERT", "RATE_LIMIT", "TEMPORARY_BLOCK"]


def stage_status(stage: Column) -> Column:
    mapped = [s for s in STAGE_CAPS if s not in CANDIDATE_STAGES]
    return F.when(stage.isin(*mapped), "mapped").when(stage.isin(*CANDIDATE_STAGES), "candidate").otherwise("unknown")


def triage_inputs(probabilities: DataFrame, stages: DataFrame, key: str = "sequence_id", attribution: DataFrame | None = None) -> DataFrame:
    """One row per sequence: p1, p2, p3, p5 (NULL where missing), primary stage and its score and status. With
    ``attribution`` (any rows per key) also whether the sequence has one."""
    wide = probabilities.groupBy(key).pivot("horizon", [1, 2, 3, 5]).agg(F.max("p"))
    wide = wide.select(key, *[F.col(f"`{h}`").alias(f"p{h}") for h in (1, 2, 3, 5)])
    j = wide.join(stages, key, "full_outer")
    known = F.coalesce(F.col("primary_stage") != UNKNOWN, F.lit(False))
    explained = []
    if attribution is not None:
        j = j.join(attribution.select(key).distinct().withColumn("_explained", F.lit(True)), key, "left")
        explained = [F.coalesce("_explained", F.lit(False)).alias("attribution_available")]
    return j.select(key, "p1", "p2", "p3", "p5", F.when(known, F.col("primary_stage")).alias("stage"),
                    F.when(known, F.col("primary_score")).alias("stage_score"),
                    F.when(known, stage_status(F.col("primary_stage"))).alias("stage_status"), *explained)


def trend(p1: Column, p2: Column, p3: Column, p5: Column) -> Column:
    latest = F.coalesce(p5, p3, p2)
    d = latest - p1
    return F.when(d.isNull(), "unknown").when(d >= TREND_DELTA, "rising").when(d <= -TREND_DELTA, "falling").otherwise("flat")


def evidence_quality(has_p: Column, has_stage: Column, has_attribution: Column, mapped: Column, severe: Column) -> Column:
    one = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    s = one(has_p) + one(has_stage) + one(has_attribution) + one(has_stage & mapped) + one(has_stage & severe)
    return F.when(~has_p & ~has_stage, "INSUFFICIENT").when(s >= 4, "HIGH").when(s >= 2, "MEDIUM").otherwise("LOW")


def triage(inputs: DataFrame, attribution: Column | None = None) -> DataFrame:
    """Adds trend, evidence_quality, severity (0-4, NULL without any signal) and level."""
    p, stage, score, status = F.col("p1"), F.col("stage"), F.col("stage_score"), F.col("stage_status")
    has_p, has_stage = p.isNotNull(), stage.isNotNull()
    severe = F.coalesce(score >= SEVERE, F.lit(False))
    t = trend(p, F.col("p2"), F.col("p3"), F.col("p5"))
    base = F.when(p >= VERY_HIGH, 3).when(p >= HIGH, 2).when(p >= ELEVATED, 1).otherwise(0)
    x = inputs.withColumn("trend", t).withColumn("_s", base)
    tr = F.col("trend")
    x = x.withColumn("_s", F.when(tr == "rising", F.col("_s") + 1).when((tr == "falling") & (F.col("_s") > 0), F.col("_s") - 1).otherwise(F.col("_s")))
    delta = (F.when(severe, 1).when(score < MINIMUM, -1).otherwise(0) + F.when(status == "candidate", -1).otherwise(0)
             + F.when(stage == "Impact", 1).otherwise(0))
    x = x.withColumn("_s", F.greatest(F.lit(0), F.least(F.lit(4), F.col("_s") + F.when(has_stage, delta).otherwise(0))))
    conflict = has_p & has_stage & (tr == "falling") & severe
    unsure = ((~has_p | ~has_stage) & (F.col("_s") >= 2)) | conflict
    level = (F.when(~has_p & ~has_stage, "MONITOR").when(unsure, "ESCALATE")
             .otherwise(F.element_at(F.array(*[F.lit(v) for v in LADDER]), F.least(F.col("_s"), F.lit(3)) + 1)))
    quality = evidence_quality(has_p, has_stage, attribution if attribution is not None else F.lit(False), status == "mapped", severe)
    return x.withColumn("evidence_quality", quality).withColumn("level", level).withColumn(
        "severity", F.when(has_p | has_stage, F.col("_s"))).drop("_s")
