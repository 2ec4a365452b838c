"""How far each of the 65 features is confirmed by the table itself.

A feature is judged by a check over all rows where one decides on it, or by how well its definition is settled; then it
takes over the standing of what it is computed from: it is as good as the worst of these, through any number of steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import c, is_inf, ratio
from ..schema import FEATURES
from .profiling import consistency_checks, feature_traits
from .reports import column_report

# Standings from best to worst, and classes of evidence.
STANDINGS = ["VALIDATED", "PARTIALLY_VALIDATED", "UNVALIDATED", "NOT_REPRODUCIBLE"]
GOOD, PARTLY, OPEN, NOT = STANDINGS
IDENTITY, DEFINITION, DISCREPANCY, UNDOCUMENTED = "A", "B", "C", "D"


def _settled(names, kind=DEFINITION, standing=PARTLY, needs=()):
    return {n: (kind, None, standing, standing, list(needs)) for n in names}


def _tested(name, check, kind=IDENTITY, passed=GOOD, failed=OPEN, needs=()):
    return {name: (kind, check, passed, failed, list(needs))}


_SPREAD = ["Max", "Min", "Std"]
# Per feature its class, the check that decides on it, its standing if that holds and if not, and the features it rests on.
RULES: dict[str, tuple] = {
    **_settled([f"{n} Flag Cnt" for n in ("ACK", "SYN", "RST", "PSH", "URG", "ECE")] + ["Fwd PSH Flags"]),
    **_settled(["Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Flow Duration"]),
    **_settled(["Fwd Act Data Pkts"], standing=OPEN),
    **_settled(["Fwd Header Len", "Bwd Header Len"], UNDOCUMENTED, OPEN),
    **_settled([f"{x} IAT {k}" for x in ("Flow", "Fwd", "Bwd") for k in ("Mean", *_SPREAD)] + ["Fwd IAT Tot", "Bwd IAT Tot"], standing=OPEN),
    **_settled([f"{x} {k}" for x in ("Active", "Idle") for k in ("Mean", *_SPREAD)], standing=OPEN),
    **_tested("Init Fwd Win Byts", "init_fwd_win_byts_minus1_present", passed=PARTLY),
    **_tested("Init Bwd Win Byts", "init_bwd_win_byts_minus1_present", passed=PARTLY),
    **_tested("Fwd Pkt Len Mean", "fwd_pkt_len_mean_eq_totlen_over_count"),
    **_tested("Bwd Pkt Len Mean", "bwd_pkt_len_mean_eq_totlen_over_count", DISCREPANCY),
    **_settled([f"Fwd Pkt Len {k}" for k in _SPREAD], needs=["Fwd Pkt Len Mean"]),
    **_settled([f"Bwd Pkt Len {k}" for k in _SPREAD], needs=["Bwd Pkt Len Mean"]),
    **_tested("Pkt Len Max", "pkt_len_max_eq_max_fwd_bwd"),
    **_tested("Pkt Len Min", "pkt_len_min_eq_min_fwd_bwd_naive"),
    **_tested("Pkt Len Mean", "pkt_len_mean_eq_totlen_over_count", DISCREPANCY),
    **_settled(["Pkt Len Std", "Pkt Len Var"], needs=["Pkt Len Mean"]),
    **_tested("Pkt Size Avg", "pkt_size_avg_eq_pkt_len_mean", DISCREPANCY, needs=["Pkt Len Mean"]),
    **_tested("Down/Up Ratio", "down_up_ratio_eq_int_bwd_over_fwd"),
    **_tested("Flow Byts/s", "rate_convention__Flow Byts/s", DISCREPANCY),
    **_tested("Flow Pkts/s", "rate_convention__Flow Pkts/s"),
    **_tested("Fwd Pkts/s", "rate_convention__Fwd Pkts/s", DISCREPANCY),
    **_tested("Bwd Pkts/s", "rate_convention__Bwd Pkts/s", DISCREPANCY),
    **_tested("Fwd Seg Size Avg", "fwd_seg_size_avg_eq_fwd_pkt_len_mean", needs=["Fwd Pkt Len Mean"]),
    **_tested("Bwd Seg Size Avg", "bwd_seg_size_avg_eq_bwd_pkt_len_mean", DISCREPANCY, needs=["Bwd Pkt Len Mean"]),
    **_tested("Fwd Seg Size Min", "fwd_seg_size_min_eq_fwd_pkt_len_min", UNDOCUMENTED, failed=NOT),
    **_tested("Subflow Fwd Pkts", "subflow_fwd_pkts_eq_tot_fwd_pkts", DEFINITION, failed=PARTLY, needs=["Tot Fwd Pkts"]),
    **_tested("Subflow Bwd Pkts", "subflow_bwd_pkts_eq_tot_bwd_pkts", DEFINITION, failed=PARTLY, needs=["Tot Bwd Pkts"]),
    **_tested("Subflow Fwd Byts", "subflow_fwd_byts_eq_totlen_fwd_pkts", DEFINITION, failed=PARTLY, needs=["TotLen Fwd Pkts"]),
    **_tested("Subflow Bwd Byts", "subflow_bwd_byts_eq_totlen_bwd_pkts", DEFINITION, failed=PARTLY, needs=["TotLen Bwd Pkts"]),
}


def evidence(flows: DataFrame) -> DataFrame:
    """(check_name, matches, total) of the identities, of the mean length, of the rates of zero-length flows and of the marks
    for missing windows."""
    fwd, bwd = c("Tot Fwd Pkts"), c("Tot Bwd Pkts")
    size, zero = c("TotLen Fwd Pkts") + c("TotLen Bwd Pkts"), c("Flow Duration") == 0
    inf = lambda x, amount: (is_inf(c(x)), zero & (amount > 0))
    rules = {
        "pkt_len_mean_eq_totlen_over_count": (F.abs(c("Pkt Len Mean") - ratio(size, fwd + bwd)) < 1e-6, F.lit(True)),
        # infinite exactly where something happened in no time; one-way rates are never infinite
        **{f"rate_convention__{x}": (got == due, got | due) for x, (got, due) in {"Flow Byts/s": inf("Flow Byts/s", size), "Flow Pkts/s": inf("Flow Pkts/s", fwd + bwd)}.items()},
        **{f"rate_convention__{x}": (~is_inf(c(x)), F.lit(True)) for x in ("Fwd Pkts/s", "Bwd Pkts/s")},
    }
    marks = {f"init_{x.lower()}_win_byts_minus1_present": c(f"Init {x} Win Byts") == -1 for x in ("Fwd", "Bwd")}
    more = column_report(flows, [*rules, *marks], {
        "matches": lambda r: F.count_if(rules[r][0] & rules[r][1]) if r in rules else F.coalesce(F.max(marks[r].cast("long")), F.lit(0).cast("long")),
        "total": lambda r: F.count_if(rules[r][1]) if r in rules else F.lit(1).cast("long")})
    return consistency_checks(flows).select("check_name", "matches", "total").unionByName(more.withColumnRenamed("column_name", "check_name"))


def _rests_on(feature: str) -> set[str]:
    """The features below it in the table of dependencies, itself included."""
    found: set[str] = set()
    todo = [feature]
    while todo:
        x = todo.pop()
        if x not in found:
            found.add(x)
            todo += RULES[x][4]
    return found


def validation_matrix(flows: DataFrame) -> DataFrame:
    """65 rows: class, deciding check with its counts, own standing, standing after propagation and where that comes from."""
    spark = flows.sparkSession
    level = lambda s: STANDINGS.index(s)
    rules = spark.createDataFrame([(f, r[0], r[1], level(r[2]), level(r[3])) for f, r in ((f, RULES[f]) for f in FEATURES)],
                                  "feature string, classification string, check_name string, passed int, failed int")
    below = spark.createDataFrame([(f, x) for f in FEATURES for x in _rests_on(f)], "feature string, base string")
    own = rules.join(F.broadcast(evidence(flows)), "check_name", "left").withColumn(
        "own", F.when(F.col("check_name").isNull() | (F.col("matches") == F.col("total")), F.col("passed")).otherwise(F.col("failed")))
    bases = below.join(own.select(F.col("feature").alias("base"), F.col("own").alias("base_own")), "base")
    worst = bases.groupBy("feature").agg(F.min(F.struct(-F.col("base_own"), (F.col("base") != F.col("feature")), "base")).alias("w"))
    named = lambda x: F.element_at(F.array(*[F.lit(s) for s in STANDINGS]), x + 1)
    f = F.col("feature")
    return own.join(worst, "feature").select(
        "feature", "classification", "check_name", "matches", "total", named(F.col("own")).alias("own_status"), named(-F.col("w.col1")).alias("status"),
        F.when(F.col("w.base") != f, F.col("w.base")).alias("inherited_from"), *[v.alias(k) for k, v in feature_traits(f).items()])
