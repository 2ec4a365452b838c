"""Column inventory, leakage evidence, correlations, distributions and row identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import c, finite, is_inf, ratio
from ..functions.ordering import exact_percentiles
from ..functions.selection import quantiles
from ..schema import LABEL, TIMESTAMP
from .reports import cell_report, column_report, long_form

IDENTIFIERS = ["Dst Port", "Protocol"]
MONOTONE_CELL = 100_000

# Names that mark a label or a time column.
LABEL_NAMES = ["label", "class", "attack", "attack_type", "category"]
TIME_NAMES = ["timestamp", "time", "date", "flow start", "starttime"]


def detect_cell(cells: str, names: Sequence[str]) -> Column:
    """First cell of a header whose trimmed lower-case text is in ``names``, else the first containing one of them."""
    low = lambda x: F.lower(F.trim(x))
    exact = F.filter(cells, lambda x: low(x).isin(*names))
    part = F.filter(cells, lambda x: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: low(x).contains(n)))
    return F.get(F.concat(exact, part), F.lit(0))


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value as text, n). The basis of distinct counts and dominant values: every (column, value)
    pair is counted map-side, so nothing depends on how often one value repeats."""
    cells = F.array(*[F.struct(F.lit(x).alias("column_name"), c(x).cast("string").alias("value")) for x in columns])
    return df.select(F.explode(cells).alias("_c")).groupBy("_c.column_name", "_c.value").agg(F.count(F.lit(1)).alias("n"))


def distinct_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, num_unique) of numeric columns, NULL and NaN apart. What is shuffled is a place and a number, as a long
    or as a double by the column's type, never a text."""
    whole = {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), (c(x) if x in whole else F.lit(None)).cast("long").alias("l"),
                               (F.lit(None) if x in whole else c(x)).cast("double").alias("d")) for i, x in enumerate(columns)])
    known = F.filter(cells, lambda v: v["l"].isNotNull() | (v["d"].isNotNull() & ~F.isnan(v["d"])))
    per = df.select(F.explode(known).alias("_c")).groupBy("_c.i", "_c.l", "_c.d").agg(F.lit(1).alias("_one"))
    names = F.array(*[F.lit(x) for x in columns])
    return per.groupBy("i").agg(F.count(F.lit(1)).alias("num_unique")).select(F.element_at(names, F.col("i") + 1).alias("column_name"), "num_unique")


def inventory(df: DataFrame, numeric: Sequence[str], other: Sequence[str] = ()) -> DataFrame:
    """Per column: distinct values, missing, infinite, and min/max/mean/sample deviation of the finite part."""
    raw, v = F.col("raw"), F.col("v")
    basic = cell_report(df, numeric, {
        "missing": F.count_if(raw.isNull() | F.isnan(raw)), "infinite": F.count_if(is_inf(raw)), "min": F.min(v), "max": F.max(v),
        "mean": F.avg(v), "std": F.stddev_samp(v), "rows": F.count(F.lit(1))}, finite(raw))
    if other:
        none = F.lit(None).cast("double")
        basic = basic.unionByName(cell_report(df, other, {
            "missing": F.count_if(raw.isNull()), "infinite": F.lit(0).cast("long"), "min": F.max(none), "max": F.max(none), "mean": F.max(none),
            "std": F.max(none), "rows": F.count(F.lit(1))}, raw, kind="string"))
    distinct = distinct_numbers(df, numeric)
    if other:
        texts = value_frequencies(df, other).where(F.col("value").isNotNull() & (F.col("value") != "NaN"))
        distinct = distinct.unionByName(texts.groupBy("column_name").agg(F.count(F.lit(1)).alias("num_unique")))
    return basic.join(F.broadcast(distinct), "column_name", "left").select(
        "column_name", F.coalesce("num_unique", F.lit(0)).alias("num_unique"),
        F.round(F.coalesce("num_unique", F.lit(0)) / F.col("rows") * 100, 6).alias("pct_unique"),
        "missing", F.round(F.col("missing") / F.col("rows") * 100, 6).alias("missing_pct"), "infinite",
        "min", "max", "mean", "std")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles, max per numeric column."""
    long = long_form(df, [], columns, "column_name", "v", keep_null=False).where(~F.isnan("v"))
    basic = long.groupBy("column_name").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    rows = [(x, *[float(q[n]) for n in probs]) for x, q in quantiles(df, columns, probs).items()]
    return basic.join(F.broadcast(df.sparkSession.createDataFrame(rows, "column_name string, p25 double, p50 double, p75 double")), "column_name")


def constant_columns(df: DataFrame, columns: Sequence[str], near: float = 0.99) -> DataFrame:
    """CONSTANT (at most one non-missing value) or NEAR_CONSTANT (top value, missing included, >= near)."""
    f = value_frequencies(df, columns)
    real = F.col("value").isNotNull() & (F.col("value") != "NaN")
    s = f.groupBy("column_name").agg(
        F.count_if(real).alias("num_unique"), F.max("n").alias("_top"), F.sum("n").alias("_rows"))
    share = F.col("_top") / F.col("_rows")
    status = F.when(F.col("num_unique") <= 1, "CONSTANT").when(share >= near, "NEAR_CONSTANT")
    return s.select("column_name", status.alias("status"), "num_unique", F.round(share, 6).alias("dominant_fraction")).where(
        "status IS NOT NULL")


def crosstab(df: DataFrame, row: Column, label: str, labels: Sequence[str], name: str) -> DataFrame:
    """Counts per row value and label; the label list is fixed, so no extra job looks for pivot values."""
    return df.groupBy(row.alias(name)).pivot(label, list(labels)).agg(F.count(F.lit(1))).na.fill(0, list(labels))


def pure_hours(tab: DataFrame, benign: str, attack: str) -> DataFrame:
    return tab.withColumn(
        "purity", F.when((c(attack) == 0) & (c(benign) > 0), "benign_only")
        .when((c(benign) == 0) & (c(attack) > 0), "attack_only").otherwise("mixed"))


def identifier_purity(df: DataFrame, column: str, label: str) -> DataFrame:
    """Size-weighted share of the most frequent label per value: two nested counts, no per-value list."""
    per = df.groupBy(c(column), c(label)).agg(F.count(F.lit(1)).alias("_n"))
    val = per.groupBy(column).agg(F.max(F.when(c(label).isNotNull(), F.col("_n"))).alias("_m"), F.sum("_n").alias("_s"))
    return val.agg(F.count(F.lit(1)).alias("num_values"), (F.sum("_m") / F.sum("_s")).alias("weighted_purity"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), c(column)).limit(k)


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows where both are present; NULL for a constant side (corr() fails there)."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def feature_label_correlation(df: DataFrame, columns: Sequence[str], positive: Column) -> DataFrame:
    """Pearson correlation of each finite feature with a 0/1 indicator; constant features are left out."""
    v, y = F.col("v"), F.col("_y")
    rep = cell_report(df.withColumn("_y", positive.cast("double")), columns, {
        "correlation": pearson(v, y), "_lo": F.min(v), "_hi": F.max(v)}, finite(F.col("raw")), keys=["_y"])
    usable = (F.col("_lo") < F.col("_hi")) & F.col("correlation").isNotNull() & ~F.isnan("correlation")
    return rep.where(usable).select("column_name", "correlation")


def top_correlations(corr: DataFrame, k: int = 15) -> DataFrame:
    return corr.orderBy(F.desc(F.round(F.abs("correlation"), 9)), "column_name").limit(k)


def correlated_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Pairs with |r| >= threshold over pairwise-complete finite rows.

    All pairs at once as matrix products per Arrow batch: with mask m and values x centred on the column
    means, the counts m'm, sums x'm, squares (x*x)'m and products x'x of every pair add up over tasks. A task emits
    one row per column, whatever its share of the table.
    """
    import numpy as np
    import pyarrow as pa

    clean = df.select(*[finite(c(x)).alias(f"c{i}") for i, x in enumerate(columns)])
    k = len(columns)
    first = clean.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(k)]).first()
    centre = np.asarray([v if v is not None else 0.0 for v in first])

    def partial(batches):
        total = np.zeros((4, k, k))
        for b in batches:
            x = np.column_stack([np.asarray(b.column(i).to_numpy(zero_copy_only=False), dtype="float64") for i in range(k)])
            m = np.isfinite(x).astype("float64")
            z = np.where(m > 0, x - centre, 0.0)
            total += np.stack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k), pa.int32()), *[pa.array(list(total[i]), pa.list_(pa.float64())) for i in range(4)]], ["i", "n", "s", "q", "p"])

    rows = clean.mapInArrow(partial, "i int, n array<double>, s array<double>, q array<double>, p array<double>")
    cell = rows.select("i", F.posexplode(F.arrays_zip("n", "s", "q", "p")).alias("j", "_z")).select("i", "j", "_z.*")
    tot = cell.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in ("n", "s", "q", "p")])
    other = tot.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    both = tot.where("i < j").join(other, ["i", "j"])
    n = F.col("n")
    cov = F.col("p") - F.col("s") * F.try_divide(F.col("s2"), n)
    va, vb = F.col("q") - F.col("s") * F.try_divide(F.col("s"), n), F.col("q2") - F.col("s2") * F.try_divide(F.col("s2"), n)
    r = F.try_divide(cov, F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0))))
    names = F.array(*[F.lit(x) for x in columns])
    return both.select(F.get(names, F.col("i")).alias("column_a"), F.get(names, F.col("j")).alias("column_b"), r.alias("correlation")).where(
        F.col("correlation").isNotNull() & (F.abs("correlation") >= threshold))


def classify_columns(names: DataFrame, constants: DataFrame) -> DataFrame:
    """Category of every column and whether it belongs to the core feature set."""
    n = F.col("column_name")
    joined = names.join(F.broadcast(constants.select("column_name", "status")), "column_name", "left")
    cat = (F.when(n == LABEL, "TARGET").when(n == TIMESTAMP, "TIMESTAMP")
           .when(n.isin(*IDENTIFIERS), "NETWORK_IDENTIFIER")
           .when(F.col("status").isNotNull(), "CONSTANT_OR_NEAR_CONSTANT").otherwise("NETWORK_FEATURE"))
    core = (cat == "NETWORK_FEATURE") | (n == "Protocol")
    return joined.select("column_name", cat.alias("category"), core.alias("core"))


def time_report(df: DataFrame, ts: str, row_id: str) -> DataFrame:
    """Span, distinct times, repeated times, observations per time (exact median) and whether the row order is
    non-decreasing in time.

    Rows are compared inside cells of ids, then each cell's last row with the next cell's first, so gaps between ids
    do not hide a step back and no task sees more than a cell, or one row per cell.
    """
    obs = F.col("obs")
    per = df.groupBy(ts).agg(F.count(F.lit(1)).alias("obs"))
    base = per.agg(
        F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.count(F.lit(1)).alias("unique_ts"),
        F.count_if(obs > 1).alias("repeated_ts"),
        F.coalesce(F.sum(F.when(obs > 1, obs)), F.lit(0)).alias("rows_at_repeated_ts"),
        F.min(obs).alias("obs_min"), F.max(obs).alias("obs_max"), F.round(F.avg(obs), 4).alias("obs_mean"))
    med = exact_percentiles(per, "obs", {"obs_median": 0.5})
    rows = df.select(F.col(row_id).alias("_i"), F.col(ts).alias("_t"), F.floor(F.col(row_id) / MONOTONE_CELL).alias("_cell"))
    back = lambda w: F.coalesce(F.col("_t") < F.lag("_t").over(w), F.lit(False))
    inside = rows.withColumn("_back", back(Window.partitionBy("_cell").orderBy("_i")))
    cells = inside.groupBy("_cell").agg(F.count_if("_back").alias("_n"), F.min_by("_t", "_i").alias("_t"), F.max_by("_t", "_i").alias("_last"))
    step = F.coalesce(F.col("_t") < F.lag("_last").over(Window.orderBy("_cell")), F.lit(False))
    mono = cells.select("_n", step.alias("_back")).agg((F.coalesce(F.sum(F.col("_n") + F.col("_back").cast("long")), F.lit(0)) == 0).alias("monotonic"))
    return base.crossJoin(F.broadcast(med)).crossJoin(F.broadcast(mono))


# ---- row identities --------------------------------------------------------------------------------------

def _exact(a: Column, b: Column):
    return F.coalesce(a == b, F.lit(False)), None


def _close(a: Column, b: Column, tol: float = 1e-6):
    d = F.abs(a - b)
    return F.coalesce(d < tol, F.lit(False)), d


def identity_rules() -> dict[str, tuple]:
    """Relations the flow columns should satisfy: name -> (match predicate, absolute difference or NULL)."""
    fwd, bwd = c("Tot Fwd Pkts"), c("Tot Bwd Pkts")
    ratio_int = F.when(fwd > 0, F.floor(bwd / fwd)).otherwise(0)
    return {
        "subflow_fwd_pkts_eq_tot_fwd_pkts": _exact(c("Subflow Fwd Pkts"), fwd),
        "subflow_fwd_byts_eq_totlen_fwd_pkts": _exact(c("Subflow Fwd Byts"), c("TotLen Fwd Pkts")),
        "subflow_bwd_pkts_eq_tot_bwd_pkts": _exact(c("Subflow Bwd Pkts"), bwd),
        "subflow_bwd_byts_eq_totlen_bwd_pkts": _exact(c("Subflow Bwd Byts"), c("TotLen Bwd Pkts")),
        "fwd_seg_size_avg_eq_fwd_pkt_len_mean": _close(c("Fwd Seg Size Avg"), c("Fwd Pkt Len Mean")),
        "bwd_seg_size_avg_eq_bwd_pkt_len_mean": _close(c("Bwd Seg Size Avg"), c("Bwd Pkt Len Mean")),
        "fwd_seg_size_min_eq_fwd_pkt_len_min": _close(c("Fwd Seg Size Min"), c("Fwd Pkt Len Min")),
        "pkt_size_avg_eq_pkt_len_mean": _close(c("Pkt Size Avg"), c("Pkt Len Mean")),
        "down_up_ratio_eq_int_bwd_over_fwd": _exact(c("Down/Up Ratio"), ratio_int),
        "pkt_len_max_eq_max_fwd_bwd": _exact(c("Pkt Len Max"), F.greatest(c("Fwd Pkt Len Max"), c("Bwd Pkt Len Max"))),
        "pkt_len_min_eq_min_fwd_bwd_naive": _exact(c("Pkt Len Min"), F.least(c("Fwd Pkt Len Min"), c("Bwd Pkt Len Min"))),
        "fwd_pkt_len_mean_eq_totlen_over_count": _close(c("Fwd Pkt Len Mean"), ratio(c("TotLen Fwd Pkts"), fwd)),
        "bwd_pkt_len_mean_eq_totlen_over_count": _close(c("Bwd Pkt Len Mean"), ratio(c("TotLen Bwd Pkts"), bwd)),
    }


def consistency_checks(df: DataFrame) -> DataFrame:
    """match count, total, rate and largest difference for each identity, in one aggregate."""
    rules = identity_rules()
    return column_report(df, list(rules), {
        "matches": lambda r: F.count_if(rules[r][0]),
        "total": lambda r: F.count(F.lit(1)),
        "max_abs_diff": lambda r: F.max(rules[r][1] if rules[r][1] is not None else F.lit(None).cast("double")),
    }).select(F.col("column_name").alias("check_name"), "matches", "total",
              (F.col("matches") / F.col("total")).alias("match_rate"), "max_abs_diff")


def rate_checks(df: DataFrame) -> DataFrame:
    """Where infinities of the rate columns occur: by zero duration and zero numerator."""
    fwd, bwd = c("Tot Fwd Pkts"), c("Tot Bwd Pkts")
    num = {"Flow Byts/s": c("TotLen Fwd Pkts") + c("TotLen Bwd Pkts"), "Flow Pkts/s": fwd + bwd,
           "Fwd Pkts/s": fwd, "Bwd Pkts/s": bwd}
    zero = c("Flow Duration") == 0
    return column_report(df, list(num), {
        "inf_total": lambda x: F.count_if(is_inf(c(x))),
        "inf_zero_duration": lambda x: F.count_if(is_inf(c(x)) & zero),
        "inf_nonzero_duration": lambda x: F.count_if(is_inf(c(x)) & ~zero),
        "zero_duration_rows": lambda x: F.count_if(zero),
        "zero_numerator_rows": lambda x: F.count_if(zero & (num[x] == 0)),
        "of_those_inf": lambda x: F.count_if(zero & (num[x] == 0) & is_inf(c(x))),
    })


def range_checks(df: DataFrame) -> DataFrame:
    """-1 marks of the initial windows and the largest durations."""
    return df.agg(
        F.count_if(c("Init Fwd Win Byts") == -1).alias("init_fwd_minus1"), F.min(c("Init Fwd Win Byts")).alias("init_fwd_min"),
        F.count_if(c("Init Bwd Win Byts") == -1).alias("init_bwd_minus1"), F.min(c("Init Bwd Win Byts")).alias("init_bwd_min"),
        F.max(c("Flow Duration")).alias("flow_duration_max"), F.max(c("Active Max")).alias("active_max_max"),
        F.max(c("Idle Max")).alias("idle_max_max"),
        F.count_if((c("Pkt Len Min") != F.least(c("Fwd Pkt Len Min"), c("Bwd Pkt Len Min"))) & (c("Tot Bwd Pkts") != 0))
        .alias("len_min_mismatch_unexplained"))


def conditional_checks(df: DataFrame, protocol: str = "protocol") -> DataFrame:
    """Share of rows of each protocol whose smallest header has the expected length."""
    v = c("Fwd Seg Size Min")
    rules = {"udp_value_8": (F.col(protocol) == 17, v == 8), "protocol0_value_0": (F.col(protocol) == 0, v == 0),
             "tcp_ge20_multiple_of_4": (F.col(protocol) == 6, (v >= 20) & (v % 4 == 0))}
    return column_report(df, list(rules), {
        "matches": lambda r: F.count_if(rules[r][0] & rules[r][1]),
        "total": lambda r: F.count_if(rules[r][0])}).select(
        F.col("column_name").alias("check_name"), "matches", "total",
        ratio(F.col("matches"), F.col("total")).alias("match_rate"))


def feature_traits(feature: Column) -> dict[str, Column]:
    """Whether a feature depends on the direction of a flow, and whether on time."""
    return {
        "direction_dependent": feature.startswith("Fwd ") | feature.startswith("Bwd ") | (feature == "Down/Up Ratio"),
        "temporal": (feature == "Flow Duration") | feature.contains("IAT") | feature.startswith("Active ")
        | feature.startswith("Idle ") | feature.endswith("Pkts/s") | feature.endswith("Byts/s"),
    }


def count_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares; the grand total runs over the few group rows only."""
    n = count_by(df, column)
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))

