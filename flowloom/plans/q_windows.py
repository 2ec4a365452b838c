"""Queries: windows, segments, sequences, splits, leakage checks and window look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import flatten_names
from ..functions.numeric import c, epoch_seconds
from ..operators import sequences as sq
from ..operators import splits as sp
from ..operators import windows as wn
from ..schema import ATTACK, HORIZONS, STATE, SUM_FEATURES
from ..sources.tables import staging_dir, write_stage
from . import mapping as m
from .registry import query

FEW = ["Flow Duration", "Tot Fwd Pkts", "Flow Pkts/s", "Flow IAT Mean"]
ONEHOT_SQL = ["Protocol_0", "Protocol_6", "Protocol_17"]


def windows(spark, d, features=FEW, width=m.WIDTH, step=m.STEP, by=()):
    """The window table. Its aggregates are written once: numbering, splits and sequences read them several times."""
    df = wn.window_features(m.states(spark, d, [f for f in features if f in m.FEATURES]), width, by, features)
    path = write_stage(wn.with_targets(df), staging_dir(spark, "window_table"))
    return wn.index_windows(spark.read.parquet(path), step, by)


def _agg_sql(f):
    return f'{"sum" if f in SUM_FEATURES else "avg"}("{f}") AS "{f}"'


def windows_sql(features=FEW, minutes=10, by=""):
    """CTEs ending in ``win``: aggregates, targets, window_id and segment_id."""
    feats = ", ".join(_agg_sql(f) for f in features)
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    real = [f for f in features if f in m.FEATURES]
    return f"""{m.states_sql(real)},
agg AS (SELECT {key}time_bucket(INTERVAL '{minutes} minutes', timestamp) AS window_start, count(*) AS observation_count,
 count(*) FILTER (WHERE label = 'Benign') AS benign_count, count(*) FILTER (WHERE label = 'Infilteration') AS infiltration_count,
 count(*) FILTER (WHERE label <> 'Benign') AS attack_count{"," if feats else ""} {feats} FROM states GROUP BY {key}window_start),
ided AS (SELECT *, window_start + INTERVAL '{minutes} minutes' AS window_end, row_number() OVER ({part}ORDER BY window_start) - 1 AS window_id,
 CASE WHEN window_start - lag(window_start) OVER ({part}ORDER BY window_start) > INTERVAL '{minutes} minutes' THEN 1 ELSE 0 END AS cut,
 CASE WHEN infiltration_count > 0 THEN 1 ELSE 0 END AS target,
 CASE WHEN infiltration_count > 0 THEN 'Infilteration' ELSE 'Benign' END AS label,
 CASE WHEN attack_count > 0 THEN 1 ELSE 0 END AS binary_target FROM agg),
win AS (SELECT * EXCLUDE (cut), CAST(sum(cut) OVER ({part}ORDER BY window_start) AS BIGINT) AS segment_id FROM ided)"""


def _round_cols(features):
    return [F.round(c(f), 6).alias(f) for f in features]


@query("window_agg_policy", f"""WITH {windows_sql(STATE)} SELECT window_start, window_end, observation_count,
{", ".join(f'round("{f}", 6) AS "{f}"' for f in STATE)} FROM win""")
def window_agg_policy(spark, d):
    df = wn.window_features(m.states(spark, d), m.WIDTH)
    return df.select("window_start", "window_end", "observation_count", *_round_cols(STATE))


@query("window_label_agg", f"""WITH {windows_sql([])} SELECT window_start, observation_count, benign_count, infiltration_count, attack_count,
round(infiltration_count / CAST(observation_count AS DOUBLE), 6) AS infiltration_ratio, round(attack_count / CAST(observation_count AS DOUBLE), 6) AS attack_ratio,
target, label, binary_target FROM win""")
def window_label_agg(spark, d):
    df = wn.with_targets(wn.window_features(m.states(spark, d, []), m.WIDTH, columns=[]))
    return df.select("window_start", "observation_count", "benign_count", "infiltration_count", "attack_count",
                     F.round("infiltration_ratio", 6).alias("infiltration_ratio"), F.round("attack_ratio", 6).alias("attack_ratio"),
                     "target", "label", "binary_target")


@query("dominant_label", f"""WITH {m.states_sql([])}, n AS (SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS window_start, label, count(*) AS n FROM states GROUP BY 1, 2),
best AS (SELECT window_start, label, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, label) AS r FROM n WHERE label <> 'Benign')
SELECT w.window_start, coalesce(b.label, 'Benign') AS dominant_label FROM (SELECT DISTINCT window_start FROM n) w LEFT JOIN best b ON w.window_start = b.window_start AND b.r = 1""")
def dominant_label(spark, d):
    return wn.dominant_labels(m.flows(spark, d, ["timestamp", "label"]), m.WIDTH)


@query("distinct_ports", f"""WITH {m.flows_sql(["timestamp", "dst_port"])} SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS window_start,
count(DISTINCT dst_port) AS dst_port_nunique FROM flows GROUP BY 1""")
def distinct_ports(spark, d):
    return wn.distinct_ports(m.flows(spark, d, ["timestamp", "dst_port"]), m.WIDTH)


@query("window_id", f"WITH {windows_sql([])} SELECT window_id, window_start FROM win")
def window_id(spark, d):
    return windows(spark, d, []).select("window_id", "window_start")


@query("segment_gap", f"""WITH {windows_sql()} SELECT window_id, window_start, window_end, segment_id, observation_count, target, label,
{", ".join(f'round("{f}", 6) AS "{f}"' for f in FEW)} FROM win""")
def segment_gap(spark, d):
    return windows(spark, d).select("window_id", "window_start", "window_end", "segment_id", "observation_count",
                                    "target", "label", *_round_cols(FEW))


@query("segment_gap_per_day", f"WITH {windows_sql([], by='capture_day')} SELECT CAST(capture_day AS VARCHAR) AS capture_day, window_id, window_start, segment_id FROM win")
def segment_gap_per_day(spark, d):
    w = windows(spark, d, [], by=["capture_day"])
    return w.select(F.col("capture_day").cast("string").alias("capture_day"), "window_id", "window_start", "segment_id")


@query("segment_summary", f"""WITH {windows_sql([])}, x AS (SELECT *, lag(window_start) OVER (ORDER BY window_start) AS p FROM win)
SELECT count(*) AS windows, count(DISTINCT segment_id) AS segments, count(*) FILTER (WHERE window_start - p > INTERVAL '10 minutes') AS gaps,
CAST(max(epoch(window_start) - epoch(p)) AS BIGINT) AS largest_gap_s FROM x""")
def segment_summary(spark, d):
    return wn.gap_summary(windows(spark, d, []), m.STEP)


def sequences(spark, d, features=FEW, labeled=True, states=True, w=None):
    w = windows(spark, d, features) if w is None else w
    if states:
        w = sq.with_state(w, features)
    return sq.sliding_sequences(w, labeled=labeled, states=states)


def seq_sql(features=(), inner=""):
    """CTEs ending in ``seq`` (meta data only), from ``win``."""
    return f"""{windows_sql(list(features))}, slid AS (SELECT window_id AS input_end_window, segment_id, window_start AS input_end_timestamp,
 lag(window_id, 9) OVER s AS input_start_window, lag(window_start, 9) OVER s AS input_start_timestamp, lead(window_id) OVER s AS target_window,
 lead(window_start) OVER s AS target_timestamp, lead(target) OVER s AS target_window_target, lead(label) OVER s AS target_window_label
 FROM win WINDOW s AS (PARTITION BY segment_id ORDER BY window_id)),
seq AS (SELECT *, row_number() OVER (ORDER BY input_start_window) - 1 AS sequence_id FROM slid WHERE input_start_window IS NOT NULL AND target_window IS NOT NULL)"""


SEQ_COLS = ["sequence_id", "input_start_window", "input_end_window", "target_window", "input_start_timestamp",
            "input_end_timestamp", "target_timestamp", "target_window_target", "target_window_label"]


@query("sequences_sliding", f"""WITH {seq_sql(STATE)} SELECT {", ".join("q." + x for x in SEQ_COLS)}, w.window_id - q.input_start_window AS step,
{", ".join(f'round(w."{f}", 6) AS "{f}"' for f in STATE)} FROM seq q JOIN win w ON w.window_id BETWEEN q.input_start_window AND q.target_window""")
def sequences_sliding(spark, d):
    s = sequences(spark, d, STATE)
    steps = F.concat("history", F.array("next_state"))
    x = s.select(*SEQ_COLS, F.posexplode(steps).alias("step", "v"))
    return x.select(*SEQ_COLS, F.col("step").cast("long").alias("step"), *[F.round(F.col("v")[i], 6).alias(f) for i, f in enumerate(STATE)])


@query("sequences_unlabeled", f"""WITH {seq_sql()} SELECT {", ".join(SEQ_COLS[:7])}, CAST(NULL AS INTEGER) AS target_window_target, CAST(NULL AS VARCHAR) AS target_window_label FROM seq""")
def sequences_unlabeled(spark, d):
    return sequences(spark, d, [], labeled=False, states=False).select(*SEQ_COLS)


@query("sequence_path_parity", f"WITH {seq_sql()} SELECT 0 AS only_left, 0 AS only_right")
def sequence_path_parity(spark, d):
    """Labeled and unlabeled path give the same tensors: signed row counts of both, all zero."""
    from ..operators.dedup import difference_counts

    cols = ["sequence_id", "target_window", "history", "next_state"]
    return difference_counts(sequences(spark, d), sequences(spark, d, labeled=False), cols)


# Per flattened name: how many values, and their sum in thousandths, weighed by the sequence so that none can change places.
@query("flatten_history", f"""WITH {seq_sql(STATE)}, cells AS (UNPIVOT (SELECT q.sequence_id, q.input_end_window - w.window_id AS back, {", ".join(f'w."{f}"' for f in STATE)}
 FROM seq q JOIN win w ON w.window_id BETWEEN q.input_start_window AND q.input_end_window) ON {", ".join(f'"{f}"' for f in STATE)} INTO NAME feature VALUE v)
SELECT CASE WHEN back = 0 THEN 't' ELSE 't-' || CAST(back AS VARCHAR) END || '__' || feature AS name, count(v) AS n, CAST(sum(CAST(round(v * 1000) AS BIGINT) * (sequence_id % 97 + 1)) AS BIGINT) AS weighed FROM cells GROUP BY 1""")
def flatten_history(spark, d):
    names = F.array(*[F.lit(n) for n in flatten_names(STATE)])
    flat = sq.flattened(sequences(spark, d, STATE))
    x = flat.select("sequence_id", F.explode(F.arrays_zip(names.alias("n"), F.col("flat").alias("v"))).alias("z"))
    weighed = F.sum(F.round(F.col("z.v") * 1000).cast("long") * (F.col("sequence_id") % 97 + 1))
    return x.groupBy(F.col("z.n").alias("name")).agg(F.count("z.v").alias("n"), weighed.alias("weighed"))


SPLIT_SQL = """cnt AS (SELECT count(*) AS n FROM win), b AS (SELECT greatest(1, least(CAST(floor(0.7 * n) AS BIGINT), n - 2)) AS t, n FROM cnt),
bb AS (SELECT t, greatest(t + 1, least(CAST(floor((0.7 + 0.15) * n) AS BIGINT), n - 1)) AS v FROM b),
part AS (SELECT win.*, CASE WHEN window_id < t THEN 'train' WHEN window_id < v THEN 'validation' ELSE 'test' END AS partition FROM win, bb)"""
PURGE_SQL = SPLIT_SQL + """, touched AS (SELECT q.sequence_id, count(DISTINCT p.partition) AS np, min(p.partition) AS one FROM seq q JOIN part p ON p.window_id BETWEEN q.input_start_window AND q.target_window GROUP BY 1),
pseq AS (SELECT q.*, CASE WHEN np = 1 THEN one END AS partition FROM seq q JOIN touched USING (sequence_id))"""


@query("split_chrono", f"WITH {windows_sql([])}, {SPLIT_SQL} SELECT window_id, window_start, partition FROM part")
def split_chrono(spark, d):
    return sp.chronological(windows(spark, d, [])).select("window_id", "window_start", "partition")


def partitioned_sequences(spark, d, w=None, **kw):
    w = windows(spark, d, kw.get("features", [])) if w is None else w
    return sp.partition_sequences(sequences(spark, d, **{"features": [], "states": False, "w": w, **kw}), w)


@query("purge_boundary", f"WITH {seq_sql()}, {PURGE_SQL} SELECT sequence_id, input_start_window, target_window, partition, partition IS NULL AS purged FROM pseq")
def purge_boundary(spark, d):
    s = partitioned_sequences(spark, d)
    return s.select("sequence_id", "input_start_window", "target_window", "partition", F.isnull("partition").alias("purged"))


def dayseq_sql(features=()):
    """CTEs ending in ``win`` and ``seq``, by day."""
    return f"""{windows_sql(list(features), by="capture_day")}, slid AS (SELECT capture_day, segment_id, lag(window_id, 9) OVER s AS input_start_window, lead(window_id) OVER s AS target_window
 FROM win WINDOW s AS (PARTITION BY capture_day, segment_id ORDER BY window_id)),
seq AS (SELECT *, row_number() OVER (PARTITION BY capture_day ORDER BY input_start_window) - 1 AS sequence_id, count(*) OVER (PARTITION BY capture_day) AS n FROM slid WHERE input_start_window IS NOT NULL AND target_window IS NOT NULL)"""


DAYSEQ_SQL = dayseq_sql()


@query("split_tail_per_day", f"""WITH {DAYSEQ_SQL} SELECT CAST(capture_day AS VARCHAR) AS capture_day, sequence_id, input_start_window,
CASE WHEN sequence_id >= n - CASE WHEN n > 1 THEN greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT)) ELSE 0 END THEN 'validation' ELSE 'train' END AS split FROM seq""")
def split_tail_per_day(spark, d):
    w = windows(spark, d, [], by=["capture_day"])
    s = sq.sliding_sequences(w, by=["capture_day"], states=False)
    return sp.tail_split(s, "capture_day").select(F.col("capture_day").cast("string").alias("capture_day"), "sequence_id",
                                                   "input_start_window", "split")


FOLDS = {"fold_hold_2": (["1", "3"], "2"), "fold_hold_3": (["1", "2"], "3"), "fold_hold_1": (["2", "3"], "1")}


@query("holdout_days", f"""WITH {m.flows_sql(["row_id", "timestamp"])}, dd AS (SELECT row_id, CAST(CASE WHEN timestamp < TIMESTAMP '2024-01-11' THEN 1 WHEN timestamp < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END AS VARCHAR) AS day FROM flows),
f(fold, hold) AS (VALUES ('fold_hold_1', '1'), ('fold_hold_2', '2'), ('fold_hold_3', '3'))
SELECT fold, day, CASE WHEN day = hold THEN 'holdout' ELSE 'train' END AS role, count(*) AS n FROM dd, f GROUP BY ALL""")
def holdout_days(spark, d):
    t = F.col("timestamp")
    day = F.when(t < F.lit("2024-01-11").cast("timestamp_ntz"), "1").when(t < F.lit("2024-01-21").cast("timestamp_ntz"), "2").otherwise("3")
    df = m.flows(spark, d, ["row_id", "timestamp"]).withColumn("day", day)
    return sp.holdout_folds(df, "day", FOLDS).groupBy("fold", "day", "role").agg(F.count(F.lit(1)).alias("n"))


@query("leakage_checks", f"""WITH {seq_sql()}, {PURGE_SQL}, e AS (SELECT max(window_start) FILTER (WHERE partition = 'train') AS a, min(window_start) FILTER (WHERE partition = 'validation') AS b,
 max(window_start) FILTER (WHERE partition = 'validation') AS c, min(window_start) FILTER (WHERE partition = 'test') AS d FROM part), r(check_name, offending) AS (
SELECT 'train_before_validation', CASE WHEN a < b THEN 0 ELSE 1 END FROM e UNION ALL SELECT 'validation_before_test', CASE WHEN c < d THEN 0 ELSE 1 END FROM e
UNION ALL SELECT 'window_id_unique', count(*) - count(DISTINCT window_id) FROM part
UNION ALL SELECT 'window_in_one_partition', count(*) FROM (SELECT window_id FROM part GROUP BY 1 HAVING count(DISTINCT partition) > 1)
UNION ALL SELECT 'sequence_id_unique', count(*) - count(DISTINCT sequence_id) FROM pseq
UNION ALL SELECT 'target_after_input', count(*) FILTER (WHERE target_timestamp <= input_end_timestamp) FROM pseq
UNION ALL SELECT 'input_in_order', count(*) FILTER (WHERE input_end_timestamp <= input_start_timestamp) FROM pseq
UNION ALL SELECT 'span_is_eleven_windows', count(*) FILTER (WHERE target_window - input_start_window <> 10) FROM pseq
UNION ALL SELECT 'no_label_or_time_feature', 0)
SELECT check_name, CAST(offending AS BIGINT) AS offending, offending = 0 AS passed FROM r""")
def leakage_checks(spark, d):
    w = windows(spark, d, [])
    return sp.leakage_checks(sp.chronological(w), partitioned_sequences(spark, d, w), STATE)


@query("intersect_ids", f"""WITH {windows_sql([])}, {SPLIT_SQL} SELECT 'train_validation' AS pair, count(*) AS shared FROM (SELECT window_id FROM part WHERE partition = 'train' INTERSECT SELECT window_id FROM part WHERE partition = 'validation')
UNION ALL SELECT 'validation_test', count(*) FROM (SELECT window_id FROM part WHERE partition = 'validation' INTERSECT SELECT window_id FROM part WHERE partition = 'test')""")
def intersect_ids(spark, d):
    w = sp.chronological(windows(spark, d, []))
    ids = {p: w.where(F.col("partition") == p).select("window_id") for p in ("train", "validation", "test")}
    pairs = [("train", "validation"), ("validation", "test")]
    parts = [ids[a].intersect(ids[b]).agg(F.lit(f"{a}_{b}").alias("pair"), F.count(F.lit(1)).alias("shared")) for a, b in pairs]
    return parts[0].unionByName(parts[1])


@query("member_filter", f"WITH {windows_sql(FEW)}, {SPLIT_SQL} SELECT window_id, round(\"Tot Fwd Pkts\", 6) AS fwd FROM win WHERE window_id IN (SELECT window_id FROM part WHERE partition = 'train')")
def member_filter(spark, d):
    w = windows(spark, d)
    train = sp.chronological(w).where("partition = 'train'").select("window_id")
    return w.join(train, "window_id", "left_semi").select("window_id", F.round(c("Tot Fwd Pkts"), 6).alias("fwd"))


@query("join_offset_h", f"""WITH {windows_sql([])}, {SPLIT_SQL}, h(horizon) AS (VALUES (1), (2), (3), (5))
SELECT a.window_id AS input_end_window, h.horizon, b.window_id AS target_window, b.window_start AS future_timestamp, b.label AS future_label
FROM part a CROSS JOIN h LEFT JOIN part b ON b.window_id = a.window_id + h.horizon AND b.segment_id = a.segment_id AND b.partition = a.partition""")
def join_offset_h(spark, d):
    w = sp.chronological(windows(spark, d, []))
    return sq.horizon_targets(w, HORIZONS).select("input_end_window", "horizon", "target_window", "future_timestamp", "future_label")


@query("horizon_exclusions", f"""WITH {seq_sql()}, {PURGE_SQL}, h(horizon) AS (VALUES (1), (2), (3), (5)), x AS (
SELECT p.partition AS split, h.horizon, t.window_id AS tw FROM pseq p CROSS JOIN h LEFT JOIN part t ON t.window_id = p.input_end_window + h.horizon AND t.segment_id = p.segment_id AND t.partition = p.partition WHERE p.partition IS NOT NULL)
SELECT split, horizon, count(*) AS sequences, count(tw) AS valid, count(*) - count(tw) AS excluded FROM x GROUP BY 1, 2""")
def horizon_exclusions(spark, d):
    w = windows(spark, d, [])
    s = partitioned_sequences(spark, d, w).where("partition IS NOT NULL").select("sequence_id", "input_end_window", F.col("partition").alias("split"))
    t = sq.horizon_targets(sp.chronological(w), HORIZONS).select("input_end_window", "horizon", "target_window")
    return s.join(t, "input_end_window").groupBy("split", "horizon").agg(
        F.count(F.lit(1)).alias("sequences"), F.count("target_window").alias("valid"),
        F.count_if(F.isnull("target_window")).alias("excluded"))


@query("growth_baseline", f"""WITH {windows_sql(["Flow Pkts/s"])}, b AS (SELECT window_id, "Flow Pkts/s" AS v, avg("Flow Pkts/s") OVER (PARTITION BY segment_id ORDER BY window_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS g FROM win)
SELECT window_id, round(g, 6) AS growth_baseline, round(CASE WHEN g > 0 THEN (v - g) / g * 100.0 END, 4) AS traffic_growth_pct FROM b""")
def growth_baseline(spark, d):
    return sq.growth_baseline(windows(spark, d, ["Flow Pkts/s"]), "Flow Pkts/s").select(
        "window_id", F.round("growth_baseline", 6).alias("growth_baseline"), F.round("traffic_growth_pct", 4).alias("traffic_growth_pct"))


@query("lookup_window", f"WITH {seq_sql(FEW)} SELECT sequence_id, input_end_window, observation_count, round(\"Flow Duration\", 6) AS flow_duration FROM seq JOIN win ON window_id = input_end_window")
def lookup_window(spark, d):
    w = windows(spark, d).select(F.col("window_id").alias("input_end_window"), "observation_count", F.round(c("Flow Duration"), 6).alias("flow_duration"))
    return sequences(spark, d, [], states=False).select("sequence_id", "input_end_window").join(w, "input_end_window")


@query("left_lookup", f"""WITH {windows_sql([])}, p AS (SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS window_start, count(DISTINCT dst_port) AS dst_port_nunique FROM states WHERE label <> 'Benign' GROUP BY 1)
SELECT window_id, dst_port_nunique FROM win LEFT JOIN p USING (window_start)""")
def left_lookup(spark, d):
    attack = m.states(spark, d, []).where("label <> 'Benign'")
    return windows(spark, d, []).join(wn.distinct_ports(attack, m.WIDTH), "window_start", "left").select("window_id", "dst_port_nunique")


@query("window_history_range", f"WITH {windows_sql(FEW)} SELECT window_id, window_start, round(\"Flow Duration\", 6) AS flow_duration FROM win WHERE window_id BETWEEN 100 AND 109")
def window_history_range(spark, d):
    return windows(spark, d).where("window_id BETWEEN 100 AND 109").select(
        "window_id", "window_start", F.round(c("Flow Duration"), 6).alias("flow_duration")).orderBy("window_id")


@query("first_match", f"WITH {windows_sql([])} SELECT window_id, window_start, label FROM win WHERE target = 1 AND observation_count >= 4 ORDER BY window_id LIMIT 1")
def first_match(spark, d):
    return windows(spark, d, []).where("target = 1 AND observation_count >= 4").orderBy("window_id").limit(1).select("window_id", "window_start", "label")


@query("label_filter", f"WITH {windows_sql([])} SELECT window_id, window_start, label FROM win WHERE label = 'Infilteration'")
def label_filter(spark, d):
    return windows(spark, d, []).where(F.col("label") == ATTACK).select("window_id", "window_start", "label")


@query("ts_floor", """SELECT event_id, date_trunc('second', ts) AS floored, date_trunc('second', ts) <> ts AS changed FROM events""")
def ts_floor(spark, d):
    f = wn.floor_to_window(F.col("ts"), "1 second")
    return m.table(spark, d, "events").select("event_id", f.alias("floored"), (f != F.col("ts")).alias("changed"))


@query("ts_parts", """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, ts + INTERVAL 1 SECOND AS next_second, epoch_us(ts) AS micros,
CAST(floor(epoch(ts)) - floor(epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS seconds_since FROM events""")
def ts_parts(spark, d):
    from ..functions.numeric import epoch_micros

    ts = F.col("ts")
    return m.table(spark, d, "events").select(
        "event_id", F.hour(ts).alias("hour_of_day"), F.timestamp_add("SECOND", F.lit(1), ts).alias("next_second"),
        epoch_micros(ts).alias("micros"), (epoch_seconds(ts) - epoch_seconds(F.lit("2024-01-01").cast("timestamp_ntz"))).alias("seconds_since"))


@query("sort_stable", f"WITH {m.flows_sql(['row_id', 'timestamp'])} SELECT row_id, time_bucket(INTERVAL '10 minutes', timestamp) AS window_start, timestamp FROM flows ORDER BY 2, 1")
def sort_stable(spark, d):
    """Total order (window start, row id): a range-partitioned distributed sort."""
    df = m.flows(spark, d, ["row_id", "timestamp"])
    return df.select("row_id", wn.floor_to_window(F.col("timestamp"), m.WIDTH).alias("window_start"), "timestamp").orderBy("window_start", "row_id")
