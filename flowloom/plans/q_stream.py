"""Queries: streaming twins, run over everything available and compared with the batch result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import c
from ..operators import rules as ru
from ..operators import sequences as sq
from ..operators import triage as tr
from ..schema import FEATURES, STATE, SUM_FEATURES
from ..sources.tables import staging_dir, write_stage
from ..streaming import jobs
from . import mapping as m
from . import q_flows as qf
from . import q_rules as qr
from . import q_windows as qw
from .registry import query

def _stream(df, name):
    """A stream over a written copy of a derived table."""
    path = write_stage(df, staging_dir(df.sparkSession, name))
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


#: One row in 97 arrives in a second run, when the watermark has passed nearly all of its windows.
HELD = 97
_ARRIVED = f"""wm AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 30 SECOND AS last, date_trunc('millisecond', max(ts) FILTER (WHERE event_id % {HELD} <> 0)) - INTERVAL 30 SECOND AS first FROM events),
came AS (SELECT *, time_bucket(INTERVAL '10 minutes', timestamp) AS window_start FROM states),
kept AS (SELECT came.* FROM came, wm WHERE row_id % {HELD} <> 0 OR window_start + INTERVAL '10 minutes' > first)"""


def _arrivals(spark, d, features):
    st = m.states(spark, d, features)
    out, base = jobs.run_arrivals([st.where(F.col("row_id") % HELD != 0), st.where(F.col("row_id") % HELD == 0)],
                                  lambda s: jobs.window_aggregates(s, m.WIDTH, [*features, *m.ONEHOT] if features else []), "stream_windows")
    return out, base


@query("stream_window_agg", f"""WITH {m.states_sql()}, {_ARRIVED} SELECT window_start, window_start + INTERVAL '10 minutes' AS window_end, count(*) AS observation_count,
count(*) FILTER (WHERE label = 'Benign') AS benign_count, count(*) FILTER (WHERE label = 'Infilteration') AS infiltration_count, count(DISTINCT dst_port) AS dst_port_nunique,
{", ".join(f'round({"sum" if x in SUM_FEATURES else "avg"}("{x}"), 6) AS "{x}"' for x in STATE)} FROM kept, wm GROUP BY window_start, last HAVING window_start + INTERVAL '10 minutes' <= last""")
def stream_window_agg(spark, d):
    out, _ = _arrivals(spark, d, FEATURES)
    return out.select("window_start", "window_end", "observation_count", "benign_count", "infiltration_count", "dst_port_nunique", *[F.round(c(x), 6).alias(x) for x in STATE])


@query("stream_late_rows", f"""WITH {m.states_sql([])}, {_ARRIVED}, k AS (SELECT count(*) FILTER (WHERE window_start + INTERVAL '10 minutes' <= last) AS rows_closed, count(*) AS n FROM kept, wm)
SELECT (SELECT count(*) FROM states) AS rows_in, rows_closed, n - rows_closed AS rows_open, (SELECT count(*) FROM states) - n AS rows_late FROM k""")
def stream_late_rows(spark, d):
    return jobs.window_accounts(*_arrivals(spark, d, []))


@query("stream_segments", f"""WITH {qw.windows_sql([])}, s AS (SELECT min(window_start) AS segment_start, max(window_end) AS segment_end, CAST(sum(observation_count) AS BIGINT) AS observations FROM win GROUP BY segment_id)
SELECT * FROM s WHERE segment_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 630 SECOND FROM events)""")
def stream_segments(spark, d):
    st = m.states(spark, d, []).withColumn("capture", F.lit("events"))
    return jobs.run_available(jobs.segments(_stream(st, "states"), m.WIDTH, "capture"), "stream_segments").drop("capture")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def stream_dedup(spark, d):
    ev = m.table(spark, d, "events").select("ts", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    cols = ["user_id", "event_type", "k"]
    return jobs.run_available(jobs.deduplicated(_stream(ev, "events"), cols, "ts", "60 days").select(*cols), "stream_dedup")


@query("stream_flows", f"""WITH {qf.FLOWS} SELECT start_us, first_index, end_us, packets, bytes, CASE WHEN closed_reason = 'end_of_capture' THEN 'timeout' ELSE closed_reason END AS closed_reason
FROM fln, (SELECT (max(timestamp_us) // 1000 - 130000) * 1000 // 60000000 * 60000000 AS passed FROM ok)
WHERE CASE WHEN closed_reason IN ('tcp_rst', 'tcp_fin_both') THEN end_us ELSE end_us + 120000000 END < passed""")
def stream_flows(spark, d):
    out = jobs.run_available(jobs.flows(_stream(m.packets(spark, d), "packets")), "stream_flows")
    return out.select("start_us", "first_index", "end_us", "packets", "bytes", "closed_reason")


# Step i of the eleven windows of a sequence weighs i, so that a window in the wrong place changes every sum; in thousandths, which add up exactly.
@query("stream_sequences", f"""WITH {qw.dayseq_sql(STATE)}, lastw AS (SELECT max(window_start) - INTERVAL 40 MINUTE AS last FROM win)
SELECT CAST(q.capture_day AS VARCHAR) AS capture_day, CAST(epoch(min(w.window_start)) AS BIGINT) AS input_start, CAST(epoch(max(w.window_start)) AS BIGINT) AS target,
{", ".join(f'CAST(sum((w.window_id - q.input_start_window + 1) * coalesce(CAST(round(w."{x}" * 1000) AS BIGINT), 0)) AS BIGINT) AS "{x}"' for x in STATE)}
FROM seq q JOIN win w ON w.capture_day = q.capture_day AND w.window_id BETWEEN q.input_start_window AND q.target_window, lastw GROUP BY q.capture_day, q.sequence_id, last HAVING max(w.window_start) <= last""")
def stream_sequences(spark, d):
    w = sq.with_state(qw.windows(spark, d, STATE, by=["capture_day"])).select("capture_day", "window_start", "state")
    out = jobs.run_available(jobs.sequences(_stream(w, "windows"), "capture_day", m.STEP), "stream_sequences")
    weighed = F.aggregate(F.transform(F.concat("history", F.array("next_state")), lambda x, i: F.transform(x, lambda v: F.coalesce(F.round(v * 1000).cast("long"), F.lit(0)) * (i + 1))),
                          F.array_repeat(F.lit(0).cast("long"), len(STATE)), lambda a, x: F.zip_with(a, x, lambda y, z: y + z))
    out = out.withColumn("sums", weighed)
    return out.select("capture_day", "input_start", "target", *[F.col("sums")[i].alias(x) for i, x in enumerate(STATE)])


@query("stream_scoring", f"WITH {qr.SCORED} SELECT window_id, primary_stage, CASE WHEN best < 30 THEN NULL ELSE best END AS stage_score FROM pr")
def stream_scoring(spark, d):
    def work(batch):
        s = ru.primary_stage(ru.stage_scores(batch))
        known = F.col("primary_stage") != ru.UNKNOWN
        none = F.lit(None).cast("double")
        inputs = s.select("window_id", "primary_stage", *[none.alias(p) for p in ("p1", "p2", "p3", "p5")], F.when(known, F.col("primary_stage")).alias("stage"),
                          F.when(known, F.col("primary_score")).alias("stage_score"), F.when(known, tr.stage_status(F.col("primary_stage"))).alias("stage_status"))
        return tr.triage(inputs).select("window_id", "primary_stage", "stage_score", "level")

    return jobs.scored(_stream(qr.evidence(spark, d), "evidence"), work, "stream_scoring").select("window_id", "primary_stage", "stage_score")
