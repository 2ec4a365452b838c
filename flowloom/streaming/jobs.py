"""Structured Streaming forms of the windowed operators. Each has a batch twin with the same results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import c, epoch_micros, from_micros
from ..operators.flows import KEY, TIMEOUT_US, assignable, has_flag, with_key
from ..operators.windows import aggregation_policy
from ..schema import ATTACK, BENIGN, HISTORY, STATE
from ..session import ROCKSDB_PROVIDER
from ..sources.tables import staging_dir
from . import stateful


def run_available(df: DataFrame, name: str, mode: str = "append", base: str | None = None) -> DataFrame:
    """Runs a stream over everything that is there now into a Parquet sink and reads the sink.

    The checkpoint lies next to the sink in the shared folder, so a lost executor or a restart resumes; a later run with
    the same ``base`` goes on where this one ended."""
    spark = df.sparkSession
    base = base or staging_dir(spark, name)
    q = (df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def run_arrivals(arrivals: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, str]:
    """Runs ``build`` over tables that arrive one after another, each in a run of its own that resumes the one before.

    Gives the results and the folder of the query: its input, output and state."""
    spark = arrivals[0].sparkSession
    base = staging_dir(spark, name)
    out = None
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{base}/in")
        out = run_available(build(spark.readStream.schema(rows.schema).parquet(f"{base}/in")), name, base=base)
    return out, base


def window_accounts(closed: DataFrame, base: str) -> DataFrame:
    """One row: rows that came in, are in closed windows, in windows still open, and came too late for theirs.

    Open windows are read from the state store, so the late rows are what is left; the engine's own count of dropped
    rows is of partial aggregates, not of rows."""
    spark = closed.sparkSession
    total = lambda df, x, name: df.agg(F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name))
    state = spark.read.format("statestore").option("path", f"{base}/state").load()
    kept = state.schema["value"].dataType.fields  # by position: several are called "count", the first one counts the rows
    state = state.select(F.col("value").cast("struct<" + ", ".join(f"f{i}: {f.dataType.simpleString()}" for i, f in enumerate(kept)) + ">").alias("value"))
    rows = spark.read.parquet(f"{base}/in").agg(F.count(F.lit(1)).alias("rows_in"))
    out = rows.crossJoin(total(closed, F.col("observation_count"), "rows_closed")).crossJoin(total(state, F.col("value.f0"), "rows_open"))
    return out.withColumn("rows_late", F.col("rows_in") - F.col("rows_closed") - F.col("rows_open"))


def _instant(df: DataFrame, ts: str):
    """Watermarks need an instant; a zone-less time is read as UTC whatever the session zone is."""
    return F.timestamp_micros(epoch_micros(F.col(ts))) if df.schema[ts].dataType.typeName() == "timestamp_ntz" else F.col(ts)


def _wall(x):
    return from_micros(F.unix_micros(x))


def window_aggregates(states: DataFrame, width: str, columns: Sequence[str] = STATE, ts: str = "timestamp",
                      delay: str = "30 seconds") -> DataFrame:
    """Twin of ``window_features`` and ``distinct_ports``: windows close when the watermark passes their end; rows that come
    later are dropped, ``window_accounts`` tells how many. There are 65,536 ports, which bounds a window's set of them."""
    aggs = [(F.sum if how == "sum" else F.avg)(c(x).cast("double")).alias(x) for x, how in aggregation_policy(columns).items()]
    lab = F.col("label")
    g = states.withColumn(ts, _instant(states, ts)).withWatermark(ts, delay).groupBy(F.window(ts, width).alias("_w")).agg(
        F.count(F.lit(1)).alias("observation_count"), F.count_if(lab == BENIGN).alias("benign_count"),
        F.count_if(lab == ATTACK).alias("infiltration_count"), F.size(F.collect_set("dst_port")).cast("long").alias("dst_port_nunique"), *aggs)
    return g.select(_wall(F.col("_w.start")).alias("window_start"), _wall(F.col("_w.end")).alias("window_end"), *[x for x in g.columns if x != "_w"])


def segments(states: DataFrame, width: str, by: str, ts: str = "timestamp", delay: str = "30 seconds") -> DataFrame:
    """Twin of the gap segments: sessions over window starts with a gap of one window merge exactly the runs
    without a missing window. A segment is closed once the watermark is a width past its last window.
    ``by`` is the link or capture; sessions of different links never merge."""
    timed = states.withColumn(ts, _instant(states, ts)).withWatermark(ts, delay)
    # one row per link and window first (counted where the rows are), so a busy link's session sees its windows only
    per = timed.groupBy(by, F.window(ts, width).alias("_w")).agg(F.count(F.lit(1)).alias("_n")).select(by, F.window_time("_w").alias("_wt"), "_n")
    # a window's time is a microsecond before its end, so sessions run as much before, and a width after, their windows
    g = per.groupBy(by, F.session_window(F.col("_wt"), width).alias("_s")).agg(F.sum("_n").alias("observations"))
    edge = lambda x: _wall(x + F.expr("INTERVAL 1 MICROSECOND") - F.expr(f"INTERVAL {width}"))
    return g.select(by, edge(F.col("_s.start")).alias("segment_start"), edge(F.col("_s.end")).alias("segment_end"), "observations")


def deduplicated(rows: DataFrame, columns: Sequence[str], ts: str, delay: str = "1 hour") -> DataFrame:
    return rows.withColumn(ts, _instant(rows, ts)).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(columns))


FLOW_SCHEMA = ("capture string, protocol int, a_ip string, a_port int, b_ip string, b_port int, start_us long, first_index long, "
               "end_us long, packets long, bytes long, closed_reason string")
#: Width of the buckets in which packets wait: wide enough that a pair has few of them open within the delay.
BUCKET_US = 60_000_000


def flows(packets: DataFrame, timeout_us: int = TIMEOUT_US, delay: str = "130 seconds", bucket_us: int = BUCKET_US) -> DataFrame:
    """Twin of ``flow_table`` (identity, counts, closing reason), whatever order packets arrive in within the delay.

    State of a pair: the open flow, and the packets of the buckets that the watermark has not passed. A flow is given out
    once the watermark has passed the bucket of its last packet, or of the end of its idle time."""
    spark = packets.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    keyed = with_key(assignable(packets)).select(
        *KEY, F.col("index").cast("long").alias("index"), "timestamp_us", "side", F.col("ip_total_len").cast("long").alias("ip_total_len"),
        has_flag(F.col("tcp_flags"), "RST").alias("rst"), has_flag(F.col("tcp_flags"), "FIN").alias("fin"), F.timestamp_micros("timestamp_us").alias("event_time"))
    names = [f.split()[0] for f in FLOW_SCHEMA.split(", ")]
    return keyed.withWatermark("event_time", delay).groupBy(*KEY).transformWithStateInPandas(
        stateful.Flows(bucket_us, timeout_us, names), FLOW_SCHEMA, "append", "eventTime")


def sequences(windows: DataFrame, key: str, step_seconds: int, steps: int = HISTORY, delay: str = "30 minutes") -> DataFrame:
    """Twin of ``sliding_sequences`` per key (a link or a day), whatever order windows arrive in within the delay.

    ``windows`` carries key, window_start and state. State: the last ``steps`` windows without a gap, and the windows that
    the watermark has not passed; what is in front of a gap is forgotten as soon as the gap is certain."""
    spark = windows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    schema = f"{key} string, input_start long, input_end long, target long, history array<array<double>>, next_state array<double>"
    timed = windows.select(F.col(key).cast("string").alias(key), epoch_micros(F.col("window_start")).alias("window_us"), "state",
                           _instant(windows, "window_start").alias("event_time"))
    return timed.withWatermark("event_time", delay).groupBy(key).transformWithStateInPandas(
        stateful.Sequences(step_seconds, steps, [f.split()[0] for f in schema.split(", ")]), schema, "append", "eventTime")


def scored(rows: DataFrame, work: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Stateless scoring of each micro-batch with any batch expression, appended through foreachBatch.

    Each batch writes its own folder, so a repeated batch overwrites itself."""
    spark = rows.sparkSession
    base = staging_dir(spark, name)

    def sink(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")
