"""Raw day files to clean flow states, and on to windows: the cleaning operators in their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.numeric import c
from ..schema import DST_PORT, FEATURES, LABEL, ONEHOT, PROTOCOL, TIMESTAMP
from ..sources.tables import staging_dir, write_stage
from . import cleaning as cl
from . import dedup as dd


def clean_states(raw: DataFrame, allowed: Sequence[str], features: Sequence[str] = FEATURES, fmt: str | None = None) -> DataFrame:
    """timestamp, label, dst_port, features and protocol columns of every usable raw row, once.

    Repeated header rows, rows without a readable time and exact repetitions of a whole row go; unreadable numbers, NaN
    and infinities become NULL; an unexpected label fails. ``fmt`` None: the time format with the fewest failures.

    The files are parsed and their repetitions dropped once: the distinct rows are written, and labels (the same with and without
    repetitions), time formats and all that follows read them, each only the columns that it needs.
    """
    rows = dd.drop_full_duplicates(cl.drop_embedded_headers(raw, raw.columns), raw.columns)
    rows = raw.sparkSession.read.schema(rows.schema).parquet(write_stage(rows, staging_dir(raw.sparkSession, "distinct_rows")))
    cl.require_labels(rows, LABEL, allowed)
    timed = cl.parse_ts_candidates(rows, TIMESTAMP) if fmt is None else rows.withColumn(TIMESTAMP, cl.parse_ts(c(TIMESTAMP), fmt))
    numbers = cl.inf_to_null(cl.coerce_numeric(timed.where(c(TIMESTAMP).isNotNull()), features), features)
    hot = cl.onehot(numbers.withColumnRenamed(PROTOCOL, "protocol"))
    return hot.select(c(TIMESTAMP).alias("timestamp"), c(LABEL).alias("label"), c(DST_PORT).try_cast("int").alias("dst_port"), *[c(x) for x in features], *ONEHOT)
