"""Header checks over a (file, position, column_name) table of many files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES, LABEL, PROTOCOL, RAW_COLUMNS, TIMESTAMP


def headers(lines: DataFrame) -> DataFrame:
    """(file, position, column_name) of a (file, header line) table."""
    names = F.transform(F.split("header", ",", -1), lambda x: F.trim(x))
    return lines.select("file", F.posexplode(names).alias("position", "column_name"))


def schema_family(cols: DataFrame, known: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Overlap of each header with the known columns: exact, strong (>= .9), partial (>= .4) or unrecognized.

    Repeated names count once for the overlap and each time as an extra or for the length.
    """
    is_known = F.col("column_name").isin(*known)
    per = cols.groupBy("file", "column_name").agg(F.count(F.lit(1)).alias("_n")).groupBy("file").agg(
        F.count_if(is_known).alias("overlap"), F.coalesce(F.sum(F.when(~is_known, F.col("_n"))), F.lit(0)).alias("extra"), F.sum("_n").alias("columns"))
    r = F.col("overlap") / len(known)
    exact = (F.col("overlap") == len(known)) & (F.col("extra") == 0) & (F.col("columns") == len(known))
    return per.withColumn("overlap_ratio", r).withColumn(
        "confidence", F.when(exact, "exact").when(r >= 0.9, "strong").when(r >= 0.4, "partial").otherwise("unrecognized"))


def schema_equal(cols: DataFrame, reference: str) -> DataFrame:
    """Names and order of each header against the header of the file ``reference`` of the same table."""
    ref = cols.where(F.col("file") == reference).select("position", F.col("column_name").alias("_ref"))
    size = ref.agg(F.count(F.lit(1)).alias("_size"))
    same = F.coalesce(F.col("_ref") == F.col("column_name"), F.lit(False))
    per = cols.join(ref, "position", "left").groupBy("file").agg(F.count_if(~same).alias("differing"), F.count(F.lit(1)).alias("columns"))
    return per.crossJoin(F.broadcast(size)).select("file", "differing", "columns", ((F.col("differing") == 0) & (F.col("columns") == F.col("_size"))).alias("equal"))


def schema_compat(cols: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Required features present or missing, the derived protocol columns, a status and readiness."""
    has = lambda n: F.bool_or(F.col("column_name") == n)
    per = cols.groupBy("file", "column_name").agg(F.lit(1).alias("_one")).groupBy("file").agg(
        F.count_if(F.col("column_name").isin(*features)).alias("direct"), has(PROTOCOL).alias("protocol"), has(TIMESTAMP).alias("timestamp"),
        has(LABEL).alias("label_available"), F.count_if(~F.col("column_name").isin(*RAW_COLUMNS)).alias("unsupported"))
    missing = F.lit(len(features)) - F.col("direct")
    status = (F.when((missing == 0) & F.col("protocol") & F.col("timestamp"), "SUPPORTED").when(missing == 0, "SUPPORTED_WITH_LIMITATIONS")
              .when(missing / len(features) < 0.5, "REQUIRES_FEATURE_MAPPING").otherwise("INCOMPATIBLE"))
    return per.select("file", "direct", missing.alias("missing"), "protocol", "timestamp", "label_available", "unsupported", status.alias("status"),
                      ((missing == 0) & F.col("protocol") & F.col("timestamp")).alias("ready"))
