"""Raw text flows to typed flows: header rows, numbers, times, labels, infinities, one-hot, encodings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import c, finite, is_inf
from ..schema import ATTACK, BENIGN, FEATURES, ONEHOT, PROTOCOLS, TS_FORMATS
from .reports import cell_report, column_report


def embedded_header(columns: Sequence[str]) -> Column:
    """True where every cell repeats its own column name."""
    return reduce(lambda a, b: a & b, [F.coalesce(c(x) == F.lit(x), F.lit(False)) for x in columns])


def drop_embedded_headers(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    return raw.where(~embedded_header(columns))


def to_number(text: Column) -> Column:
    """Number in a text cell; NaN and unreadable text are NULL, infinities stay for the reports."""
    v = text.try_cast("double")
    return F.when(~F.isnan(v), v)


def missing_text(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "") | F.lower(F.trim(text)).isin("nan", "null")


def coerce_numeric(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    return raw.withColumns({x: to_number(c(x)) for x in columns})


def numeric_report(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    raw_cell, v = F.col("raw"), F.col("v")
    return cell_report(raw, columns, {
        "raw_missing": F.count_if(missing_text(raw_cell)),
        "missing_after": F.count_if(v.isNull()),
        "introduced": F.count_if(v.isNull() & ~missing_text(raw_cell)),
        "infinite": F.count_if(is_inf(v)),
    }, to_number(raw_cell), kind="string")


def parse_ts(text: Column, fmt: str = TS_FORMATS[0]) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def ts_failures(raw: DataFrame, column: str, formats: Sequence[str] = TS_FORMATS) -> DataFrame:
    """One row per format, in trial order, with the number of rows it cannot parse."""
    one = raw.agg(*[F.count_if(parse_ts(c(column), f).isNull()).alias(f"f{i}") for i, f in enumerate(formats)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("format"), F.col(f"f{i}").alias("failures"))
                     for i, f in enumerate(formats)])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")


def choose_format(failures: DataFrame) -> DataFrame:
    """First format without failures, else the first with the fewest: both are the smallest (failures, position)."""
    return failures.agg(F.min(F.struct("failures", "position", "format")).alias("m")).select("m.format", "m.failures")


def parse_ts_candidates(raw: DataFrame, column: str, formats: Sequence[str] = TS_FORMATS) -> DataFrame:
    """Parses with the chosen format. The choice is one small aggregate fetched by the driver."""
    best = choose_format(ts_failures(raw, column, formats)).first()["format"]
    return raw.withColumn(column, parse_ts(c(column), best))


def unexpected_labels(df: DataFrame, label: str, allowed: Sequence[str]) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).where(~F.coalesce(c(label).isin(*allowed), F.lit(False)))


def require_labels(df: DataFrame, label: str, allowed: Sequence[str]) -> None:
    bad = [r[0] for r in unexpected_labels(df, label, allowed).limit(20).collect()]
    if bad:
        raise ValueError(f"unexpected labels: {bad}")


def inf_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({x: finite(c(x)) for x in columns})


def infinity_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite cells per column that has any, plus the row count with any infinity under ``(rows)``."""
    rows = F.count_if(reduce(lambda a, b: a | b, [is_inf(c(x)) for x in columns]))
    metrics = {"infinite": lambda x: rows if x == "(rows)" else F.count_if(is_inf(c(x)))}
    return column_report(df, [*columns, "(rows)"], metrics).where("infinite > 0")


RELATED = ["Flow Duration", "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Tot Fwd Pkts", "Tot Bwd Pkts"]


def missing_investigation(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """For every feature with missing cells: how many, how many at zero duration, ranges of related columns.

    Only missing cells are exploded, so complete rows cost nothing beyond the scan.
    """
    gaps = F.array_compact(F.array(*[
        F.when(finite(c(x)).isNull(), F.struct(F.lit(x).alias("feature"), (c(x).isNull() | F.isnan(c(x))).alias("raw")))
        for x in columns]))
    cells = df.select(*[c(x) for x in RELATED], F.explode(gaps).alias("_g")).select("_g.*", *RELATED)
    related = [f(c(x)).cast("double").alias(f"{x}_{n}") for x in RELATED for n, f in (("min", F.min), ("max", F.max))]
    zero = F.count_if(c("Flow Duration") == 0)
    return cells.groupBy("feature").agg(
        F.count_if("raw").alias("missing_before"), F.count(F.lit(1)).alias("missing_after"),
        zero.alias("zero_duration"), (zero == F.count(F.lit(1))).alias("all_zero_duration"), *related)


def onehot(df: DataFrame, column: str = "protocol") -> DataFrame:
    """Fixed protocol columns; an unseen value is all zeros (see :func:`unseen_values`)."""
    return df.withColumns({n: F.coalesce((F.col(column).cast("string") == str(p)).cast("int"), F.lit(0))
                           for p, n in zip(PROTOCOLS, ONEHOT)})


def unseen_values(df: DataFrame, column: str, known: Sequence) -> DataFrame:
    text = F.col(column).cast("string")
    return df.groupBy(text.alias(column)).agg(F.count(F.lit(1)).alias("rows")).where(
        ~F.coalesce(F.col(column).isin(*[str(x) for x in known]), F.lit(False)))


def encode_label(label: Column, variant: str = "strict") -> Column:
    """strict: two known labels, any other is an error; binary: anything but benign is 1;
    compatible: NULL for a label the two-class training never saw."""
    known = F.when(label == BENIGN, 0).when(label == ATTACK, 1)
    if variant == "binary":
        return F.coalesce((label != BENIGN).cast("int"), F.lit(1))
    if variant == "compatible":
        return known
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(label, F.lit("NULL")))).cast("int"))


def implausible(df: DataFrame, ts: str, low: str, high: str) -> DataFrame:
    t = F.col(ts)
    return df.where(~t.between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")))
