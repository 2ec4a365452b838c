"""Duplicates, conflicts, distinct values and order-free table comparison.

Every grouping here combines map-side first, so a group of copies holding a third of the table leaves each
task as one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import c


def drop_full_duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c(x) for x in columns]).distinct()


def duplicate_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    n = df.groupBy(*[c(x) for x in columns]).agg(F.count(F.lit(1)).alias("_n"))
    many = F.col("_n") > 1
    return n.agg(
        F.coalesce(F.sum(F.when(many, F.col("_n") - 1)), F.lit(0)).alias("extra_rows"),
        F.coalesce(F.sum(F.when(many, F.col("_n"))), F.lit(0)).alias("rows_involved"),
        F.count_if(many).alias("groups"))


def repeat_suspects(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows whose hash stands for more than one row: all rows that repeat others are among them, and few else.

    Where repetitions are few, counting these takes one shuffled number a row instead of the whole row. ``df`` is read twice."""
    h = F.xxhash64(*[c(x) for x in columns])
    many = df.select(h.alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")
    return df.withColumn("_h", h).join(many, "_h", "left_semi").drop("_h")


def label_conflicts(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Groups of equal features (NULL-safe) carrying more than one label: labels and rows per group.

    Counting per (features, label) first keeps each group at one row per label.
    """
    per = df.groupBy(*[c(x) for x in features], c(label)).agg(F.count(F.lit(1)).alias("_n"))
    return (
        per.groupBy(*[c(x) for x in features])
        .agg(F.count(label).alias("labels"), F.sum("_n").alias("rows"), F.min(label).alias("first_label"),
             F.max(label).alias("last_label"))
        .where("labels > 1")
    )



def duplicate_hash_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Repeated rows by two row hashes (96 bits): rows minus distinct hashes, exact count of hashes in two steps."""
    cols = [c(x) for x in columns]
    h = df.select(F.xxhash64(*cols).alias("_h"), F.hash(*cols).alias("_h2")).groupBy("_h", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    return h.agg(F.sum("_n").alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free fingerprint: row count plus xor and sum of row hashes (the sum sees repeated rows)."""
    h = F.xxhash64(*[c(x) for x in columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("hash_xor"),
                  F.sum(F.pmod(h, F.lit(2**31 - 1))).alias("hash_sum"))


def difference_counts(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows only in a, only in b, with multiplicity: one signed count per distinct row instead of two
    EXCEPT ALL plans, which would expand copies again."""
    sel = [c(x) for x in columns]
    signed = a.select(*sel, F.lit(1).alias("_s")).unionByName(b.select(*sel, F.lit(-1).alias("_s")))
    net = signed.groupBy(*sel).agg(F.sum("_s").alias("_d"))
    return net.agg(F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0)).alias("only_left"),
                   F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))), F.lit(0)).alias("only_right"))


def key_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys only in a, only in b, in both."""
    sel = [c(x) for x in keys]
    sides = (a.select(*sel, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
             .unionByName(b.select(*sel, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
             .groupBy(*sel).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")))
    return sides.agg(F.count_if((F.col("_a") == 1) & (F.col("_b") == 0)).alias("left_only"),
                     F.count_if((F.col("_a") == 0) & (F.col("_b") == 1)).alias("right_only"),
                     F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("both"))


def alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """1:1 check of two tables on a key: rows, repeated keys and unmatched keys on each side."""
    sides = (a.select(c(key), F.lit(1).alias("_a"), F.lit(0).alias("_b"))
             .unionByName(b.select(c(key), F.lit(0).alias("_a"), F.lit(1).alias("_b")))
             .groupBy(key).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")))
    return sides.agg(
        F.sum("_a").alias("left_rows"), F.sum("_b").alias("right_rows"),
        F.count_if(F.col("_a") > 1).alias("left_repeated"), F.count_if(F.col("_b") > 1).alias("right_repeated"),
        F.count_if(F.col("_b") == 0).alias("left_only"), F.count_if(F.col("_a") == 0).alias("right_only"))
