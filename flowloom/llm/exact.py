"""Exact duplicates by two-pass Bloom filtering, with built-in functions only.

Texts are equal when they agree after white space is deleted. Pass one digests every text and counts, per cell of a
Bloom filter, the digests that set it. Cells set twice or more make the filter of pass two: a digest is possibly
repeated only if all its cells are in it. Only such rows are grouped by digest; all others pass straight through
and are their own group. False positives of the filter cost a little shuffle and change nothing.

The filter has BITS_PER_ROW bits a row up to MAX_BITS, which bounds it to 8 MB at any input; beyond that it lets
more rows through to the exact grouping, and loses none. Groups are reduced before the shuffle, so a text that a
third of all rows repeat is one row per task.

Null texts count as empty; empty texts are equal to each other and to texts of white space alone. The row with the
most code points in its original text stays, then the one with the smallest id (null ids last). Repeated rows (same id
and text) are one row of a group each, and the id that stays is then the same for all of them. Extra columns are
passed over by ``exact_groups`` and kept by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of, whole_rows

#: The white space that the comparison deletes.
SPACE = "[\\x20\\x09-\\x0D]+"
HASHES = 3
BITS_PER_ROW = 16
MIN_BITS, MAX_BITS = 1 << 16, 1 << 26


def digest(text: str = "text") -> Column:
    return F.sha2(F.regexp_replace(text_of(text), SPACE, ""), 256)


def digests(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, code points of the original text and digest of every row, written once; texts are not carried on."""
    return stage(docs.select("doc_id", F.length(text_of()).alias("n_points"), digest().alias("text_sha256"), *more), "digests")


def _cells(bits: int, hash_col: str = "text_sha256") -> list[Column]:
    """HASHES filter cells, from disjoint parts of the digest."""
    part = lambda i: F.conv(F.substring(hash_col, 1 + 15 * i, 15), 16, 10).cast("long")
    return [F.pmod(part(i), F.lit(bits)) for i in range(HASHES)]


def filter_bits(rows: int) -> int:
    need = max(MIN_BITS, min(MAX_BITS, rows * BITS_PER_ROW))
    return 1 << (need - 1).bit_length()


def repeated_cells(rows: DataFrame, bits: int) -> DataFrame:
    """Pass one: one row with the filter as an array of ``bits`` / 64 words; a bit stands for a cell set at least twice."""
    cells = rows.select(F.explode(F.array_distinct(F.array(*_cells(bits)))).alias("cell"))
    twice = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    words = twice.groupBy(F.shiftright("cell", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(cell % 64))")).alias("w"))
    slots = rows.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("at"))
    full = slots.join(words, "at", "left").select(F.struct("at", F.coalesce("w", F.lit(0)).alias("w")).alias("x"))
    return full.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]).alias("filter"))


def possibly_repeated(rows: DataFrame, bits: int) -> Column:
    """Pass two's condition: all cells of the digest are in the filter."""
    found = repeated_cells(rows, bits).scalar()
    hit = None
    for cell in _cells(bits):
        word = F.element_at(found, (F.shiftright(cell, 6) + 1).cast("int"))
        bit = F.call_function("getbit", word, F.pmod(cell, F.lit(64)).cast("int")) == 1
        hit = bit if hit is None else hit & bit
    return hit


def _first(*tail: str) -> Column:
    """Order of preference in a group: most code points, then smallest id, null ids last."""
    return F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id", *tail)


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    rows = digests(docs)
    bits = filter_bits(rows.count())
    marked = rows.withColumn("_maybe", possibly_repeated(rows, bits))
    single = marked.where(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = marked.where("_maybe")
    groups = maybe.groupBy("text_sha256").agg(F.min(_first()).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    several = maybe.join(groups, "text_sha256").select(
        "doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("doc_id").eqNullSafe(F.col("_best.doc_id")) & (F.col("n_points") == -F.col("_best.a"))).alias("kept"), "text_sha256"
    )
    return single.unionByName(several)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts.

    Rows outside the filter are passed on where they are read; of the rest only those that stay are joined
    back, by digest and place in the preference order; of repeated rows one stays.
    """
    rows = digests(docs)
    bits = filter_bits(rows.count())
    probed = whole_rows(docs, doc_id=F.col("doc_id"), text_sha256=digest(), n_points=F.length(text_of())).withColumn("maybe", possibly_repeated(rows, bits))
    best = rows.where(possibly_repeated(rows, bits)).groupBy("text_sha256").agg(F.min(_first()).alias("best"))
    best = best.select("text_sha256", F.col("best.doc_id").alias("id"), (-F.col("best.a")).alias("n"))
    stay = probed.where("maybe").join(best, "text_sha256").where(F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("n_points") == F.col("n")))
    return probed.where("not maybe").select("row.*").unionByName(stay.dropDuplicates(["text_sha256"]).select("row.*"))
