"""Shared pieces of the document operators: reading, written stages, sums over tasks, and batches of text as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import staging_dir

#: Bytes of text that one numpy step takes at once; a longer text is a step of its own.
STEP_BYTES = 2_000_000
#: Partial results of so many tasks are added in one group.
FAN_IN = 64


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, and a lost executor repeats none of it."""
    path = staging_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def id_remainder(divisor: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % divisor


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Names a row by id and text: equal only for repeated rows."""
    return F.xxhash64(F.col(doc_id), text_of(text))


def whole_rows(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns in one named ``row``, beside ``more``: helper columns cannot clash with the table's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def steps(lengths: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows with at most ``limit`` bytes, one row at least."""
    lo, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column without nulls, not copied."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset:]
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def code_points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)


def add_up(parts: DataFrame, dtype: str) -> dict[int, np.ndarray]:
    """Sums of ``parts`` (part, block, payload: arrays of ``dtype``) by block.

    Groups hold FAN_IN payloads at most, so it takes the more rounds the more tasks there were; only the
    final sums, whose number and size the caller fixes, reach the driver.
    """

    def plus(key, table):
        total = None
        for x in table.column("payload").to_pylist():
            v = np.frombuffer(x, dtype)
            total = v.copy() if total is None else total + v
        return pa.table({"part": [key[0].as_py()], "block": [key[1].as_py()], "payload": [total.tobytes()]}, schema=SUMS_ARROW)

    parts = stage(parts, "sums")
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        n = -(-n // FAN_IN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part", "block").applyInArrow(plus, SUMS)
        if n == 1:
            return {r.block: np.frombuffer(r.payload, dtype) for r in parts.collect()}


SUMS = "part int, block int, payload binary"
SUMS_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())])


def split_sums(part: int, total: np.ndarray, blocks: int) -> pa.RecordBatch:
    """One task's array as rows for ``add_up``, cut into ``blocks`` equal pieces."""
    pieces = total.reshape(blocks, -1)
    return pa.RecordBatch.from_pydict(
        {"part": [part] * blocks, "block": list(range(blocks)), "payload": [p.tobytes() for p in pieces]}, schema=SUMS_ARROW
    )


# ---- words as hashes -------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, np.uint64)
            down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _POWERS[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[size]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Running sums from which ``range_hash`` gets the hash of any slice."""
    up, _ = powers(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[: len(symbols)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the slices, the same for equal slices wherever they stand."""
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        h = (sums[end] - sums[start]) * down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


#: Of a byte: 0 white space, 1 lower-case letter or any byte of a longer character, 2 capital, 3 digit, 4 other.
_KIND = np.full(256, 4, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3


def words(data: np.ndarray, offsets: np.ndarray, beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts ``data[offsets[i]:offsets[i+1]]`` (joined), and for each its text's number.

    A word is a run of letters, of digits, or of other characters; a capital starts a letter run or follows a
    capital, so that "Words" is one word and capital spelling stays visible in the hash. ``beginnings``: the first so
    many bytes of longer words are words as well, told apart from whole ones; these follow after all whole words.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = _KIND[data]
    flat = np.where(kind == 2, np.uint8(1), kind)
    new = np.empty(len(data), bool)
    new[0] = True
    np.not_equal(flat[1:], flat[:-1], out=new[1:])
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(data))
    keep = flat[start] != 0
    start, end = start[keep], end[keep]
    sums, row = prefix_sums(data), np.searchsorted(offsets, start, "right") - 1
    hashes, rows = [range_hash(sums, start, end)], [row]
    for k in beginnings:
        some = np.flatnonzero(end - start > k)
        hashes.append(~range_hash(sums, start[some], start[some] + k))
        rows.append(row[some])
    return np.concatenate(hashes), np.concatenate(rows)
