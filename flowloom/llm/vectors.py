"""Integer vectors in packed blocks: shared by hard-negative mining and exact inner-product search.

A component x becomes floor(256 * x), x as double. Rows with a null id or vector, a null or non-finite component, or
a component of LIMIT or more (whose scores may not fit a long) take no part. Vectors meet only vectors of their own
number of components. A block is one row: ids, labels and components as bytes, ordered as the caller says.

``block_pairs`` brings every query block to every block of all rows (a stated query set against all rows, in blocks):
both tables are written first, nothing is shuffled, and Spark broadcasts the query blocks only where their files are
below its own size limit. Query blocks stand left, so a task sees one query block against its share of all rows at a
time and keeps the ``Best`` of few query blocks only.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, LIMIT = 256, 1 << 27
#: Rows of a block: about a megabyte of components, between the two numbers.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, (64, 4096)
QUERY_ROWS = 512
#: Columns of a block that one step takes, and query blocks whose best are kept at once.
STEP, KEPT = 512, 64
LOW = -(1 << 62)
PACKED = "number long, dim int, rows int, ids binary, labels binary, ints binary"
PACKED_ARROW = pa.schema([("number", pa.int64()), ("dim", pa.int32()), ("rows", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("ints", pa.binary())])


def rows_with_vectors(table: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label, embedding (doubles) of the rows without nulls in them; other columns are left behind."""
    label = F.lit(0) if label is None else label
    out = table.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return out.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())


def integers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, components) of the rows that take part, by number of components."""
    column = batch.column("embedding")
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    end = np.cumsum(size)
    sums = np.concatenate([[0], np.cumsum(~(np.abs(x) < LIMIT))])  # a null is NaN here
    good = sums[end] == sums[end - size]
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
    for d in np.unique(size[good]).tolist():
        pick = np.flatnonzero(good & (size == d))
        yield ids[pick], labels[pick], x[(end - size)[pick][:, None] + np.arange(d)].astype(np.int32)


def block_rows(dim: int) -> int:
    return int(np.clip(BLOCK_BYTES // (4 * max(dim, 1)), *BLOCK_ROWS))


def gathered(rows: DataFrame, each: int = 4 * QUERY_ROWS) -> DataFrame:
    """The rows in partitions of about ``each``, so that a query set thinly spread over many files still fills its blocks."""
    return rows.repartition(max(1, -(-rows.count() // each)))


def numbers() -> Iterator[int]:
    """Numbers that no other task of the stage gives out."""
    at = TaskContext.get().partitionId() << 24
    while True:
        yield at
        at += 1


def pack(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Blocks of the rows of each partition, ordered by id; ``most`` rows a block."""

    def apply(batches):
        number, held = numbers(), {}

        def flush(d):
            ids, labels, ints = (np.concatenate(c) for c in zip(*held.pop(d)))
            for lo in range(0, len(ids), limit := most or block_rows(d)):
                order = lo + np.argsort(ids[lo:lo + limit], kind="stable")
                yield pa.RecordBatch.from_pylist([{"number": next(number), "dim": d, "rows": len(order), "ids": ids[order].tobytes(),
                                                   "labels": labels[order].tobytes(), "ints": ints[order].tobytes()}], PACKED_ARROW)

        for batch in batches:
            for ids, labels, ints in integers(batch):
                held.setdefault(d := ints.shape[1], []).append((ids, labels, ints))
                if sum(len(c[0]) for c in held[d]) >= (most or block_rows(d)):
                    yield from flush(d)
            while len(held) > KEPT:  # tables of very many vector sizes
                yield from flush(next(iter(held)))
        for d in list(held):
            yield from flush(d)

    return rows.mapInArrow(apply, PACKED)


class Block:
    """A packed row read back."""

    def __init__(self, row: dict):
        self.number, self.dim, n = row["number"], row["dim"], row["rows"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64) if row.get("labels") is not None else None
        self.ints = np.frombuffer(row["ints"], np.int32).reshape(n, self.dim)
        self.most = int(np.abs(self.ints).max(initial=0))


def products(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Exact integer inner products; ``bound``: no partial sum is larger. Floats are exact below their mantissa."""
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class Best:
    """The k best (score, id) of each row so far: higher scores first, ties to the smaller id.

    ``least`` is a score that k candidates are known to reach, by row; what is below it is never kept."""

    def __init__(self, rows: int, k: int, least: np.ndarray | None = None):
        self.k, self.least = k, np.full(rows, LOW) if least is None else least
        self.scores, self.ids = np.full((rows, k), LOW), np.zeros((rows, k), np.int64)

    def bar(self) -> np.ndarray:
        """Below this score nothing of the row can be among its best."""
        return np.maximum(self.scores[:, -1], self.least)

    def offer(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        touched = np.unique(row)
        had = self.scores[touched] > LOW
        row = np.concatenate([row, np.repeat(touched, had.sum(1))])
        score, ids = np.concatenate([score, self.scores[touched][had]]), np.concatenate([ids, self.ids[touched][had]])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.scores[touched] = LOW
        self.scores[row[keep], rank[keep]], self.ids[row[keep], rank[keep]] = score[keep], ids[keep]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, score and id of everything kept."""
        row, rank = np.nonzero(self.scores > LOW)
        return row, self.scores[row, rank], self.ids[row, rank]


def block_pairs(queries: DataFrame, blocks: DataFrame, step: Callable, start: Callable, end: Callable, schema: str, only: Column | None = None) -> DataFrame:
    """Every query block against every block of the same vector size.

    ``start(query row)`` makes a state, ``step(state, block row)`` takes a block in, ``end(state)`` gives a batch of
    ``schema``. States of at most KEPT query blocks are held; an older one is given out, and begun anew if met again.
    """
    left = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    # as an equality of two columns it would be a join key with one value
    met = left.crossJoin(blocks).where(F.col("q_dim") - F.col("dim") == 0)
    met = met if only is None else met.where(only)

    def apply(batches):
        held: OrderedDict = OrderedDict()
        for batch in batches:
            for row in batch.to_pylist():
                if (state := held.pop(row["q_number"], None)) is None:
                    while len(held) >= KEPT:
                        yield end(held.popitem(last=False)[1])
                    state = start({k[2:]: v for k, v in row.items() if k.startswith("q_")})
                held[row["q_number"]] = state
                step(state, row)
        for state in held.values():
            yield end(state)

    return met.mapInArrow(apply, schema)
