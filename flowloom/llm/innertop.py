"""Exact top-k inner products over vectors in descending length, with SVD-rotated partial sums.

1. The Gram matrix of all rows, added up in a tree, gives the right singular vectors of the table; rotated by them, the
   first components of a vector carry most of every inner product. The rotation is orthogonal, so it decides speed only.
2. Rows are range-partitioned by descending length (ties by id, so that vectors of one length are no hot key) and packed
   in that order, each with its rotated components and the length of what is left of it behind HEADS of them.
3. Query blocks meet the block of the longest vectors first: its k-th scores are floors that the rest must reach.
4. Then every query block goes through the blocks of its vector size. A block is passed over before it is read into
   Python if the product of both largest lengths is below every floor, and left in the middle once its lengths are. Of
   the others, a pair survives while partial sum + product of the residual lengths (Cauchy-Schwarz) reaches the query's
   k-th score so far; only survivors get the integer product.
5. Each task gives k rows a query at most; these are ranked, where Spark keeps k a query and task again before shuffling.

Rotated values are floats; SLACK, relative to both lengths, covers their rounding, so no pair is lost. Scores themselves
are exact integers.

Rows with a null id or vector, or a null, non-finite or out-of-range component take no part. A query's own row is any row
of its vec_id. A repeated row counts each time; a repeated query row's result comes twice. Ties go to the smaller id.
Empty vectors have score 0 with each other. Empty tables give no rows. Extra columns are left behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SUMS, add_up, split_sums, stage
from .vectors import QUERY_ROWS, STEP, Best, Block, block_pairs, block_rows, gathered, integers, numbers, products, rows_with_vectors

#: Shares of the components behind which the residual is tested.
HEADS = (0.25, 0.5)
#: Rounding of float32 components and their sums, with room to spare.
SLACK = 1e-4
#: Rotations are fitted for vectors of at most so many components, and for so many sizes (the most frequent ones).
ROTATED, SIZES = 2048, 16
#: Above this share of survivors the whole product is cheaper than the survivors one by one.
DENSE = 0.1
SORTED = "dim int, norm long, id long, ints binary"
SORTED_ARROW = pa.schema([("dim", pa.int32()), ("norm", pa.int64()), ("id", pa.int64()), ("ints", pa.binary())])
TURNED = "number long, dim int, rows int, top double, ids binary, ints binary, norms binary, rotated binary, rest binary"
TURNED_ARROW = pa.schema([("number", pa.int64()), ("dim", pa.int32()), ("rows", pa.int32()), ("top", pa.float64()),
                          *[(c, pa.binary()) for c in ("ids", "ints", "norms", "rotated", "rest")]])
PARTIAL = "query_id long, query_row long, vec_id long, score long"
PARTIAL_ARROW = pa.schema([(c, pa.int64()) for c in ("query_id", "query_row", "vec_id", "score")])


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """Right singular vectors, strongest first, by vector size."""
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().where(F.col("d").between(2, ROTATED)).orderBy(F.desc("count"), "d").limit(SIZES)
    fitted = {r.d for r in sizes.collect()}

    def gram(batches):
        part, sums = TaskContext.get().partitionId(), {}
        for batch in batches:
            for _, _, x in integers(batch):
                if x.shape[1] in fitted:
                    x = x.astype(np.float64)
                    sums[x.shape[1]] = sums.get(x.shape[1], 0) + x.T @ x
        for d, total in sums.items():
            b = split_sums(part, total.ravel(), 1)
            yield b.set_column(1, "block", pa.array([d], pa.int32()))

    if not fitted:
        return {}
    found = add_up(rows.mapInArrow(gram, SUMS), "f8")
    # the eigenvectors of X'X are the right singular vectors of X
    return {d: np.linalg.eigh(g.reshape(d, d))[1][:, ::-1] for d, g in found.items()}


def heads(dim: int) -> list[int]:
    return [max(1, int(dim * share)) for share in HEADS] if dim > 1 else [dim] * len(HEADS)


def by_length(rows: DataFrame, turn: dict[int, np.ndarray], most: int | None = None, dealt_already: bool = False) -> DataFrame:
    """Blocks of each vector size in descending length, each row with rotated components and residual lengths.

    ``dealt_already``: the order holds within the partitions that the rows are in."""

    def measure(batches):
        for batch in batches:
            for ids, _, x in integers(batch):
                width = 4 * x.shape[1]
                flat = x.tobytes()
                yield pa.RecordBatch.from_pydict({"dim": [x.shape[1]] * len(ids), "norm": (x.astype(np.int64) ** 2).sum(1), "id": ids,
                                                  "ints": [flat[i * width:(i + 1) * width] for i in range(len(ids))]}, schema=SORTED_ARROW)

    def apply(batches):
        number, held, dim, count = numbers(), [], None, 0

        def flush():
            norm, ids, ints = (np.concatenate(c) for c in zip(*held))
            for lo in range(0, len(ids), limit := most or block_rows(dim)):
                part = slice(lo, lo + limit)
                x = ints[part]
                r = x @ turn[dim] if dim in turn else x.astype(np.float64)
                rest = [np.sqrt((r[:, h:] ** 2).sum(1)) for h in heads(dim)]
                length = np.sqrt(norm[part].astype(np.float64))
                yield pa.RecordBatch.from_pylist([{"number": next(number), "dim": dim, "rows": len(x), "top": float(length[0]), "ids": ids[part].tobytes(), "ints": x.tobytes(),
                                                   "norms": length.tobytes(), "rotated": r.astype(np.float32).tobytes(), "rest": np.stack(rest).astype(np.float32).tobytes()}], TURNED_ARROW)

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and (dims[a] != dim or count >= (most or block_rows(dim))):
                    yield from flush()
                    held, count = [], 0
                dim = int(dims[a])
                x = np.frombuffer(b"".join(batch.column("ints")[a:b].to_pylist()), np.int32).reshape(b - a, dim)
                held.append((batch.column("norm")[a:b].to_numpy(), batch.column("id")[a:b].to_numpy(), x))
                count += b - a
        if held:
            yield from flush()

    measured = rows.mapInArrow(measure, SORTED)
    order = ["dim", F.desc("norm"), "id"]
    dealt = measured if dealt_already else measured.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).mapInArrow(apply, TURNED)


class Turned(Block):
    def __init__(self, row: dict):
        super().__init__(row)
        n = len(self.ids)
        self.norms = np.frombuffer(row["norms"], np.float64)
        self.rotated = np.frombuffer(row["rotated"], np.float32).reshape(n, self.dim)
        self.rest = np.frombuffer(row["rest"], np.float32).reshape(len(HEADS), n)
        self.heads = heads(self.dim)


def search(q: Turned, c: Turned, best: Best) -> None:
    """Takes the block ``c``, in descending length, into the best of the queries ``q``."""
    bound = q.most * c.most * q.dim
    for lo in range(0, len(c.ids), STEP):
        part = slice(lo, lo + STEP)
        bar = best.bar()
        live = np.flatnonzero(q.norms * c.norms[lo] * (1 + SLACK) >= bar)
        if not len(live):
            return
        bar, slack = bar[live, None], SLACK * np.outer(q.norms[live], c.norms[part])
        h = q.heads[0]
        partial = q.rotated[live, :h] @ c.rotated[part, :h].T
        row, col = np.nonzero(partial + np.outer(q.rest[0][live], c.rest[0][part]) + slack >= bar)
        if len(row) > DENSE * partial.size:
            scores = products(q.ints[live], c.ints[part], bound)
            row, col = np.nonzero(scores >= bar)
            score = scores[row, col]
        else:
            more = q.heads[1]
            further = partial[row, col] + np.einsum("ij,ij->i", q.rotated[live[row], h:more], c.rotated[lo + col, h:more])
            keep = further + q.rest[1][live[row]] * c.rest[1][lo + col] + slack[row, col] >= bar[row, 0]
            row, col = row[keep], col[keep]
            score = np.einsum("ij,ij->i", q.ints[live[row]].astype(np.int64), c.ints[lo + col].astype(np.int64))
            keep = score >= bar[row, 0]
            row, col, score = row[keep], col[keep], score[keep]
        other = q.ids[live[row]] != c.ids[lo + col]
        best.offer(live[row[other]], score[other], c.ids[lo + col[other]])


def searched(queries: DataFrame, blocks: DataFrame, k: int, floors: bool) -> DataFrame:
    """Each task's k best rows of each query; ``queries`` bring their ``floors`` and the ``least`` of them."""

    def start(row):
        q = Turned(row)
        return q, Best(len(q.ids), k, np.frombuffer(row["floors"], np.int64) if row.get("floors") else None)

    def step(state, row):
        search(state[0], Turned(row), state[1])

    def end(state):
        q, best = state
        row, score, ids = best.found()
        return pa.RecordBatch.from_pydict({"query_id": q.ids[row], "query_row": (np.int64(q.number) << 10) + row, "vec_id": ids, "score": score}, schema=PARTIAL_ARROW)

    reach = F.col("q_top") * F.col("top") * (1 + SLACK) >= F.col("q_least") if floors else None
    return block_pairs(queries, blocks, step, start, end, PARTIAL, reach)


def with_floors(queries: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """Query blocks with each query's k-th score in the first block; queries with fewer have none."""
    kth = first.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    per = kth.groupBy(F.shiftright("query_row", 10).alias("number")).agg(F.collect_list(F.struct((F.col("query_row") % 1024).cast("int").alias("row"), "kth")).alias("known"))

    def apply(batches):
        for batch in batches:
            for r in batch.to_pylist():
                floors = np.full(r["rows"], -(1 << 62))
                for x in r.pop("known") or []:
                    floors[x["row"]] = x["kth"]
                yield pa.RecordBatch.from_pylist([r | {"floors": floors.tobytes(), "least": int(floors.min())}], schema)

    schema = TURNED_ARROW.append(pa.field("floors", pa.binary())).append(pa.field("least", pa.int64()))
    return queries.join(per, "number", "left").mapInArrow(apply, TURNED + ", floors binary, least long")


def top_inner_products(table: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The ``k`` highest inner products of each row whose id is divisible by ``every`` with all other rows."""
    rows = rows_with_vectors(table)
    turn = rotations(rows)
    blocks = stage(by_length(rows, turn), "vectors")
    queries = stage(by_length(gathered(rows.where(F.col("vec_id") % every == 0)), turn, QUERY_ROWS, True), "queries")
    # the block with the longest vectors of each size: one row a size
    longest = blocks.groupBy("dim").agg(F.max_by("number", F.struct("top", -F.col("number"))).alias("number"))
    first = searched(queries, blocks.join(longest, ["dim", "number"], "left_semi"), k, False)
    # where several tasks had the first block's pairs, each query's are still in one
    known = stage(with_floors(queries, first, k), "floors")
    found = searched(known, blocks, k, True)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
