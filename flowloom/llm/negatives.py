"""Hard negatives by a secondary-sort shuffle.

Pair scores travel as keys packed into bytes, (anchor, descending score, positives first, id), that are dealt by anchor
and sorted by the shuffle itself (``repartition`` and ``sortWithinPartitions``, the DataFrame form of
repartitionAndSortWithinPartitions). An iterator goes through the sorted keys once: a positive opens a window of scores
below it, a negative is given to every open window that it falls into, and nothing of an anchor is held but its few
windows.

Two passes of ``block_pairs`` make the keys. The first finds each anchor's positives; the second knows the windows and
sends on, per task, only the negatives that can be among the first of a window, so what is shuffled is windows x rank
keys a task and anchor, not all pairs, and an anchor's keys are bounded by the number of tasks.

Rows with a null id, label or vector, or a null, non-finite or out-of-range component take no part. "Other" rows are rows
of another vec_id. A repeated row counts each time, as a candidate and as an anchor, whose result then comes twice. Ties
go to the smaller id. A positive score below zero has an empty window; zero admits scores of zero. An anchor without
positives, a window without negatives and an empty table give no rows. Extra columns are left behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .vectors import QUERY_ROWS, STEP, Best, Block, block_pairs, gathered, pack, products, rows_with_vectors

KEYS = "anchor long, key binary"
KEYS_ARROW = pa.schema([("anchor", pa.int64()), ("key", pa.binary())])
#: anchor id, anchor row, inverted score, 0 for a positive and 1 for a negative, id; big-endian, so bytes sort like numbers.
KEY = np.dtype([("anchor", ">u8"), ("row", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
FLIP = np.uint64(1 << 63)
ANSWER = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
ANSWER_ARROW = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()),
                          ("positive_score", pa.int64()), ("negative_score", pa.int64())])
FOUND = "anchor long, q_number long, q_row int, score long, id long"
FOUND_ARROW = pa.schema([("anchor", pa.int64()), ("q_number", pa.int64()), ("q_row", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])


def ordered(x: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones of the same order, and back."""
    return x.view(np.uint64) ^ FLIP


def keys(anchor: np.ndarray, row: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.RecordBatch:
    out = np.empty(len(anchor), KEY)
    out["anchor"], out["row"], out["score"], out["kind"], out["id"] = ordered(anchor), ordered(row), ~ordered(score), kind, ordered(ids)
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY.itemsize), len(out), [None, pa.py_buffer(out.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(anchor), flat.cast(pa.binary())], schema=KEYS_ARROW)


def unpacked(batch: pa.RecordBatch) -> np.ndarray:
    out = np.frombuffer(b"".join(batch.column("key").to_pylist()), KEY)
    back = lambda x: (x.astype(np.uint64) ^ FLIP).view(np.int64)
    return np.rec.fromarrays([back(out["anchor"]), back(out["row"]), back(~out["score"].astype(np.uint64)), out["kind"], back(out["id"])], names="anchor,row,score,kind,id")


def secondary_sort(pairs: DataFrame) -> DataFrame:
    return pairs.repartition("anchor").sortWithinPartitions("key")


class _State:
    def __init__(self, row: dict):
        self.block = Block(row)
        self.row = (self.block.number << np.int64(10)) + np.arange(len(self.block.ids))  # QUERY_ROWS a block at most


def positive_keys(anchors: DataFrame, blocks: DataFrame, positives: int) -> DataFrame:
    """Keys of the best other rows of the anchor's label, from each task the first ``positives`` of each anchor."""

    def start(row):
        state = _State(row)
        state.best = Best(len(state.block.ids), positives)
        return state

    def step(state, row):
        a, b = state.block, Block(row)
        bound = a.most * b.most * a.dim
        for lo in range(0, len(b.ids), STEP):
            part = slice(lo, lo + STEP)
            s = products(a.ints, b.ints[part], bound)
            hit = np.nonzero((a.labels[:, None] == b.labels[part]) & (a.ids[:, None] != b.ids[part]) & (s >= state.best.bar()[:, None]))
            state.best.offer(hit[0], s[hit], b.ids[part][hit[1]])

    def end(state):
        row, score, ids = state.best.found()
        return keys(state.block.ids[row], state.row[row], score, 0, ids)

    return block_pairs(anchors, blocks, step, start, end, KEYS)


def first_of_anchor(sorted_keys: DataFrame, most: int) -> DataFrame:
    """The first ``most`` keys of each anchor row."""

    def apply(batches):
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k = unpacked(batch)
            new = np.append(True, (k.anchor[1:] != k.anchor[:-1]) | (k.row[1:] != k.row[:-1]))
            first = np.flatnonzero(new)
            rank = np.arange(len(k)) - np.repeat(first, np.diff(np.append(first, len(k))))
            if last == (k.anchor[0], k.row[0]):  # an anchor goes on from the batch before
                rank[: first[1] if len(first) > 1 else len(k)] += count
            last, count = (k.anchor[-1], k.row[-1]), rank[-1] + 1
            k = k[rank < most]
            yield pa.RecordBatch.from_pydict({"anchor": k.anchor, "q_number": k.row >> 10, "q_row": k.row & 1023, "score": k.score, "id": k.id}, schema=FOUND_ARROW)

    return sorted_keys.mapInArrow(apply, FOUND)


def negative_keys(anchors: DataFrame, blocks: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """Keys of what each task has first in each window; ``anchors`` bring their positives' scores and ids."""

    def start(row):
        state = _State(row)
        n = len(state.block.ids)
        at, score, ids = (np.array([p[c] for p in row["positives"]], np.int64) for c in ("q_row", "score", "id"))
        order = np.lexsort((ids, -score, at))
        state.at, state.score, state.pid = at[order], score[order], ids[order]
        slot = np.arange(len(at)) - np.searchsorted(state.at, state.at)
        state.windows = []
        for w in range(int(slot.max(initial=-1)) + 1):
            top = np.full(n, -1)  # no window: nothing is between 0 and -1
            top[state.at[slot == w]] = state.score[slot == w]
            lo, hi = np.where(top >= 0, -(-top * low // 100), 0), np.where(top >= 0, top * high // 100, -1)
            state.windows.append((lo, hi, Best(n, negatives)))
        return state

    def step(state, row):
        a, b = state.block, Block(row)
        bound = a.most * b.most * a.dim
        for lo in range(0, len(b.ids), STEP):
            part = slice(lo, lo + STEP)
            s = products(a.ints, b.ints[part], bound)
            other = a.labels[:, None] != b.labels[part]
            for least, most, best in state.windows:
                hit = np.nonzero(other & (s >= np.maximum(least, best.bar())[:, None]) & (s <= most[:, None]))
                best.offer(hit[0], s[hit], b.ids[part][hit[1]])

    def end(state):
        found = [np.stack(best.found()) for *_, best in state.windows]
        # a row in two windows of an anchor is one key; repeated rows of a window stay as often as they are there
        row, score, ids = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        if len(row):
            which = np.repeat(np.arange(len(found)), [f.shape[1] for f in found])
            per, counts = np.unique(np.stack([row, score, ids, which], 1), axis=0, return_counts=True)
            one, at = np.unique(per[:, :3], axis=0, return_inverse=True)
            often = np.zeros(len(one), np.int64)
            np.maximum.at(often, at.ravel(), counts)
            row, score, ids = np.repeat(one, often, axis=0).T
        return keys(state.block.ids[row], state.row[row], np.ascontiguousarray(score), 1, np.ascontiguousarray(ids))

    return block_pairs(anchors, blocks, step, start, end, KEYS)


def windows_of_anchor(sorted_keys: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """Goes down each anchor's scores: positives open windows, negatives fill those they fall into."""

    def apply(batches):
        anchor, windows = None, []  # a window: positive, its score, bounds times 100, number of negatives so far
        for batch in batches:
            out = []
            for a, row, score, kind, i in unpacked(batch).tolist():
                if anchor != (a, row):
                    anchor, windows = (a, row), []
                if kind == 0:
                    windows.append([i, score, low * score, high * score, 0])
                    continue
                for w in windows:
                    if w[2] <= 100 * score <= w[3] and w[4] < negatives:
                        w[4] += 1
                        out.append((a, w[0], w[4], i, w[1], score))
            cols = zip(*out) if out else [[]] * len(ANSWER_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, ANSWER_ARROW)], schema=ANSWER_ARROW)

    return sorted_keys.mapInArrow(apply, ANSWER)


def hard_negatives(table: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   relabel: int | None = 7, labels: int = 10) -> DataFrame:
    """The first ``negatives`` rows of another label whose score is ``low`` to ``high`` percent of a positive's.

    Anchors: ids divisible by ``every``. ``relabel``: ids divisible by it have the next of ``labels`` labels.
    """
    label = F.col("label").cast("long")
    if relabel:
        label = F.when(F.col("vec_id") % relabel == 0, (label + 1) % labels).otherwise(label)
    rows = rows_with_vectors(table, label)
    blocks = stage(pack(rows), "negatives")
    anchors = stage(pack(gathered(rows.where(F.col("vec_id") % every == 0)), QUERY_ROWS), "anchors")
    first = stage(first_of_anchor(secondary_sort(positive_keys(anchors, blocks, positives)), positives), "positives")
    # one list an anchor block: QUERY_ROWS times the number of positives at most
    lists = first.groupBy(F.col("q_number").alias("number")).agg(F.collect_list(F.struct("q_row", "score", "id")).alias("positives"))
    known = stage(anchors.join(lists, "number"), "windows")
    found = negative_keys(known, blocks, negatives, low, high)
    return windows_of_anchor(secondary_sort(found.unionByName(_positives_again(first))), negatives, low, high)


def _positives_again(first: DataFrame) -> DataFrame:
    """The positives as keys."""

    def apply(batches):
        for batch in batches:
            anchor, number, row, score, ids = (batch.column(f.name).to_numpy().astype(np.int64) for f in FOUND_ARROW)
            yield keys(anchor, (number << 10) + row, score, 0, ids)

    return first.mapInArrow(apply, KEYS)
