"""Toxicity: cumulative-link ordinal regression from hashed words and word beginnings to severity grades.

P(grade <= k) = sigmoid(cut_k - w.x): all grades share the weights w, and the cuts are ordered. x says for each of
SLOTS hash slots whether a lower-cased word of the text, or the first 4, 5 or 6 bytes of one, falls into it. The weights
are fitted on at most about FIT_ROWS labelled rows with adaptive steps and an L1 penalty that keeps most of them zero, so
that neither the length of a text nor its rare words add up to a severity.

Grades are whole numbers from 0; a table of grades 0 and 1 gives one cut. Result: the expected severity (sum over k of
P(grade > k)), the likeliest grade, and ``toxic``: whether P(grade > 0) reaches the limit that parts grade 0 best from the
others (by F1) on a fifth of the sample that the fit has not seen.

Null and empty texts have no word and get the severity of the bare cuts; rows with null ids are scored and never
learnt from; null grades are not learnt; several grades of one id count as the highest; repeated rows get equal answers.
With fewer than two grades to learn from, every row gets that grade, or 0. Extra columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, id_remainder, steps, text_of, words
from .quality import sample_labels

SLOTS, BEGINNINGS = 1 << 20, (4, 5, 6)
FIT_ROWS = 20_000
EPOCHS, RATE, L1, BATCH = 12, 0.2, 1e-3, 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_slots(texts: pa.Array):
    """Per step of rows: first row, rows, and (row, slot) pairs without repeats, in order of rows."""
    off, data = byte_view(texts)
    for lo, hi in steps(np.diff(off)):
        h, row = words(_LOWER[data[off[lo]:off[hi]]], off[lo:hi + 1] - off[lo], BEGINNINGS)
        pair = np.unique(row * SLOTS + (h % np.uint64(SLOTS)).astype(np.int64))
        yield lo, hi - lo, pair // SLOTS, pair % SLOTS


class Ordinal:
    def __init__(self, weights: np.ndarray, cuts: np.ndarray, limit: float = 0.5):
        self.weights, self.cuts, self.limit = weights, cuts, limit

    def above(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ...: falls along the ordered cuts."""
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.cuts[None, :], -60, 60)))


def fit_ordinal(rows: list[np.ndarray], y: np.ndarray, slots: int = SLOTS, seed: int = 3) -> Ordinal:
    """``rows``: slots of each example; ``y``: grades 0 .. K-1. Maximum likelihood with an L1 penalty."""
    top = int(y.max()) if len(y) else 0
    if top == 0 or y.min() == y.max():
        return Ordinal(np.zeros(slots, np.float32), np.where(np.arange(max(1, top)) < (y.min() if len(y) else 0), -30.0, 30.0))
    share = np.clip(np.array([(y <= k).mean() for k in range(top)]), 1e-4, 1 - 1e-4)
    cuts = np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(top) * 1e-3)
    lead, gaps = cuts[0], np.log(np.diff(cuts) + 1e-6)
    w, seen = np.zeros(slots), np.full(slots, 1e-8)
    memory = np.full(top, 1e-8)
    r = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for part in np.array_split(r.permutation(len(y)), max(1, len(y) // BATCH)):
            at = np.concatenate([rows[i] for i in part]).astype(np.int64)
            owner = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            s = np.bincount(owner, w[at], len(part))
            cuts = np.concatenate([[lead], lead + np.cumsum(np.exp(gaps))])
            # P(y = k) = F(cut_k - s) - F(cut_k-1 - s); gradient of -log by s and by the cuts
            upper, lower = np.append(cuts, np.inf)[y[part]], np.insert(cuts, 0, -np.inf)[y[part]]
            fu, fl = 1 / (1 + np.exp(np.clip(s - upper, -60, 60))), 1 / (1 + np.exp(np.clip(s - lower, -60, 60)))
            du, dl = fu * (1 - fu), fl * (1 - fl)
            p = np.maximum(fu - fl, 1e-9)
            by_s = (du - dl) / p
            by_cut = np.zeros(top)
            np.add.at(by_cut, np.minimum(y[part], top - 1), np.where(y[part] < top, -du / p, 0))
            np.add.at(by_cut, np.maximum(y[part] - 1, 0), np.where(y[part] > 0, dl / p, 0))
            slot, back = np.unique(at, return_inverse=True)
            g = np.bincount(back, by_s[owner], len(slot)) / len(part)
            seen[slot] += g * g
            step = RATE / np.sqrt(seen[slot])
            moved = w[slot] - step * g
            w[slot] = np.sign(moved) * np.maximum(np.abs(moved) - step * L1, 0)
            own = np.concatenate([[by_cut.sum()], [by_cut[k + 1:].sum() * np.exp(gaps[k]) for k in range(top - 1)]]) / len(part)
            memory += own * own
            change = RATE * own / np.sqrt(memory)
            lead, gaps = lead - change[0], gaps - change[1:]
    return Ordinal(w.astype(np.float32), np.concatenate([[lead], lead + np.cumsum(np.exp(gaps))]))


def fit(docs: DataFrame, labels: DataFrame, grade: str = "toxic") -> Ordinal:
    chosen = F.broadcast(sample_labels(labels, grade, FIT_ROWS))
    sample = docs.select("doc_id", text_of().cast("binary").alias("_t")).join(chosen, "doc_id").select("doc_id", "_y", "_t")

    def slots(batches):
        for b in batches:
            out = []
            for _, n, row, slot in word_slots(b.column("_t")):
                out += [s.astype("<u4").tobytes() for s in np.split(slot, np.cumsum(np.bincount(row, minlength=n))[:-1])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("_y").cast(pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "y", "slots"])

    got = sorted(sample.mapInArrow(slots, "doc_id long, y long, slots binary").collect())
    rows, y = [np.frombuffer(r.slots, "<u4") for r in got], np.array([r.y for r in got], np.int64)
    order = np.random.default_rng(5).permutation(len(rows))
    held, own = order[: len(rows) // 5], order[len(rows) // 5:]
    model = fit_ordinal([rows[i] for i in own], y[own])
    model.limit = best_limit(model.above(np.array([model.weights[rows[i]].sum() for i in held]))[:, 0], y[held] > 0)
    return model


def best_limit(p: np.ndarray, positive: np.ndarray) -> float:
    """The middle of the gap between neighbouring values of ``p`` at which a limit gives the best F1."""
    if not positive.any() or positive.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    v, hits = p[order], np.cumsum(positive[order])
    f1 = 2 * hits / (np.arange(1, len(v) + 1) + positive.sum())
    f1[:-1][v[:-1] == v[1:]] = -1  # equal values stay together
    k = int(np.argmax(f1))
    return float((v[k] + (v[k + 1] if k + 1 < len(v) else 0)) / 2)




def severities(docs: DataFrame, labels: DataFrame, grade: str = "toxic") -> DataFrame:
    """doc_id, held_out, expected_severity, grade and toxic of every row; ids with crc32 mod 5 = 0 are not learnt from."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.where(id_remainder(5) != 0), grade))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches):
        ordinal = sent.value
        for b in batches:
            s = np.zeros(b.num_rows)
            for lo, n, row, slot in word_slots(b.column("_t")):
                s[lo:lo + n] = np.bincount(row, ordinal.weights[slot], n)
            above = ordinal.above(s)
            parts = -np.diff(np.column_stack([np.ones(len(s)), above, np.zeros(len(s))]), axis=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(above.sum(1)), pa.array(parts.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= ordinal.limit)],
                                             names=["doc_id", "held_out", "expected_severity", "grade", "toxic"])

    rows = docs.select("doc_id", F.coalesce(id_remainder(5) == 0, F.lit(False)).alias("held_out"), text_of().cast("binary").alias("_t"))
    return rows.mapInArrow(apply, f"doc_id {kind}, held_out boolean, expected_severity double, grade int, toxic boolean")
