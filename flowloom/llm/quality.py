"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Words share a fixed number of hash slots. Every slot has a sparse random index vector, made from its number. A
slot's context vector is the sum of the index vectors of the words beside it over **all** documents, divided by
their number. A document is the mean of its words' context and index vectors. A two-layer numpy network is fitted on
a bounded sample of labelled rows, and a temperature on rows kept apart from the fit.

Nulls and empty texts pool to the zero vector and get a score like any other text; rows with a null id are
scored and never learnt from; null labels are not learnt from; repeated rows get equal scores. Without labels of
both kinds every score is the share of label 1 (1.0 without any label: nothing is known against a text). Extra
columns are passed over, or kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SUMS, add_up, byte_view, id_remainder, split_sums, steps, text_of, words

SLOTS, DIM, NONZERO = 1 << 14, 32, 4
AGAIN = SLOTS - 1
BLOCKS = 16
#: Most labelled rows the network is fitted on (a sample by a hash of the id).
FIT_ROWS = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 24, 60, 0.01, 1e-4
THRESHOLD = 0.3


def index_vectors(slots: int = SLOTS, dim: int = DIM, nonzero: int = NONZERO) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each slot's non-zero entries."""
    r = np.random.default_rng(20240601)
    places = np.argsort(r.random((slots, dim)), axis=1)[:, :nonzero].astype(np.int64)
    return places, r.choice(np.array([-1.0, 1.0], np.float32), (slots, nonzero))


def _slots(batch_text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, slot of each word, row of each word (from the range's first). A word that repeats one of the two before it
    counts as the word AGAIN, so that stuttering text has a word of its own."""
    off, data = byte_view(batch_text)
    for lo, hi in steps(np.diff(off)):
        h, row = words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        slot = (h % np.uint64(SLOTS - 1)).astype(np.int64)
        for k in (1, 2):
            slot[k:][(h[k:] == h[:-k]) & (row[k:] == row[:-k])] = AGAIN
        yield lo, hi, slot, row


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """SLOTS x DIM: mean index vector of the words left and right of each slot's words, over all documents."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        places, signs = index_vectors()
        total = np.zeros((SLOTS, DIM + 1))
        for b in batches:
            for _, _, slot, row in _slots(b.column(0)):
                same = row[1:] == row[:-1]
                left, right = slot[:-1][same], slot[1:][same]
                for a, c in ((left, right), (right, left)):
                    total[:, DIM] += np.bincount(a, minlength=SLOTS)
                    for k in range(NONZERO):
                        cell = a * DIM + places[c, k]
                        total[:, :DIM] += np.bincount(cell, signs[c, k], SLOTS * DIM).reshape(SLOTS, DIM)
        yield split_sums(TaskContext.get().partitionId(), total.astype(np.float32), BLOCKS)

    parts = docs.select(text_of(text).cast("binary")).mapInArrow(collect, SUMS)
    got = add_up(parts, "float32")
    table = np.concatenate([got.get(i, np.zeros(SLOTS // BLOCKS * (DIM + 1), np.float32)) for i in range(BLOCKS)]).reshape(SLOTS, DIM + 1)
    return table[:, :DIM] / np.maximum(table[:, DIM:], 1)


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Context vectors beside the index vectors, so that a word counts by itself and by its neighbours."""
    places, signs = index_vectors()
    own = np.zeros((SLOTS, DIM), np.float32)
    np.put_along_axis(own, places, signs, axis=1)
    return np.hstack([context, own]).astype(np.float32)


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each text; zero where there is no word."""
    out = np.zeros((len(texts), vectors.shape[1]), np.float32)
    for lo, hi, slot, row in _slots(texts):
        if len(slot):
            for a in range(0, len(slot), 100_000):  # bounds the gathered block
                s, r = slot[a:a + 100_000], row[a:a + 100_000]
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                out[lo + r[first]] += np.add.reduceat(vectors[s], first, axis=0)
            out[lo:hi] /= np.maximum(np.bincount(row, minlength=hi - lo), 1)[:, None]
    return out


@dataclass
class Network:
    """score = sigmoid(z / temperature), z from one tanh layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the log loss over four fifths of the rows, then the temperature on the last fifth."""
    d = x.shape[1]
    r = np.random.default_rng(seed)
    if len(y) == 0 or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    order = r.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5:]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-6
    z = (x - mean) / scale
    p = [r.normal(0, d ** -0.5, (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for at in np.array_split(r.permutation(own), max(1, len(own) // 256)):
            h = np.tanh(z[at] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - y[at]) / len(at)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [z[at].T @ back + DECAY * p[0], back.sum(0), h.T @ e + DECAY * p[2], np.array([e.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(held):
        net.temperature = best_temperature(net.logits(x[held]), y[held])
    return net


def best_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on rows the fit has not seen."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def sample_labels(labels: DataFrame, label: str, most: int, doc_id: str = "doc_id") -> DataFrame:
    """About ``most`` labelled ids at most, chosen by a hash of the id; the bound makes the join a map-side one."""
    labels = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("_y"))
    n = labels.count()
    share = min(1.0, most / max(1, n))
    return labels.where(F.pmod(F.xxhash64(doc_id), F.lit(1_000_003)) < F.lit(int(share * 1_000_003)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors from all documents, and the network from at most about FIT_ROWS labelled ones."""
    vectors = word_vectors(context_vectors(docs))
    chosen = F.broadcast(sample_labels(labels.where(learn), label, FIT_ROWS))
    sample = docs.select("doc_id", text_of().cast("binary").alias("_t")).join(chosen, "doc_id").select("doc_id", "_y", "_t")
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def pooled(batches):
        for b in batches:
            x = pool(b.column("_t"), held.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("_y").cast(pa.float64()), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    rows = sorted(sample.mapInArrow(pooled, "doc_id long, y double, x array<float>").collect())
    x = np.array([r.x for r in rows], np.float64).reshape(len(rows), vectors.shape[1])
    return vectors, fit_network(x, np.array([r.y for r in rows], np.float64))


def scorer(spark: SparkSession, vectors: np.ndarray, net: Network) -> Callable[[Column], Column]:
    """Score of a text column, between 0 and 1. Only texts go to Python and only numbers come back."""
    held = spark.sparkContext.broadcast((vectors, net))

    @F.arrow_udf("double")
    def apply(texts: pa.Array) -> pa.Array:
        vec, model = held.value
        return pa.array(model.score(pool(texts, vec).astype(np.float64)))

    return lambda text: apply(F.coalesce(text, F.lit("")).cast("binary"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels of held-out ids are not learnt."""
    vectors, net = fit(docs, labels, id_remainder(5) != 0)
    score = scorer(docs.sparkSession, vectors, net)
    return docs.select("doc_id", score(F.col("text")).alias("score")).select(
        "doc_id", F.coalesce(id_remainder(5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    vectors, net = fit(docs, labels, id_remainder(5) != 0)
    return docs.where(scorer(docs.sparkSession, vectors, net)(F.col("text")) >= THRESHOLD)
