"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams, trained with follow-the-regularised-leader.

Counts of 1- to 3-grams of the lower-cased code points go to SLOTS hashed slots. Document frequencies come from
**all** learnable documents; the weights from a sample of at most about FIT_ROWS of them (by a hash of the id),
with per-coordinate steps and elastic-net penalties (FTRL-proximal); a temperature is then set on a fifth of the sample that
the fit has not seen. Every document is predicted on its whole text.

Null texts and texts without a letter get ``und`` with score 0, as does every text when nothing can be learnt; rows with
null ids are predicted and not learnt from; null languages are not learnt; repeated rows get equal answers; ties
go to the language that sorts first. An empty table gives an empty result. Extra columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SUMS, add_up, id_remainder, mix, split_sums

SLOTS, BLOCKS, GRAMS = 1 << 14, 4, 3
FIT_ROWS = 6_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 1e-4, 3
UNKNOWN = "und"


def gram_counts(texts: list[str], limit: int = 1_000_000) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of rows: first row, and an array rows x SLOTS of n-gram counts."""
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and hi - lo < 64 and (hi == lo or n + len(texts[hi]) <= limit):
            n += len(texts[hi])
            hi += 1
        lowered = [t.lower() for t in texts[lo:hi]]
        cp = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        ends = np.cumsum([len(t) for t in lowered])
        slots, h = [], np.zeros(len(cp), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(GRAMS):
                h = h[: max(0, len(cp) - k)] * np.uint64(0x9E3779B97F4A7C15) + cp[k:] + np.uint64(1)
                slots.append((mix(h + np.uint64(k)) & np.uint64(SLOTS - 1)).astype(np.int64))
        out = np.zeros((hi - lo, SLOTS), np.float32)
        for i, e in enumerate(ends.tolist()):
            s = e - len(lowered[i])
            own = np.concatenate([slots[k][s:max(s, e - k)] for k in range(GRAMS)])
            out[i] = np.bincount(own, minlength=SLOTS)
        yield lo, out
        lo = hi


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each slot, and all documents."""

    def collect(batches):
        from pyspark import TaskContext

        total = np.zeros(SLOTS + BLOCKS, np.int64)  # one more number in every block: the documents
        view = total.reshape(BLOCKS, -1)
        for b in batches:
            for _, x in gram_counts(b.column(0).to_pylist()):
                view[:, :-1] += (x > 0).sum(0).reshape(BLOCKS, -1)
                view[:, -1] += len(x)
        yield split_sums(TaskContext.get().partitionId(), total, BLOCKS)

    got = add_up(docs.select("text").mapInArrow(collect, SUMS), "int64")
    if not got:
        return np.zeros(SLOTS, np.int64), 0
    return np.concatenate([got[i][:-1] for i in range(BLOCKS)]), int(got[0][-1])


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


class Ftrl:
    """Multinomial weights under FTRL-proximal; most stay exactly zero."""

    def __init__(self, classes: int, slots: int):
        self.z, self.n = np.zeros((classes, slots + 1)), np.zeros((classes, slots + 1))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(w @ x)
        p[y] -= 1
        g = p[:, None] * x
        more = self.n[:, at] + g * g
        self.z[:, at] += g - (np.sqrt(more) - np.sqrt(self.n[:, at])) / ALPHA * w
        self.n[:, at] = more


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(docs: DataFrame, learn: Column) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, idf, weights (SLOTS + 1 columns, the last for the bias) and temperature."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    df, n = document_frequencies(known)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    share = min(1.0, FIT_ROWS / max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003)))

    def features(batches):
        for b in batches:
            rows = [[], []]
            for _, counts in gram_counts(b.column("text").to_pylist()):
                for c in counts:
                    at = np.flatnonzero(c)
                    rows[0].append(at.astype("<u2").tobytes())
                    rows[1].append(c[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("lang"), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary())], names=["doc_id", "lang", "at", "n"])

    rows = sorted(chosen.mapInArrow(features, "doc_id long, lang string, at binary, n binary").collect())
    langs = sorted({r.lang for r in rows})
    model = Ftrl(len(langs), SLOTS)
    order = np.random.default_rng(11).permutation(len(rows))
    held, own = order[: len(rows) // 5], order[len(rows) // 5:]

    def example(i):
        at = np.frombuffer(rows[i].at, "<u2").astype(np.int64)
        x = tf_idf(np.frombuffer(rows[i].n, "<f4"), idf[at])
        return np.append(at, SLOTS), np.append(x, 1.0), langs.index(rows[i].lang)

    for _ in range(EPOCHS):
        for i in own:
            model.learn(*example(i))
    w = model.weights()
    scores = [(w[:, at] @ x, y) for at, x, y in map(example, held)]
    return langs, idf, w.astype(np.float32), temperature(scores)


def temperature(scores: list[tuple[np.ndarray, int]]) -> float:
    if not scores:
        return 1.0
    s, y = np.array([a for a, _ in scores]), np.array([b for _, b in scores])
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 61))
    loss = [-np.mean(np.log(softmax(s / t)[np.arange(len(y)), y] + 1e-12)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; held-out ids are not learnt from."""
    langs, idf, w, t = fit(docs, id_remainder(4) != 2)
    sent = docs.sparkSession.sparkContext.broadcast((langs, idf, w, t))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches):
        names, weight, matrix, temp = sent.value
        for b in batches:
            texts = b.column("_t").to_pylist()
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if names:
                for lo, counts in gram_counts([x or "" for x in texts]):
                    p = softmax((tf_idf(counts, weight) @ matrix[:, :-1].T + matrix[:, -1]).astype(np.float64) / temp)
                    for i, q in enumerate(p):
                        if any(map(str.isalpha, texts[lo + i] or "")):
                            k = int(q.argmax())
                            pred[lo + i], score[lo + i] = names[k], min(1.0, q[k])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(id_remainder(4) == 2, F.lit(False)).alias("held_out"), F.col("text").alias("_t"))
    return rows.mapInArrow(apply, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
