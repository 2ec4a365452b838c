"""Token counts by a two-tier look-up on the map side.

Tier one is a table of the lengths (in tokens) of the FREQUENT most frequent pre-tokens, found over all documents: every
task keeps its TASK_TOP most frequent hashes, and their sums are ranked. It has a fixed size and is broadcast. What it
lacks is encoded once per worker and kept in the worker's own cache (tier two). No pre-token is ever shuffled; texts are
read where they lie and only the tasks' short summaries move.

Null texts count as empty and have 0 tokens; every row gives one row, whatever its id; an empty table gives an empty
result. Extra columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .pretokens import _steps, model_text, worker_encoder

FREQUENT, TASK_TOP = 32_768, 8_192
LIMIT = 2048


def frequent_lengths(docs: DataFrame, model: str, cut: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent pre-tokens, and their lengths in tokens: FREQUENT rows at most."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = f"{hash(model)} summary"

    def summarise(batches):
        encoder = worker_encoder(key, sent.value, cut)
        keys, n, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in _steps(texts):
                _, joined, h, at, end, _ = encoder.pieces(texts[lo:hi])
                if not len(h):
                    continue
                k, first, c = np.unique(h, return_index=True, return_counts=True)
                both, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([n, c]), len(both)).astype(np.int64)
                lengths = np.full(len(both), -1, np.int64)
                lengths[back[: len(keys)]] = size
                example = np.zeros(len(both), np.int64)
                example[back[len(keys):]] = first
                top = np.sort(np.argpartition(-counts, TASK_TOP)[:TASK_TOP]) if len(both) > TASK_TOP else np.arange(len(both))
                new = top[lengths[top] < 0]
                e = example[new]
                found = encoder.tokenizer.encode_batch_fast([joined[x:y] for x, y in zip(at[e].tolist(), end[e].tolist())], add_special_tokens=False)
                lengths[new] = [len(f.ids) for f in found]
                keys, n, size = both[top], counts[top], lengths[top]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(size)], names=["h", "n", "size"])

    tops = docs.select(text_of().alias("_t")).mapInArrow(summarise, "h long, n long, size long")
    best = tops.groupBy("h").agg(F.sum("n").alias("n"), F.max("size").alias("size")).orderBy(F.desc("n"), "h").limit(FREQUENT)
    rows = best.select("h", "size").collect()
    h, size = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.size for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], size[order]


def token_counts(docs: DataFrame, model: str | None = None, cut: str = "lower_words", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    model = model or model_text("word_bpe_49k.json")
    table = frequent_lengths(docs, model, cut)
    sent = docs.sparkSession.sparkContext.broadcast((model, table))
    key = f"{hash(model)} {hash(table[0].tobytes())}"
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        encoder = worker_encoder(key, sent.value[0], cut, sent.value[1])
        for b in batches:
            n = encoder.counts(b.column("_t").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("_t"))
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
