"""Mixture-controlled packing by deficit round-robin over source queues.

Documents are tokenised once; each source is a queue of its documents' tokens. A window holds WINDOW tokens. In
every window queue s is owed weight_s / sum(weights) of it, and is served the whole tokens it is owed by then less those
served before: the fraction left over is its deficit and is carried to the next window, across any border
of windows and partitions. As the served total after w windows has a closed form, floor(weight_s * WINDOW * w /
sum(weights)), every task finds the place of its documents by itself; only sums per (queue, task) are accumulated.
The weights are the queues' token totals unless a target is given; with a target, a queue that runs dry
leaves its share unused and windows get smaller. Windows follow each other without gaps and are cut into sequences of
SEQUENCE tokens, so only the last sequence is short.

Null and empty texts are the end id alone. A null source is a queue of its own; rows are kept apart whatever their
ids (null or repeated). Over MAX_QUEUES sources share queues by a hash of their name, which bounds what every task
is sent. An empty table gives no pieces. Extra columns are passed over.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staging_dir, text_of
from .pretokens import model_text, worker_encoder

SEQUENCE = 1024
WINDOW = 64 * SEQUENCE
END = 0
MAX_QUEUES = 4096
NO_SOURCE = "\0null"


def _stage_packed(df: DataFrame, name: str) -> DataFrame:
    """As ``common.stage``, in a denser format: ids are most of what is written."""
    path = staging_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenised(docs: DataFrame, model: str, queues: int) -> DataFrame:
    """part, before (tokens of the same queue earlier in this part), doc_id, queue, n, ids (16 or 32 bits each) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE))
    queue = name if queues <= MAX_QUEUES else F.concat(F.lit("hash "), F.pmod(F.xxhash64(name), F.lit(MAX_QUEUES)).cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = str(hash(model))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, served = TaskContext.get().partitionId(), {}
        encoder = worker_encoder(key, sent.value, "byte_level")
        for b in batches:
            texts, rows = b.column("_t").to_pylist(), {"part": [], "before": [], "n": [], "ids": []}
            for q, ids in zip(b.column("queue").to_pylist(), encoder.encode(texts)):
                n = len(ids) + 1
                rows["part"].append(part)
                rows["before"].append(served.get(q, 0))
                rows["n"].append(n)
                rows["ids"].append(np.append(ids, END).astype("<u4" if n > 1 and ids.max() > 0xFFFF else "<u2").tobytes())
                served[q] = served.get(q, 0) + n
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["part"], pa.int32()), pa.array(rows["before"], pa.int64()), b.column("doc_id"), b.column("queue"), pa.array(rows["n"], pa.int64()), pa.array(rows["ids"], pa.binary())],
                names=["part", "before", "doc_id", "queue", "n", "ids"])

    rows = docs.select("doc_id", queue.alias("queue"), text_of().alias("_t"))
    return _stage_packed(rows.mapInArrow(apply, f"part int, before long, doc_id {kind}, queue string, n long, ids binary"), "ids")


class Rounds:
    """Who is served what: the closed form of the round-robin."""

    def __init__(self, totals: list[int], weights: list[int], window: int):
        self.totals, self.weights, self.all, self.window = totals, weights, max(1, sum(weights)), window
        self.cache: dict[int, list[int]] = {}

    def served(self, w: int) -> list[int]:
        """Tokens of each queue in the first ``w`` windows."""
        if w not in self.cache:
            if len(self.cache) > 10_000:
                self.cache.clear()
            self.cache[w] = [min(t, p * self.window * w // self.all) for t, p in zip(self.totals, self.weights)]
        return self.cache[w]

    def pieces(self, q: int, start: int, n: int) -> Iterator[tuple[int, int, int]]:
        """The queue's tokens ``start`` .. ``start + n`` as (offset from start, length, place in the stream of sequences)."""
        done = 0
        w = start * self.all // (self.weights[q] * self.window)
        while done < n:
            at = start + done
            while self.served(w + 1)[q] <= at:
                w += 1
            while self.served(w)[q] > at:
                w -= 1
            low, high = self.served(w), self.served(w + 1)
            take = min(n - done, high[q] - at)
            place = sum(low) + sum(high[:q]) - sum(low[:q]) + at - low[q]
            while take:
                some = min(take, SEQUENCE - place % SEQUENCE)
                yield done, some, place
                done, take, place = done + some, take - some, place + some


def pack(docs: DataFrame, target: dict[str, int] | None = None, model: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents. ``target``: positive whole weights by source name; sources it does not name get weight 1."""
    spark = docs.sparkSession
    queues = docs.select("source").distinct().count()
    rows = tokenised(docs, model or model_text("byte_bpe_50k.json"), queues)
    sums = rows.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = _stage_packed(sums.select("queue", "part", "n", F.coalesce(earlier, F.lit(0)).alias("earlier")), "parts")
    totals = sorted((r.queue, r.n) for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect())  # MAX_QUEUES rows at most
    names = {q: i for i, (q, _) in enumerate(totals)}
    weights = [int((target or {}).get(q, 1)) if target else n for q, n in totals]
    sent = spark.sparkContext.broadcast((names, [n for _, n in totals], weights))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total, weight = sent.value
        rounds = Rounds(total, weight, window)
        for b in batches:
            which, out = [], [[] for _ in range(6)]
            columns = (b.column(c).to_pylist() for c in ("queue", "place", "n", "ids"))
            for i, (q, place, n, raw) in enumerate(zip(*columns)):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                for start, length, at in rounds.pieces(number[q], place, n):
                    which.append(i)
                    for col, v in zip(out, (start, length, zlib.crc32(ids[start:start + length].tobytes()), n, at // SEQUENCE, at % SEQUENCE)):
                        col.append(v)
            which = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(which), *[pa.array(c, pa.int64()) for c in out], b.column("queue").take(which)], names=fields)

    placed = rows.join(parts.select("queue", "part", "earlier"), ["queue", "part"])
    placed = placed.select("doc_id", "queue", "n", "ids", (F.col("before") + F.col("earlier")).alias("place"))
    return placed.mapInArrow(cut, schema)
