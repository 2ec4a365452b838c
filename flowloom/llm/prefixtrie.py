"""Prefix trie of conversations, its subtree totals by time-forward processing.

1. ``rebuilt_turns``: turns travel as a digest of (role, text) and a length, never as texts. Families of conversations
   are dealt by their base and sorted by the shuffle; one pass over each rebuilds its conversations turn by turn. A
   node is named by a 128-bit hash chained over the digests from the root.
2. Conversations are range-partitioned by the digests of their first turns (ties by id): that is an order of the trie's
   leaves, cut into ranges of equal size, whatever prefixes or copies are hot. Nodes are counts per name, combined in
   the ranges before they are shuffled. A node all of whose members are in one range belongs to that shard.
3. ``forward``: within a shard nodes come in reverse level order, sorted externally by the shuffle. A node takes what its
   children left in the queue and leaves its own totals there for its parent. The queue holds messages to one level
   only and spills sorted runs. Messages to nodes outside the shard leave it.
4. Across shard roots the same step runs on the nodes whose members span several shards: FAN shards make one of the next
   round, which holds the few nodes on its FAN borders and the messages that came up. Rounds end with the root's.

Digests of the members that end at a node are streamed through SHA-256 in the order of their ids.

Null roles and texts are empty. Rows with a null conv_id belong to no conversation and take no part. Null turns come
first; turns of equal number are ordered by the digest of role and text, and repeated rows are repeated turns. A
conversation left without turns is a member of the root. An empty table has no nodes. Extra columns are left behind.
A conversation is worked through by one task, as 40-byte rows that are never held together; so are the ids of members
that end at one node, since SHA-256 has no other order.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

FAMILY, SHARED = 5, 9
#: Turns whose digests order the conversations.
ORDERED = 16
#: Shards of a round that become one of the next.
FAN = 64
#: Messages that a queue holds in memory.
QUEUE = 200_000
ROWS = 8192
ROOT = bytes(16)
TURNS = "conv_id long, depth long, key binary, parent binary, bytes long, path binary, last boolean"
NODE = ["depth", "key", "parent", "bytes", "n_convs", "conv_id"]
TOTALS = "shard long, depth long, key binary, parent binary, bytes long, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long"
_TYPES = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}


def _batches(rows: Iterator[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in ddl.split(", "))])
    out: list = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for r in rows:
        out.append(r)
        if len(out) == ROWS:
            yield batch()
            out = []
    if out:
        yield batch()


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def rebuilt_turns(table: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """Rows (conversation, depth, node, parent node, bytes of the last text, order of the conversation, whether last)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    c = F.col("conv_id").cast("long")
    rows = table.where(c.isNotNull()).select(
        (c - c % family).alias("base"), c.alias("conv_id"), F.col("turn").alias("turn"), (F.crc32(c.cast("string")) % shared).alias("h"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    # the base conversation first, so that its beginning is known when the others come
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "digest"]
    dealt = rows.repartition("base").sortWithinPartitions(*order).select("base", "conv_id", "h", "digest", "bytes")

    def conversations(batches):
        """(conversation, its rebuilt turns as an iterator of (digest, bytes)); each is used up before the next."""
        beginning, at = [], None
        rows = _tuples(batches)
        row = next(rows, None)

        def turns():
            nonlocal row
            base, conv, h = row[:3]
            own = 0
            if conv != base:
                yield from beginning[:h]
            while row is not None and row[1] == conv and row[0] == base:
                own += 1
                if conv == base:
                    if own < shared:
                        beginning.append(row[3:])
                    yield row[3:]
                elif own > h:
                    yield row[3:]
                row = next(rows, None)

        while row is not None:
            if row[0] != at:
                beginning, at = [], row[0]
            yield row[1], turns()

    def rebuild(batches):
        def rows():
            for conv, turns in conversations(batches):
                key, path, depth, held = ROOT, b"", 0, [(0, ROOT, None, 0)]
                for digest, size in turns:
                    parent, depth = key, depth + 1
                    key = hashlib.blake2b(parent + digest, digest_size=16).digest()
                    if depth <= ORDERED:
                        path += digest[:4]
                    else:  # the order is known: only the row that may be the last waits
                        for r in held:
                            yield (conv, *r, path, False)
                        held = []
                    held.append((depth, key, parent, size))
                for r in held:
                    yield (conv, *r, path, r is held[-1])

        return _batches(rows(), TURNS)

    return dealt.mapInArrow(rebuild, TURNS)


class Queue:
    """Messages (level, node, …) in order; beyond ``limit`` in memory, the sorted run is put on scratch of the task.

    A run is a file without a name that only this task reads, and that is gone with it, as Spark's own spills are."""

    RECORD = struct.Struct(">q16sqqq")

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs, self.spilled = limit, [], [], 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            run = tempfile.TemporaryFile()
            run.write(b"".join(self.RECORD.pack(*m) for m in sorted(self.heap)))
            run.seek(0)
            self.heap, self.spilled = [], self.spilled + 1
            heapq.heappush(self.runs, (self._next(run), self.spilled, run))

    def _next(self, run) -> tuple | None:
        raw = run.read(self.RECORD.size)
        return self.RECORD.unpack(raw) if raw else None

    def peek(self) -> tuple | None:
        heads = [x for x in (self.heap[0] if self.heap else None, self.runs[0][0] if self.runs else None) if x is not None]
        return min(heads, default=None)

    def pop(self) -> tuple:
        head = self.peek()
        if self.heap and head is self.heap[0]:
            return heapq.heappop(self.heap)
        _, i, run = heapq.heappop(self.runs)
        if (following := self._next(run)) is not None:
            heapq.heappush(self.runs, (following, i, run))
        else:
            run.close()
        return head


def forward(rows: DataFrame, limit: int = QUEUE) -> DataFrame:
    """One time-forward pass in each shard over nodes and messages to nodes; these have no n_convs.

    Gives each node with its totals, and, for nodes that are not in the shard, messages with the sums for them."""

    def totals(batches):
        def rows():
            shard, queue = None, Queue(limit)

            def leaving(before):
                """Messages to nodes in front of ``before`` in reverse level order, which are not in this shard."""
                while (m := queue.peek()) is not None and (before is None or m[:2] < before):
                    level, key, *sums = queue.pop()
                    while (m := queue.peek()) is not None and m[:2] == (level, key):
                        sums = [a + b for a, b in zip(sums, queue.pop()[2:])]
                    yield (shard, -level, key, None, None, None, None, *sums)

            for s, depth, key, parent, size, n, conv, children, leaves, saved in _tuples(batches):
                if s != shard:
                    yield from leaving(None)
                    shard = s
                yield from leaving((-depth, key))
                if n is None:
                    queue.push((-depth, key, children, leaves, saved))
                    continue
                children = leaves = 0
                saved = (n - 1) * size
                while (m := queue.peek()) is not None and m[:2] == (-depth, key):
                    _, _, more, under, spared = queue.pop()
                    children, leaves, saved = children + more, leaves + under, saved + spared
                leaves = leaves or 1
                if parent is not None:
                    queue.push((1 - depth, parent, 1, leaves, saved))
                yield (s, depth, key, parent, size, n, conv, children, leaves, saved)
            yield from leaving(None)

        return _batches(rows(), TOTALS)

    order = ["shard", F.desc("depth"), "key", F.asc_nulls_first("n_convs")]
    return rows.repartition("shard").sortWithinPartitions(*order).mapInArrow(totals, TOTALS)


def end_digests(turns: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ids of the conversations that end at the node, ascending, joined by commas."""

    def digest(batches):
        def rows():
            at = sha = None
            for key, conv in _tuples(batches):
                if key != at:
                    if at is not None:
                        yield at, sha.hexdigest()
                    at, sha = key, hashlib.sha256(b"%d" % conv)
                else:
                    sha.update(b",%d" % conv)
            if at is not None:
                yield at, sha.hexdigest()

        return _batches(rows(), "key binary, ends_sha256 string")

    ends = turns.where("last").select("key", "conv_id")
    return ends.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(digest, "key binary, ends_sha256 string")


def prefix_trie(table: DataFrame, shards: int | None = None, fan: int = FAN, limit: int = QUEUE) -> DataFrame:
    """Every node of the trie of rebuilt conversations with its totals."""
    turns = stage(rebuilt_turns(table), "turns")
    dealt = turns.repartitionByRange(*([shards] if shards else []), "path", "conv_id").withColumn("s", F.spark_partition_id().cast("long"))
    nodes = stage(dealt.groupBy("depth", "key", "parent", "bytes").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("s").alias("low"), F.max("s").alias("high")), "nodes")

    last = nodes.agg(F.max("high")).first()[0]
    done, messages, width = [], None, 1
    while True:
        cell = lambda c, w=width: F.floor(F.col(c) / F.lit(w)).cast("long")
        mine = cell("low") == cell("high")
        if width > 1:  # not already in a shard of the round before
            mine &= F.floor(F.col("low") / F.lit(width // fan)) != F.floor(F.col("high") / F.lit(width // fan))
        none = F.lit(0).cast("long")
        rows = nodes.where(mine).select(cell("low").alias("shard"), *NODE, none.alias("n_children"), none.alias("n_leaves"), none.alias("saved_tokens"))
        if messages is not None:
            rows = rows.unionByName(messages.withColumn("shard", F.floor(F.col("shard") / fan).cast("long")))
        out = stage(forward(rows, limit), "totals")
        done.append(out.where(F.col("n_convs").isNotNull()))
        messages = out.where(F.col("n_convs").isNull())
        if last is None or last < width:  # one shard had everything
            break
        width *= fan

    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = whole.join(end_digests(turns), "key", "left").join(parents, "parent", "left")
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
