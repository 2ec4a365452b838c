"""SimHash near duplicates with pigeonring filtering.

Fingerprints are cut into SEGMENTS on a ring. Two fingerprints within BUDGET differing bits agree on at least
SEGMENTS - BUDGET segments, so they meet in a table keyed by three whole segments (35 tables of 27 bits). Of the
pairs that meet, only those go to the full Hamming check for which some segment starts a chain of consecutive
segments whose cumulative differences stay within the proportional budget, l * BUDGET / SEGMENTS for every length l.

Only distinct fingerprints are joined, so exact copies cost one row. A table key that many fingerprints share is cut
into blocks of about BLOCK and every pair of blocks is a task of its own. From each block pair only a spanning forest
of its links goes on, so a class of n near copies yields about n links and not n squared, and classes come out whole.

Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other; texts of fewer
words than a shingle are one shingle; repeated rows share a component. Null ids are never a component's name unless all
its ids are null. An empty table gives an empty result. Extra columns are passed over, or kept by ``keep_one``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_view, row_key, stage, text_of, whole_rows
from .components import components

SHINGLE, BUDGET = 4, 4
#: Widths of the segments, from the lowest bit.
WIDTHS = (10, 9, 9, 9, 9, 9, 9)
SEGMENTS = len(WIDTHS)
SHIFTS = tuple(sum(WIDTHS[:i]) for i in range(SEGMENTS))
BLOCK = 1024
SEED = 42


def fingerprint(text: bytes) -> int:
    """64 bits of a text's lower-cased word shingles; zero where there is no word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    k = min(SHINGLE, len(words))
    start = (end - length)[: len(words) - k + 1].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(start, end[k - 1:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i:i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row key and ``fp`` (the fingerprint as a signed 64-bit integer) of every row."""

    def apply(batches):
        for b in batches:
            off, data = byte_view(b.column("_t"))
            raw = data.tobytes()
            fp = np.array([fingerprint(raw[x:y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), pa.array(fp.view(np.int64))], names=["doc_id", "rid", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_key().alias("rid"), text_of().cast("binary").alias("_t"))
    return stage(rows.mapInArrow(apply, f"doc_id {kind}, rid long, fp long"), "fingerprints")


def table_keys() -> Column:
    """The keys under which a fingerprint meets others: every choice of whole segments that a pair in budget must share."""
    part = [F.expr(f"shiftrightunsigned(fp, {s}) & {(1 << w) - 1}L") for s, w in zip(SHIFTS, WIDTHS)]
    keys = []
    for i, chosen in enumerate(combinations(range(SEGMENTS), SEGMENTS - BUDGET)):
        key = F.lit(i).cast("long")
        for s in chosen:
            key = F.shiftleft(key, 10).bitwiseOR(part[s])
        keys.append(key)
    return F.array(*keys)


def ring_viable(x: np.ndarray) -> np.ndarray:
    """Which xors may have BUDGET ones at most: some start's chain keeps within the proportional budget at every length."""
    ones = [np.bitwise_count((x >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int16) for s, w in zip(SHIFTS, WIDTHS)]
    found = np.zeros(len(x), bool)
    for start in range(SEGMENTS):
        total, alive = np.zeros(len(x), np.int16), np.ones(len(x), bool)
        for n in range(1, SEGMENTS + 1):
            total += ones[(start + n - 1) % SEGMENTS]
            alive &= total * SEGMENTS <= n * BUDGET
        found |= alive
    return found


def _forest(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from each node to the first node of its class, for nodes 0..len(fp) under links i-j."""
    label = np.arange(len(fp))
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(fp)))
    return fp[at], fp[label[at]]


def _pair_links(groups: pa.Array) -> pa.RecordBatch:
    """Spanning links of each list of fingerprints."""
    size = np.diff(groups.offsets.to_numpy())
    flat = groups.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    base = np.cumsum(size) - size
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(size[size > 1]).tolist():
        a, b = np.triu_indices(n, 1)
        at = base[size == n]
        for k in range(0, len(at), max(1, 1_000_000 // len(a))):  # bounds the pairs held at once
            some = at[k:k + max(1, 1_000_000 // len(a))]
            i, j = (some[:, None] + a).ravel(), (some[:, None] + b).ravel()
            ok = np.flatnonzero(ring_viable(flat[i] ^ flat[j]))
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(flat[i] ^ flat[j]) <= BUDGET
            left.append(i[ok])
            right.append(j[ok])
    x, y = _forest(flat, np.concatenate(left), np.concatenate(right))
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints reachable by steps of at most BUDGET bits; ``fps`` are distinct."""
    keyed = fps.select("fp", F.explode(table_keys()).alias("k"))
    # the planner takes exploded rows for no more than the fingerprints: left alone, it would broadcast these through the driver
    sizes = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").hint("merge")
    met = keyed.join(sizes, "k").withColumn("blocks", F.ceil(F.col("n") / block))
    dealt = met.withColumn("x", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    groups = dealt.groupBy("k", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.collect_list("fp").alias("fps"))

    def apply(batches):
        for b in batches:
            yield _pair_links(b.column(0))

    return groups.select("fps").mapInArrow(apply, "a long, b long")


def classes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``fp`` and ``root`` of every distinct fingerprint; equal roots are one component."""
    fps = rows.select("fp").distinct()
    found = components(links(fps, block))
    return fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint and component_id (smallest id reachable) of every row."""
    rows = fingerprints(docs)
    of = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")).join(classes(rows, block), "fp"), "classes")
    named = of.join(of.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id (null ids last); of repeated rows one stays."""
    rows = fingerprints(docs)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    firsts = rows.groupBy("fp").agg(best.alias("first")).join(classes(rows, block), "fp")
    stay = firsts.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("rid"), F.col("first.doc_id").alias("id"))
    keyed = whole_rows(docs, rid=row_key(), id=F.col("doc_id")).alias("d")
    same = (F.col("d.rid") == F.col("s.rid")) & F.col("d.id").eqNullSafe(F.col("s.id"))
    return keyed.join(stay.alias("s"), same, "left_semi").dropDuplicates(["rid", "id"]).select("row.*")
