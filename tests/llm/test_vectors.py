"""Hard negatives, exact inner-product search and the prefix trie against brute force: nulls, ties, repeated rows, vectors
of several sizes, hot labels and beginnings, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from flowloom.llm import innertop, negatives, prefixtrie, vectors

VECTORS = "vec_id long, embedding array<float>, label int, score string, number int, rank int"


def made_vectors(n=700, seed=1):
    """Whole quarters, so scores tie often; label 3 has half of the rows; some rows are broken, some repeated."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        d = 6 if i % 9 else 4
        x = [r.randrange(-8, 9) / 4 for _ in range(d)]
        if i % 50 == 0:
            x[0] = 2.0
        label = 3 if r.random() < 0.5 else r.randrange(10)
        if i % 97 == 5:
            x[1] = [None, math.nan, math.inf, 1e30][i % 4]
        rows.append((i, None if i % 101 == 7 else x, None if i % 103 == 9 else label, "x", 1, 2))
    rows += [rows[10], rows[11], rows[200], (None, [1.0] * 6, 1, "x", 1, 2), (900, [], 1, "x", 1, 2), (1000, [], 2, "x", 1, 2), (1100, [0.0] * 6, 3, "x", 1, 2)]
    return rows


def usable(rows, label):
    out = []
    for i, x, y, *_ in rows:
        if i is None or x is None or (label and y is None) or any(v is None or not math.isfinite(v) or abs(v) > 1e5 for v in x):
            continue
        out.append((i, [math.floor(256 * float(np.float32(v))) for v in x], y))
    return out


def ranked(rows, a):
    s = [(-sum(p * q for p, q in zip(a[1], b[1])), b[0], b[2]) for b in rows if b[0] != a[0] and len(b[1]) == len(a[1])]
    return [(-s, i, y) for s, i, y in sorted(s, key=lambda t: t[:2])]


def brute_negatives(rows):
    rows = [(i, x, (y + 1) % 10 if i % 7 == 0 else y) for i, x, y in usable(rows, True)]
    out = []
    for a in rows:
        if a[0] % 100:
            continue
        order = ranked(rows, a)
        for ps, pid, _ in [t for t in order if t[2] == a[2]][:5]:
            window = [t for t in order if t[2] != a[2] and 30 * ps <= 100 * t[0] <= 90 * ps][:10]
            out += [(a[0], pid, k + 1, i, ps, s) for k, (s, i, _) in enumerate(window)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_hard_negatives(spark):
    rows = made_vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    want = brute_negatives(rows)
    assert len(want) > 200 and got(negatives.hard_negatives(df)) == want


def test_hard_negatives_in_many_blocks(spark, monkeypatch):
    rows = made_vectors(seed=2)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", (16, 16))
    monkeypatch.setattr(vectors, "STEP", 7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got(negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3))) == brute_negatives(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def brute_top(rows):
    rows = usable(rows, False)
    return sorted((a[0], k + 1, i, s) for a in rows if a[0] % 50 == 0 for k, (s, i, _) in enumerate(ranked(rows, a)[:5]))


@pytest.mark.parametrize("dense, broadcast", [(0.1, "10m"), (2.0, "-1")])
def test_inner_products(spark, monkeypatch, dense, broadcast):
    monkeypatch.setattr(innertop, "DENSE", dense)
    rows = made_vectors(seed=3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        assert got(innertop.top_inner_products(spark.createDataFrame(rows, VECTORS).repartition(5))) == brute_top(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_search_prunes_by_length_and_residual():
    """Lengths fall off and one direction dominates: most rows are left without a product, and the best are right."""
    r = np.random.default_rng(0)
    x = (r.normal(size=(4000, 32)) * np.geomspace(40, 0.5, 32) * r.pareto(2, (4000, 1))).astype(np.int32)
    x = x[np.argsort(-(x.astype(np.int64) ** 2).sum(1), kind="stable")]

    def block(x):
        h = innertop.heads(32)
        f = x.astype(np.float64)
        return innertop.Turned({"number": 0, "dim": 32, "rows": len(x), "ids": np.arange(len(x)).tobytes(), "ints": x.tobytes(),
                                "norms": np.sqrt((f ** 2).sum(1)).tobytes(), "rotated": f.astype(np.float32).tobytes(),
                                "rest": np.stack([np.sqrt((f[:, k:] ** 2).sum(1)) for k in h]).astype(np.float32).tobytes()})

    class Counting(vectors.Best):
        offered = 0

        def offer(self, row, score, ids):
            Counting.offered += len(row)
            super().offer(row, score, ids)

    q, c = block(x[:20]), block(x)
    best = Counting(20, 5)
    innertop.search(q, c, best)
    for i in range(20):
        s = x.astype(np.int64) @ x[i].astype(np.int64)
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:5]
        assert best.ids[i].tolist() == order and best.scores[i].tolist() == s[order].tolist()
    assert Counting.offered < 20 * 4000 * 0.2


def test_products_are_exact():
    big = np.full((1, 3), (1 << 27) - 1, np.int32)
    for bound, a in ((3 << 54, big), (1 << 40, np.array([[1 << 20, -3, 5]], np.int32)), (100, np.array([[1, 2, 3]], np.int32))):
        assert vectors.products(a, a, bound)[0, 0] == sum(int(v) ** 2 for v in a[0])


def test_empty_vectors(spark):
    nothing = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(nothing).count() == 0 and innertop.top_inner_products(nothing).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1, "", 0, 0), (1, None, 1, "", 0, 0)], VECTORS)
    assert negatives.hard_negatives(alone).count() == 0 and innertop.top_inner_products(alone).count() == 0


# ---- prefix trie -------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth int, key string, shard string"


def made_turns(seed=4):
    """A third of the conversations begin alike, some are copies, one is very long, some ids are missing or negative."""
    r = random.Random(seed)
    rows = []
    for c in [*range(-7, 120), 500]:
        if c % 11 == 3:
            continue
        n = 300 if c == 40 else r.randrange(0, 14)
        for t in range(n):
            role, text = r.choice(["user", None, ""]), r.choice(["a", "é", "", None, "ab" * 3])
            if c % 3 == 0 and t < 2:
                role, text = "user", "the same beginning"
            if c % 10 == 5:
                role, text = "user", f"copied {t}"
            rows.append((c, None if t == 0 and c % 4 == 0 else t, role, text, 1, "k", "s"))
    rows += [(None, 1, "user", "lost", 1, "k", "s")]
    r.shuffle(rows)
    return rows


def brute_trie(rows):
    convs = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((t is not None, t or 0), digest, (role, text)))
    convs = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids, leaves, saved = ({k: 0 for k in members} for _ in range(3))
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1].encode()) if k else 0)
            leaves[k[:d]] += not kids[k]
    ends = {k: ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)) for k, m in members.items()}
    out = [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()]
    return sorted(out, key=str)


@pytest.mark.parametrize("shards, fan, limit", [(None, 64, 200_000), (9, 2, 3)])
def test_prefix_trie(spark, shards, fan, limit):
    rows = made_turns()
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    assert sorted((tuple(r) for r in prefixtrie.prefix_trie(df, shards, fan, limit).collect()), key=str) == brute_trie(rows)


def test_repeated_turns_and_no_turns(spark):
    rows = [(1, 1, "u", "a", 0, "", ""), (1, 1, "u", "a", 0, "", ""), (1, 1, "u", "b", 0, "", "")]
    assert sorted((tuple(r) for r in prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()), key=str) == brute_trie(rows)
    assert prefixtrie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_queue_spills_in_order():
    r = random.Random(6)
    queue, want = prefixtrie.Queue(limit=10), []
    for _ in range(500):
        m = (-r.randrange(20), bytes([r.randrange(5)]) * 16, 1, r.randrange(9), 2)
        queue.push(m)
        want.append(m)
    assert queue.spilled > 5
    out = []
    while queue.peek() is not None:
        out.append(queue.pop())
    assert out == sorted(want)
