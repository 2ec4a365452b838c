"""Plain-Python counterparts of the document operators, for small tables."""

import hashlib
import re
from collections import defaultdict

import xxhash

SF = "/root/testdata/sf0.001"
#: Columns with names that the operators use inside.
CLASH = ("row", "rid", "id", "score", "kept", "text_sha256", "n_points", "maybe", "part", "home", "fp", "h", "item", "queue", "_t")


def edge_rows():
    long = " ".join(f"word{i % 977} and{i % 13}," for i in range(9000)) + " end."
    near = long.replace("word5 ", "other ", 3)
    return [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, long), (6, long), (6, long), (7, near), (None, "Some words without any id at all, fifty bytes and a few more."),
            (None, None), (9, "Some words without any id at all, fifty bytes and a few more."), (10, "12345 67890 !!! ???"), (11, "The same  text"), (12, "The same text"), (13, "Thesametext"),
            (14, "naïve café 中文 🙂 it's <|endoftext|> done"), (15, "a" * 300), (16, "b" + "a" * 300)]


def edge_table(spark, rows=None):
    rows = edge_rows() if rows is None else rows
    data = [(i, t, ("en", None, "fr")[k % 3], ("s1", "s2", None)[k % 3], k, *["x"] * len(CLASH)) for k, (i, t) in enumerate(rows)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(data, kinds)


def sample_rows():
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def covered(rows, span=50):
    """(id, text bytes, covered flags) of every row."""
    first = defaultdict(lambda: float("inf"))
    key = lambda i: float("inf") if i is None else i
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - span + 1):
            w = b[k:k + span]
            first[w] = min(first[w], key(i))
    for i, b in raw:
        flags = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if first[b[k:k + span]] < key(i):
                flags[k:k + span] = b"\1" * span
        yield i, b, flags


def fingerprint(text):
    w = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    w = [x for x in w if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(rows):
    """Smallest id that each row reaches; ids may repeat or be null."""
    fps = [fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[top(i)] = top(j)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        r = top(k)
        if i is not None and (least[r] is None or i < least[r]):
            least[r] = i
    return [(i, f"{f:016x}", least[top(k)]) for k, ((i, _), f) in enumerate(zip(rows, fps))]


BASE = [("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]


def secrets(text):
    found = sorted((m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, p, g, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= least)
    n = [sum(r == rank for _, r, _ in found) for rank in range(3)]
    spans = ",".join(x for _, _, x in found)
    return (*n, hashlib.sha256(spans.encode()).hexdigest(), spans)


def exact_groups(rows):
    groups = defaultdict(list)
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    for (i, t), b in zip(rows, bare):
        groups[b].append((-len(t or ""), i is None, i))
    best = {b: min(g, key=lambda x: (x[0], x[1], x[2] or 0)) for b, g in groups.items()}
    return [(i, best[b][2], len(groups[b]), i == best[b][2] and -len(t or "") == best[b][0], hashlib.sha256(b.encode()).hexdigest()) for (i, t), b in zip(rows, bare)]
