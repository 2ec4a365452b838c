"""Suffix-array dedup: every byte covered by a SPAN-byte string that also starts in an earlier document is removed.

Anchors bring equal strings together. Every SPAN-byte window picks the least hash among its GRAM-byte grams; equal
windows pick equal grams at equal places. Neighbouring windows that picked the same occurrence form a *segment*, the
text from the first one's start to the last one's end (SPAN to 2 * SPAN bytes).

1. Anchors (gram hash, segment hash, hashes of the text left and right of the gram) are dealt by gram. Equal segments (by
   all 64 bits of their hash) are one class: all but those of its first document are wholly covered. A window reaches REACH bytes past its gram on
   one side at least, so two classes can share a window only if they agree on one side; only the first segments of such
   classes are still open.
2. The open segments' texts are fetched and dealt by gram, and their suffixes are sorted in two stages: those smaller
   than their successor directly, the rest induced by one scan of the character buckets. Neighbours in that order with
   a common prefix of SPAN bytes are one string; its least document is the first to have it.
3. What was found goes back to the documents, whose covered runs are cut out.

Equal segments within one numpy step are settled there and only the first is dealt, so text that a third of all rows
repeats is one entry per step. A gram with more than HOT open segments is not sorted in one task: its windows are dealt
by their own hash, where equal windows meet and again one per task is enough.

Texts travel once, in compressed blocks dealt by document, and that one exchange serves steps 2 and 3.

Null texts are empty; texts shorter than SPAN lose nothing. Rows with equal ids are no earlier than each other and lose
nothing to each other; null ids are later than all others and equal among themselves. An empty table gives an
empty result. Extra columns are passed over, and texts are never moved except to the tasks that cut them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, prefix_sums, range_hash, row_key, stage, steps, text_of

SPAN, GRAM = 50, 8
REACH = (SPAN - GRAM) // 2
#: Text per group of documents, and groups of documents for one of grams: fewer of these mean more entries of a document
#: in each, and so fewer bytes to name it.
PART_BYTES, MOST_PARTS, HOMES_PER_PART = 8_000_000, 1 << 18, 4
#: Open segments of one gram that are sorted together (1 MB of text at most).
HOT = 10_000
#: Text per numpy step of the anchors, and per suffix array (about 100 and 130 bytes of memory for each).
STEP, SORT_BYTES = 750_000, 750_000
#: Bytes of a gram (it only brings segments together, some chance company does no harm) and of a side's hash (segments that agree
#: by chance are fetched for nothing, and the more often the more segments a gram has).
GRAM_BYTES, SIDE_BYTES = 2, 3
#: Low bits of a window's key that hold the place.
_PLACE = 26
_LAST = np.iinfo(np.int64).max


def anchors(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of the texts ``data[offsets[i]:offsets[i+1]]``, in order: first and last window, text, gram hash, segment
    hash, and the hashes (SIDE_BYTES) of REACH bytes left and right of the gram (0: no window reaches that far)."""
    n = len(data)
    at = np.arange(n - GRAM + 1 if n >= SPAN else 0)
    start = at[:0]
    if len(at):
        sums = prefix_sums(data)
        gram = range_hash(sums, at, at + GRAM)
        low = np.uint64((1 << max(_PLACE, int(n).bit_length())) - 1)
        best = (gram & ~low) | at.astype(np.uint64)
        width, todo = 1, SPAN - GRAM + 1
        while width < todo:  # least key of every run of ``width`` grams
            step = min(width, todo - width)
            best = np.minimum(best[:-step], best[step:])
            width += step
        ends = np.repeat(offsets[1:], np.diff(offsets))[: len(best)]
        start = np.flatnonzero(np.arange(len(best)) + SPAN <= ends)
    if not len(start):
        none = np.zeros(0, np.int64)
        return dict.fromkeys(("first", "last", "row"), none) | dict.fromkeys(("gram", "segment", "left", "right"), none.astype(np.uint64))
    pick = (best[start] & low).astype(np.int64)
    new = np.r_[True, (pick[1:] != pick[:-1]) | (start[1:] != start[:-1] + 1)]
    first, last, pick = start[new], np.r_[start[np.flatnonzero(new)[1:] - 1], start[-1]], pick[new]
    reaches = [first <= pick - REACH, last >= pick - REACH]
    sides = []
    for can, a in zip(reaches, (pick - REACH, pick + GRAM)):
        a = np.where(can, a, 0)
        sides.append(np.where(can, np.maximum(range_hash(sums, a, a + REACH) >> np.uint64(64 - 8 * SIDE_BYTES), np.uint64(1)), np.uint64(0)))
    return {"first": first, "last": last, "row": np.searchsorted(offsets, first, "right") - 1, "gram": gram[pick], "segment": range_hash(sums, first, last + SPAN), "left": sides[0], "right": sides[1]}


def step_anchors(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """``anchors``, with a text longer than STEP (always a step of its own) taken in parts that share no window, so that
    memory is bounded by STEP; a segment across a border becomes two, the same two whenever the text is read."""
    if len(offsets) != 2 or offsets[1] - offsets[0] <= STEP + SPAN:
        return anchors(data, offsets)
    found = []
    for lo in range(0, len(data) - SPAN + 1, STEP):
        part = data[lo:lo + STEP + SPAN - 1]
        a = anchors(part, np.array([0, len(part)]))
        found.append(a | {"first": a["first"] + lo, "last": a["last"] + lo})
    return {k: np.concatenate([f[k] for f in found]) for k in found[0]}


def _ordinals(row: np.ndarray) -> np.ndarray:
    """Number of each entry within its row; rows are in order."""
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return np.arange(len(row)) - np.repeat(begin, np.diff(np.r_[begin, len(row)])) if len(row) else row


# ---- what travels: columns of numbers as bytes, one row for each sender and receiver ------------------------------

def _low_bytes(x: np.ndarray, n: int) -> bytes:
    """The last ``n`` bytes of 64-bit numbers."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _from_low_bytes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.view(np.uint64).ravel()


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest of them needs."""
    x = x.astype(np.int64).view(np.uint64)
    return _low_bytes(x, -(-int(x.max()).bit_length() // 8) or 1) if len(x) else b""


def _widened(raw: bytes, count: int) -> np.ndarray:
    return _from_low_bytes(raw, len(raw) // count if count else 1).view(np.int64)


def _names(doc: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Row key and order of entries' documents, one for neighbours of the same, and at which entries a new one begins."""
    new = np.r_[True, doc[1:, 0] != doc[:-1, 0]][:len(doc)]
    return doc[new, 0].tobytes(), _narrow(doc[new, 1]), np.packbits(new).tobytes()


def _named(rids: bytes, orders: bytes, new: bytes, count: int) -> np.ndarray:
    """What ``_names`` was given, ``count`` entries."""
    rid = np.frombuffer(rids, np.int64)
    which = np.cumsum(np.unpackbits(np.frombuffer(new, np.uint8), count=count), dtype=np.int64) - 1
    return np.stack([rid, _widened(orders, len(rid))], 1)[which]


PACKED = "home long, block binary"
ENTRIES = "part long, gram binary, segment binary, sides binary, doc binary, orders binary, new binary, ordinal binary"
#: text: the segments one after the other, compressed
TEXT = "zstd"
#: code: ordinal * 4 + 1 for a covered segment, + 2 for an open one, + 3 for an open one of a hot gram
REPLIES = "home long, rid binary, code binary, mask binary"
OPEN = "part long, hot boolean, gram binary, doc binary, orders binary, new binary, ordinal binary, windows binary, text binary"


def _split(part: np.ndarray):
    """Order by part, and (part, slice) of each."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
    return order, [(int(part[order[a]]), slice(a, b)) for a, b in zip(cut, np.r_[cut[1:], len(order)])] if len(order) else []


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _home(rid: np.ndarray, parts: int) -> np.ndarray:
    return (rid.view(np.uint64) % np.uint64(parts)).astype(np.int64)


def _reply_rows(rid: np.ndarray, code: np.ndarray, mask: np.ndarray | None, parts: int) -> list[tuple]:
    order, slices = _split(_home(rid, parts))
    rid, code = rid[order], code[order].astype("<u4")
    mask = None if mask is None else mask[order]
    return [(h, rid[s].tobytes(), code[s].tobytes(), b"" if mask is None else mask[s].tobytes()) for h, s in slices]


# ---- step 1 ------------------------------------------------------------------------------------------------------

def _send_anchors(parts: int, homes: int):
    schema = _arrow(ENTRIES)

    def apply(batches):
        for b in batches:
            off, data = byte_view(b.column("_t"))
            ids = np.stack([b.column("rid").to_numpy(), b.column("ord").to_numpy()], 1)
            for lo, hi in steps(np.diff(off), STEP):
                a = step_anchors(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                doc, number = ids[lo + a["row"]], _ordinals(a["row"])
                order = np.lexsort((doc[:, 1], a["segment"], a["gram"]))
                g, s, o = a["gram"][order], a["segment"][order], doc[order, 1]
                begin = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])]) if len(g) else order
                later = o > np.repeat(o[begin], np.diff(np.r_[begin, len(o)]))
                rows = []
                settled = order[later]  # an earlier text of this step has the segment: no need to ask
                if len(settled):
                    for h, rid, code, _ in _reply_rows(doc[settled, 0], number[settled] * 4 + 1, None, homes):
                        rows.append((-1 - h, b"", b"", b"", rid, b"", b"", code))
                go = np.sort(order[~later])
                order, slices = _split((a["gram"][go] % np.uint64(parts)).astype(np.int64))
                go = go[order]
                sides = np.stack([a["left"], a["right"]], 1).astype(np.uint64)
                for p, x in slices:
                    k = go[x]
                    rows.append((p, _low_bytes(a["gram"][k] // np.uint64(parts), GRAM_BYTES), _low_bytes(a["segment"][k], 8), _low_bytes(sides[k].ravel(), SIDE_BYTES), *_names(doc[k]), _narrow(number[k])))
                yield _batch(rows, schema)

    return apply


def _settle(homes: int, most: int):
    schema = _arrow(REPLIES)

    def apply(key, table):
        cols = table.to_pydict()
        if key[0].as_py() < 0:
            return pa.Table.from_batches([_batch([(-1 - key[0].as_py(), r, c, b"") for r, c in zip(cols["doc"], cols["ordinal"])], schema)])
        gram, segment, side = (_from_low_bytes(b"".join(cols[c]), n) for c, n in (("gram", GRAM_BYTES), ("segment", 8), ("sides", SIDE_BYTES)))
        side, count = side.reshape(-1, 2), [len(g) // GRAM_BYTES for g in cols["gram"]]
        doc = np.concatenate([_named(*x) for x in zip(cols["doc"], cols["orders"], cols["new"], count)])
        number = np.concatenate([_widened(*x) for x in zip(cols["ordinal"], count)])
        order = np.lexsort((doc[:, 1], segment, gram))
        gram, segment, side, doc, number = gram[order], segment[order], side[order], doc[order], number[order]
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        new_class = new_gram | np.r_[True, segment[1:] != segment[:-1]]
        of_gram, of_class, begin = np.cumsum(new_gram) - 1, np.cumsum(new_class) - 1, np.flatnonzero(new_class)
        full = doc[:, 1] > doc[begin, 1][of_class]
        matched = np.zeros(len(begin), bool)
        for x in (0, 1):  # classes of one gram that agree on a side
            k = (of_gram[begin].astype(np.uint64) << np.uint64(8 * SIDE_BYTES)) | side[begin, x]
            _, back, n = np.unique(k, return_inverse=True, return_counts=True)
            matched |= (n[back] > 1) & (side[begin, x] > 0)
        ask = matched[of_class] & ~full
        hot = np.bincount(of_gram[ask], minlength=of_gram[-1] + 1)[of_gram] > most
        said = full | ask
        code = number * 4 + np.where(full, 1, np.where(hot, 3, 2))
        return pa.Table.from_batches([_batch(_reply_rows(doc[said, 0], code[said], None, homes), schema)])

    return apply


# ---- step 2 ------------------------------------------------------------------------------------------------------

def _pack(batches):
    """The documents of each batch as one compressed block for each home."""
    schema = _arrow(PACKED)
    how = pa.ipc.IpcWriteOptions(compression=pa.Codec(TEXT, compression_level=3))
    for b in batches:
        order, slices = _split(b.column("home").to_numpy())
        docs, rows = b.drop_columns(["home"]), []
        for h, x in slices:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, docs.schema, options=how) as w:
                w.write_batch(docs.take(pa.array(order[x])))
            rows.append((h, out.getvalue().to_pybytes()))
        yield _batch(rows, schema)


def _unpacked(blocks: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in blocks.column("block").to_pylist()])


def _texts(docs: pa.Table):
    """Joined bytes, offsets, row keys and order of a group of documents, one row for each key."""
    rid = docs.column("rid").combine_chunks().to_numpy()
    _, keep = np.unique(rid, return_index=True)
    docs = docs.take(pa.array(keep))
    raw = docs.column("_t").to_pylist()
    data = np.frombuffer(b"".join(raw), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), docs.column("rid").combine_chunks().to_numpy(), docs


def _said(replies: pa.Table, rids: np.ndarray):
    """Row, ordinal, kind and mask of all replies to these documents."""
    rid = np.frombuffer(b"".join(replies.column("rid").to_pylist()), np.int64)
    code = np.frombuffer(b"".join(replies.column("code").to_pylist()), "<u4").astype(np.int64)
    masks = [m or b"\xff" * (2 * len(c)) for m, c in zip(replies.column("mask").to_pylist(), replies.column("code").to_pylist())]
    mask = np.frombuffer(b"".join(masks), np.uint64)
    return np.searchsorted(rids, rid), code // 4, code % 4, mask


def _placed(a: dict[str, np.ndarray], rows: int, row: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Index into the anchors of the group for (row, ordinal)."""
    return np.searchsorted(a["row"], np.arange(rows))[row] + number


def _fetch(parts: int):
    schema = _arrow(OPEN)

    def apply(key, blocks, replies):
        if not blocks.num_rows or not replies.num_rows:
            return pa.Table.from_batches([], schema)
        data, off, rids, docs = _texts(_unpacked(blocks))
        orders = docs.column("ord").combine_chunks().to_numpy()
        row, number, kind, _ = _said(replies, rids)
        a = _all_anchors(data, off)
        rows = []
        for hot in (False, True):
            ask = np.flatnonzero(kind == 3 if hot else kind == 2)
            k = _placed(a, len(rids), row[ask], number[ask])
            by = np.argsort(k)  # by document
            k, ask = k[by], ask[by]
            doc, num, window = np.stack([rids[row[ask]], orders[row[ask]]], 1), number[ask], a["last"][k] - a["first"][k] + 1
            gram = a["gram"][k]
            if hot and len(k):  # one entry for each window, under the window's own hash
                own = np.repeat(np.arange(len(k)), window)
                j = np.arange(len(own)) - np.repeat(np.cumsum(window) - window, window)
                begin = a["first"][k][own] + j
                gram = range_hash(prefix_sums(data), begin, begin + SPAN)
                doc, num, window = doc[own], num[own], j
            order, slices = _split((gram % np.uint64(parts)).astype(np.int64))
            for p, x in slices:
                i = order[x]
                text = b"" if hot else pa.compress(b"".join(data[a["first"][y]:a["last"][y] + SPAN].tobytes() for y in k[i]), TEXT, asbytes=True)
                rows.append((p, hot, gram[i].tobytes(), *_names(doc[i]), _narrow(num[i]), window[i].astype(np.uint8).tobytes(), text))
        return pa.Table.from_batches([_batch(rows, schema)], schema)

    return apply


def _all_anchors(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """``anchors`` of a group, step by step."""
    found = []
    for lo, hi in steps(np.diff(off), STEP):
        a = step_anchors(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        found.append(a | {"first": a["first"] + off[lo], "last": a["last"] + off[lo], "row": a["row"] + lo})
    return {k: np.concatenate([f[k] for f in found]) for k in found[0]} if found else anchors(data, off)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of all suffixes of ``s``, in the order of their first SPAN bytes at least (then in some fixed order).

    ``s`` ends with SPAN + 8 zero bytes, whose suffixes are left out.
    """
    n = len(s) - SPAN - 8
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(s, 8)).view(">u8").ravel().astype(np.uint64)
    # smaller than its successor: the next different character is larger
    change = np.flatnonzero(s[1:n + 1] != s[:n])
    nxt = np.full(n, -1)
    nxt[change] = change
    nxt = np.minimum.accumulate(np.where(nxt < 0, n, nxt)[::-1])[::-1]
    small = np.where(nxt < n, s[np.minimum(nxt + 1, n)] > s[np.minimum(nxt, n - 1)], True)
    # stage one: sort those directly, eight bytes at a time, going on only with ties
    order = np.flatnonzero(small)
    order = order[np.argsort(word[order], kind="stable")]
    tied = np.zeros(len(order), np.int64)
    tied[1:] = np.cumsum(word[order][1:] != word[order][:-1])
    for depth in range(8, SPAN, 8):
        again = np.flatnonzero(np.r_[tied[1:] == tied[:-1], False] | np.r_[False, tied[1:] == tied[:-1]]) if len(order) > 1 else order[:0]
        if not len(again):
            break
        key = word[order[again] + depth]
        sub = np.lexsort((key, tied[again]))
        order[again] = order[again[sub]]
        key, group = key[sub], tied[again][sub]
        fresh = np.r_[False, (key[1:] != key[:-1]) & (group[1:] == group[:-1])]
        # a new number for every part a tie breaks into; numbers stay in order as they only need to differ from neighbours
        inc = np.zeros(len(order), np.int64)
        inc[again] = fresh
        tied = tied + np.cumsum(inc)
    # stage two: in every character's bucket the larger suffixes come first, in the order of their successors
    count = np.bincount(s[:n], minlength=256)
    begin = np.cumsum(count) - count
    n_large = np.bincount(s[:n][~small], minlength=256)
    rank = np.full(n + 1, -1)
    first = s[order]
    own = np.arange(len(order)) - (np.cumsum(np.bincount(first, minlength=256)) - np.bincount(first, minlength=256))[first]
    rank[order] = begin[first] + n_large[first] + own
    large = np.flatnonzero(~small)
    head = large[s[large + 1] < s[large]]
    head = head[np.argsort(s[head], kind="stable")]
    bounds = np.searchsorted(s[head], np.arange(257))
    for c in np.flatnonzero(n_large).tolist():
        wave, at = head[bounds[c]:bounds[c + 1]], begin[c]
        while len(wave):
            wave = wave[np.argsort(rank[wave + 1], kind="stable")]
            rank[wave] = at + np.arange(len(wave))
            at += len(wave)
            wave = wave[wave > 0] - 1
            wave = wave[(s[wave] == c) & ~small[wave]]
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


def first_documents(texts: np.ndarray, valid: np.ndarray, order_of: np.ndarray) -> np.ndarray:
    """For each place with ``valid``: the least ``order_of`` among the valid places with the same SPAN bytes."""
    s = np.concatenate([texts, np.zeros(SPAN + 8, np.uint8)])
    sa = suffix_array(s)
    sa = sa[valid[sa]]
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(s, 8)).view(np.uint64).ravel()
    a, b = sa[:-1], sa[1:]
    same = np.ones(len(a), bool)  # common prefix of neighbours: SPAN bytes or less
    for depth in [*range(0, SPAN - 8, 8), SPAN - 8]:
        same &= word[a + depth] == word[b + depth]
    begin = np.flatnonzero(np.r_[True, ~same])
    least = np.minimum.reduceat(order_of[sa], begin) if len(sa) else sa
    out = np.full(len(texts), _LAST)
    out[sa] = np.repeat(least, np.diff(np.r_[begin, len(sa)]))
    return out


def _decide(homes: int):
    schema = _arrow(REPLIES)

    def masks(doc, number, window, gram, text):
        size = window.astype(np.int64) + SPAN - 1
        begin = np.cumsum(size) - size
        by = np.argsort(gram, kind="stable")
        found = np.zeros(len(gram), np.uint64)
        lo = 0
        while lo < len(by):  # whole grams together
            hi = lo + int(np.searchsorted(np.cumsum(size[by[lo:lo + SORT_BYTES // SPAN]]), SORT_BYTES, "right"))
            hi = max(hi, lo + 1)
            while hi < len(by) and gram[by[hi]] == gram[by[hi - 1]]:
                hi += 1
            k = by[lo:hi]
            own = np.repeat(np.arange(len(k)), size[k] + 1)  # one zero byte after each
            j = np.arange(len(own)) - np.repeat(np.cumsum(size[k] + 1) - size[k] - 1, size[k] + 1)
            joined = np.where(j < size[k][own], text[np.minimum(begin[k][own] + j, len(text) - 1)], np.uint8(0))
            valid = j < window[k][own]
            mine = doc[k, 1][own]
            covered = valid & (first_documents(joined, valid, mine) < mine)
            bits = np.where(covered, np.uint64(1) << np.minimum(j, 63).astype(np.uint64), np.uint64(0))
            found[k] = np.bitwise_or.reduceat(bits, np.cumsum(size[k] + 1) - size[k] - 1)
            lo = hi
        return found

    def apply(key, table):
        out = []
        for hot in (False, True):
            cols = table.filter(pc.equal(table.column("hot"), hot)).to_pydict()
            if not cols["part"]:
                continue
            gram = np.frombuffer(b"".join(cols["gram"]), np.uint64)
            count = [len(w) for w in cols["windows"]]
            doc = np.concatenate([_named(*x) for x in zip(cols["doc"], cols["orders"], cols["new"], count)])
            number = np.concatenate([_widened(*x) for x in zip(cols["ordinal"], count)])
            window = np.frombuffer(b"".join(cols["windows"]), np.uint8)
            if hot:
                order = np.argsort(gram, kind="stable")
                begin = np.flatnonzero(np.r_[True, gram[order][1:] != gram[order][:-1]])
                least = np.repeat(np.minimum.reduceat(doc[order, 1], begin), np.diff(np.r_[begin, len(order)]))
                mask = np.zeros(len(gram), np.uint64)
                mask[order] = np.where(doc[order, 1] > least, np.uint64(1) << window[order].astype(np.uint64), np.uint64(0))
            else:
                size = [sum(w) + len(w) * (SPAN - 1) for w in cols["windows"]]
                text = b"".join(pa.decompress(x, n, TEXT, asbytes=True) for x, n in zip(cols["text"], size))
                mask = masks(doc, number, window, gram, np.frombuffer(text, np.uint8))
            some = mask > 0
            out += _reply_rows(doc[some, 0], number[some] * 4, mask[some], homes)
        return pa.Table.from_batches([_batch(out, schema)], schema)

    return apply


# ---- step 3 ------------------------------------------------------------------------------------------------------

def covered_bytes(data: np.ndarray, off: np.ndarray, row: np.ndarray, number: np.ndarray, kind: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which bytes of a group of documents the replies cover."""
    a = _all_anchors(data, off)
    edge = np.zeros(len(data) + SPAN + 1, np.int32)
    k = _placed(a, len(off) - 1, row, number)
    full = k[kind == 1]
    np.add.at(edge, a["first"][full], 1)
    np.add.at(edge, a["last"][full] + SPAN, -1)
    some = np.flatnonzero(kind == 0)
    bits = np.unpackbits(mask[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    i, j = np.nonzero(bits)
    begin = a["first"][k[some]][i] + j
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + SPAN, -1)
    return np.cumsum(edge[: len(data)]) > 0


def _cut(with_text: bool):
    fields = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def apply(key, blocks, replies):
        docs = _unpacked(blocks)
        data, off, rids, one = _texts(docs)
        row, number, kind, mask = _said(replies, rids)
        gone = covered_bytes(data, off, row, number, kind, mask)
        at = {r: i for i, r in enumerate(rids.tolist())}
        out = {f: [] for f in [*fields, *["kept"] * with_text]}
        for r in docs.column("rid").to_pylist():
            lo, hi = off[at[r]], off[at[r] + 1]
            g = gone[lo:hi]
            kept = data[lo:hi][~g].tobytes()
            values = (hi - lo, int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest(), *[kept] * with_text)
            for f, v in zip(out, values):
                out[f].append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.table([docs.column("doc_id"), *[pa.array(v, t) for v, t in zip(out.values(), kinds)]], names=["doc_id", *out])

    return apply


def remove_repeats(docs: DataFrame, with_text: bool = False, part_bytes: int = PART_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with ``with_text`` also ``kept``, the bytes left."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST)))
    rows = docs.select("doc_id", row_key().alias("rid"), order.alias("ord"), text_of().cast("binary").alias("_t"))
    total = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    homes = int(min(MOST_PARTS, max(1, total // part_bytes)))
    parts = -(-homes // HOMES_PER_PART)
    homed = rows.withColumn("home", F.expr(f"cast(pmod(cast(rid as decimal(20)) + if(rid < 0, 18446744073709551616, 0), {homes}) as long)"))
    replies = stage(rows.select("rid", "ord", "_t").mapInArrow(_send_anchors(parts, homes), ENTRIES).groupBy("part").applyInArrow(_settle(homes, hot), REPLIES), "settled")
    texts = homed.mapInArrow(_pack, PACKED).groupBy("home")
    fetched = texts.cogroup(replies.where("home >= 0").groupBy("home")).applyInArrow(_fetch(parts), OPEN)
    decided = fetched.groupBy("part").applyInArrow(_decide(homes), REPLIES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return texts.cogroup(replies.unionByName(decided).groupBy("home")).applyInArrow(_cut(with_text), schema)
