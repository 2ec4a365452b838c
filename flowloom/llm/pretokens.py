"""Tokenising by look-up: texts are cut into pre-tokens with array operations, and each distinct pre-token is encoded once.

Two public cuts are known: ``byte_level`` (optional leading space, letters | digits | other; runs of white space) and
``lower_words`` (lower-cased letters | single digits | other; no white space). Both are applied to texts made of printable
ASCII, common white space and Latin-1 letters; a text with any other character, or with something like a special
token, goes to the tokenizer whole. So results are the tokenizer's in every case, and the cuts only save time.
"""

from __future__ import annotations

import os

import numpy as np

from .common import STEP_BYTES, prefix_sums, range_hash

CUTS = ("byte_level", "lower_words")
#: Distinct pre-tokens that a worker keeps; then it starts anew.
CACHE = 1_500_000

_SPACE, _LETTER, _DIGIT, _OTHER, _END, _BAD = range(6)
_KIND = np.full(257, _BAD, np.uint8)
_KIND[33:127] = _OTHER
_KIND[[9, 10, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[0xC0:0x100] = _LETTER
_KIND[[0xD7, 0xF7]] = _BAD
_KIND[0] = _END
_LOWER = np.arange(257, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[0xC0:0xDF] += 32
_LOWER[0xD7] = 0xD7


def _contractions(cp: np.ndarray, start: np.ndarray) -> None:
    """'s 't 'm 'd 're 've 'll at a pre-token's beginning are pre-tokens of their own; changes ``start``."""
    at = np.flatnonzero((cp[:-3] == 39) & start[:-3])
    a, b = cp[at + 1], cp[at + 2]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    for hit, n in ((at[one], 2), (at[two], 3)):
        start[hit + 1] = False
        start[hit + n] = True


def byte_level(cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens start; every text ends with a character of kind _END, and three more follow the last."""
    start = np.ones(len(cp), bool)
    space = kind == _SPACE
    change = kind[1:] != kind[:-1]
    start[1:] = change
    start[1:] &= ~((cp[:-1] == 32) & ~space[1:] & (kind[1:] != _END))  # the space before goes with it
    start[1:-1] |= space[1:-1] & space[:-2] & ~space[2:] & (kind[2:] != _END)  # the last space of several
    _contractions(cp, start)
    return start


def lower_words(cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
    start = np.ones(len(cp), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    _contractions(cp, start)
    return start


class Encoder:
    """Encodes texts with one tokenizer; keeps what it has learnt from batch to batch."""

    def __init__(self, model: str, cut: str, known: tuple[np.ndarray, np.ndarray] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.lower = cut == "lower_words"
        self.cut = lower_words if self.lower else byte_level
        self.frequent = known  # tier one: sorted hashes and lengths
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def pieces(self, texts: list[str]):
        """For texts that can be cut: their numbers, the joined text, pre-token hashes, starts, ends and owners."""
        joined = "\0".join(texts) + "\0" * 4
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if self.lower and len(cp) and cp.max() < 256:
            cp = _LOWER[cp]
        kind = _KIND[np.minimum(cp, 256)]
        ends = np.flatnonzero(kind == _END)
        bad = (kind == _BAD)
        bad[:-1] |= (cp[:-1] == 60) & (cp[1:] == 124)
        if len(ends) != len(texts) + 3 or bad.any():
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            owner = np.repeat(np.arange(len(texts)), lengths + 1)
            odd = np.unique(owner[np.flatnonzero(bad[: len(owner)])])
            nul = [i for i, t in enumerate(texts) if "\0" in t]
            good = np.setdiff1d(np.arange(len(texts)), np.union1d(odd, nul)).astype(np.int64)
            if len(good) == 0:
                return good, "", *([np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 3)
            _, *rest = self.pieces([texts[i] for i in good])
            return good, *rest
        at = np.flatnonzero(self.cut(cp, kind))
        end = np.append(at[1:], len(cp))
        keep = kind[at] != _END
        if self.lower:
            keep &= kind[at] != _SPACE
            joined = cp.tobytes().decode("utf-32-le")
        at, end = at[keep], end[keep]
        h = range_hash(prefix_sums(cp), at, end)
        return np.arange(len(texts)), joined, h, at, end, np.searchsorted(ends, at)

    def look_up(self, joined: str, h: np.ndarray, at: np.ndarray, end: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray]:
        """Per pre-token the number of tokens and the place of its ids in the pool."""
        distinct, example, back = np.unique(h, return_index=True, return_inverse=True)
        size, first = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        if self.frequent is not None and not ids and len(self.frequent[0]):
            keys, lengths = self.frequent
            x = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
            size = np.where(keys[x] == distinct, lengths[x], -1)
        if len(self.keys):
            x = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            hit = (self.keys[x] == distinct) & (size < 0)
            size[hit], first[hit] = self.size[x[hit]], self.first[x[hit]]
        new = np.flatnonzero(size < 0)
        if len(new):
            e = example[new]
            found = self.tokenizer.encode_batch_fast([joined[a:b] for a, b in zip(at[e].tolist(), end[e].tolist())], add_special_tokens=False)
            lists = [f.ids for f in found]
            size[new] = np.fromiter(map(len, lists), np.int64, len(lists))
            if ids:
                first[new] = len(self.pool) + np.cumsum(size[new]) - size[new]
                self.pool = np.concatenate([self.pool, np.array([i for x in lists for i in x], np.uint32)])
            place = np.searchsorted(self.keys, distinct[new])
            self.keys, self.size, self.first = (np.insert(a, place, b[new]) for a, b in ((self.keys, distinct), (self.size, size), (self.first, first)))
        return size[back], first[back]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for lo, hi in _steps(texts):
            part = texts[lo:hi]
            good, joined, h, at, end, owner = self.pieces(part)
            if len(h):
                size, _ = self.look_up(joined, h, at, end, ids=False)
                out[lo + good] = np.bincount(owner, size, len(good)).astype(np.int64)
            for i in np.setdiff1d(np.arange(len(part)), good):
                out[lo + i] = len(self.tokenizer.encode(part[i], add_special_tokens=False).ids)
            self._bound()
        return out

    def encode(self, texts: list[str]):
        """Ids of each text, in order."""
        for lo, hi in _steps(texts):
            part = texts[lo:hi]
            good, joined, h, at, end, owner = self.pieces(part)
            size, first = self.look_up(joined, h, at, end, ids=True) if len(h) else (np.zeros(0, np.int64),) * 2
            total = np.cumsum(size)
            flat = self.pool[np.repeat(first - (total - size), size) + np.arange(total[-1])] if len(size) else self.pool[:0]
            bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, size, len(good)).astype(np.int64))])
            where = {g: k for k, g in enumerate(good.tolist())}
            for i in range(len(part)):
                if i in where:
                    yield flat[bounds[where[i]]:bounds[where[i] + 1]]
                else:
                    yield np.array(self.tokenizer.encode(part[i], add_special_tokens=False).ids, np.uint32)
            self._bound()

    def _bound(self) -> None:
        if len(self.keys) > CACHE:
            self.clear()


def _steps(texts: list[str]):
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if i > lo and n + len(t) > STEP_BYTES:
            yield lo, i
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield lo, len(texts)


_ENCODERS: dict[tuple, Encoder] = {}


def worker_encoder(key: str, model: str, cut: str, known=None) -> Encoder:
    """The worker's encoder for this model, kept from task to task; ``key`` names the model and the table given with it."""
    if (key, cut) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key, cut] = Encoder(model, cut, known)
    return _ENCODERS[key, cut]


def model_text(name: str) -> str:
    """A public tokenizer file, read on the driver (under 2 MB) and sent to the workers."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()
