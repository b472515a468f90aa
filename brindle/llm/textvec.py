"""Vectorised text primitives shared by the corpus operators.

A slab of texts becomes one array of code points; tokens are maximal runs of word characters
(letters, digits, underscore) or, on request, also runs of other visible characters. A token's
hash is a polynomial over its code points taken from one running sum for the whole slab, so the
cost per character is a few array operations and no Python object is made per token.
"""

from __future__ import annotations

import functools

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_PINV = pow(_P, -1, 1 << 64)
SLAB_CHARS = 1_500_000


@functools.lru_cache(1)
def char_class() -> np.ndarray:
    """0 space, control or separator; 1 word character; 2 any other visible character."""
    t = np.full(0x110000, 2, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum() or c == "_":
            t[i] = 1
        elif c.isspace() or i < 32:
            t[i] = 0
    return t


@functools.lru_cache(1)
def lower_table() -> np.ndarray:
    """The lower case of each code point whose lower case is one code point."""
    t = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i).lower()
        if len(c) == 1:
            t[i] = ord(c)
    return t


_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _pow.get("f")
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, base in (("f", _P), ("i", _PINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            with np.errstate(over="ignore"):
                _pow[k] = np.multiply.accumulate(a)
    return _pow["f"][:n], _pow["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slabs(texts, limit: int = SLAB_CHARS):
    """(from, to) ranges of ``texts`` with about ``limit`` characters each; a longer text is alone
    in its range, whole."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t)
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def clean(series) -> list[str]:
    """Texts as a list; null counts as empty."""
    return [t if isinstance(t, str) else "" for t in series]


class Tokens:
    """Tokens of a slab: ``hash``, ``start``, ``end`` (offsets in ``codes``), ``doc`` (index),
    ``first`` (index of each document's first token; one entry more than documents)."""

    __slots__ = ("codes", "doc", "end", "first", "hash", "kind", "start", "text_start")

    def __init__(self, texts: list[str], lower: bool = True, symbols: bool = False, fold: bool = False):
        """``lower`` lower-cases whole texts; ``fold`` does so by code point, which keeps offsets those of the text as given."""
        lower = lower and not fold
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        if lower:
            texts = [t.lower() for t in texts]
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        if fold:
            codes = lower_table()[codes]
        self.codes = codes
        self.text_start = np.concatenate(([0], np.cumsum(lens + 1)))[: len(texts) + 1]
        cls = char_class()[codes]
        if not symbols:
            cls = (cls == 1).astype(np.uint8)
        prev = np.empty_like(cls)
        prev[0] = 0
        prev[1:] = cls[:-1]
        edge = cls != prev
        at = np.flatnonzero(edge)
        kind = cls[at]
        ends = np.append(at[1:], len(cls))
        keep = kind > 0
        self.start, self.end, self.kind = at[keep], ends[keep], kind[keep]
        f, inv = _powers(len(codes) + 1)
        with np.errstate(over="ignore"):
            run = np.empty(len(codes) + 1, np.uint64)
            run[0] = 0
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * f[: len(codes)], out=run[1:])
            h = (run[self.end] - run[self.start]) * inv[self.start]
            self.hash = mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.first = np.searchsorted(self.start, self.text_start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def word_hash(word: str) -> int:
    """The hash that ``Tokens`` gives to a single token."""
    return int(Tokens([word], lower=False, symbols=True).hash[0])


def shingles(tok: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` tokens within each document, and the document of each; a document of
    fewer tokens gives one shingle of what it has, an empty one none."""
    h = tok.hash
    if not len(h):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    acc = np.zeros(len(h), np.uint64)
    left = np.repeat(tok.first[1:], tok.counts()) - np.arange(len(h))
    with np.errstate(over="ignore"):
        for j in range(n):
            part = np.zeros(len(h), np.uint64)
            part[: len(h) - j] = h[j:] if j else h
            acc = acc * np.uint64(_P) + np.where(left > j, part, np.uint64(0))
    full = left >= n
    lone = np.zeros(len(h), bool)
    short = (tok.counts() > 0) & (tok.counts() < n)
    lone[tok.first[:-1][short]] = True
    keep = full | lone
    return mix(acc[keep]), tok.doc[keep]
