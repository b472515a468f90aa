"""Operator 3, SentencePiece encoding with seeded merge-dropout, and decoding.

A word (the space marks before it included) starts as its characters; of the candidate merges, pairs of neighbours whose
concatenation is a piece, the one of best score, the leftmost of equals, is taken up next. A keyed hash of (seed, document, place of
the word in it, bounds of the pair) decides whether it is merged or skipped for good, so each occurrence of a word draws for itself and
the result doesn't depend on the order of work.
Characters that aren't pieces end as their bytes, so decoding gives the text back, whatever was skipped.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from brindle.llm.base import TOKENIZERS, local_vocabulary, row_keys, vocabulary_file
from brindle.llm.textvec import clean, mix, slabs

MODEL, DROPOUT, SEED = "piece_bpe_32k.model", 0.1, 17
LONG = 48  # characters; a longer word is merged by itself with a heap, to the same result
TOGETHER = 200_000  # words that go forward together
_UNIT = re.compile(" +[^ ]*")
_NONE = np.int32(2**31 - 1)
_LATIN = 592  # code points whose pairs have a dense table
_loaded: dict[str, Codec] = {}


class Codec:
    """The vocabulary as arrays: merges as sorted pair keys, characters by code point, bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        place = {pieces[i]: i for i in normal}
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.bytes = [bytes([int(pieces[i][3:5], 16)]) if sp.is_byte(i) else pieces[i].replace("▁", " ").encode() if i in set() or not (sp.is_control(i) or sp.is_unknown(i)) else b"" for i in range(n)]
        self.size = np.fromiter(map(len, self.bytes), np.int64, n)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.n = n
        symbols = dict(place)
        for i in normal:  # characters that only occur inside pieces are symbols too
            for c in pieces[i]:
                symbols.setdefault(c, len(symbols) + n)
        self.char = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        self.char[32], self.char[0x2581] = self.char[0x2581], -1  # a mark in a text isn't a space
        # better score, then lower id: the rank of a merge
        rank = {i: r for r, i in enumerate(sorted(normal, key=lambda i: (-sp.get_score(i), i)))}
        found = {}
        for i in normal:
            s = pieces[i]
            for k in range(1, len(s)):
                a, b = symbols.get(s[:k]), symbols.get(s[k:])
                if a is not None and b is not None:
                    found[(a << 20) | b] = (rank[i], i)
        keys = sorted(found)
        self.pair = np.array(keys, np.int64)
        self.rank = np.array([found[k][0] for k in keys], np.int32)
        self.into = np.array([found[k][1] for k in keys], np.int32)
        self.found = found
        latin = np.arange(_LATIN)
        a, b = np.repeat(self.char[latin], _LATIN), np.tile(self.char[latin], _LATIN)
        self.dense_rank, self.dense_into = self.lookup(a, b)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; rank -1 where it isn't a piece."""
        key = (a.astype(np.int64) << 20) | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        ok = (self.pair[at] == key) & (a >= 0) & (b >= 0)
        return np.where(ok, self.rank[at], np.int32(-1)), self.into[at]

    def lookup_characters(self, a: np.ndarray, b: np.ndarray, sym_a: np.ndarray, sym_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pairs of characters, given their code points too."""
        at = np.minimum(a, _LATIN - 1) * np.int64(_LATIN) + np.minimum(b, _LATIN - 1)
        rank, into = self.dense_rank[at], self.dense_into[at]
        far = np.flatnonzero((a >= _LATIN) | (b >= _LATIN))
        rank[far], into[far] = self.lookup(sym_a[far], sym_b[far])
        return rank, into

    def symbols_to_ids(self, sym: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each symbol): symbols outside the vocabulary, which are single characters, as their bytes."""
        size = np.ones(len(sym), np.int64)
        odd = np.flatnonzero((sym < 0) | (sym >= self.n))
        if not len(odd):
            return sym, size
        coded = [chr(x).encode("utf-8", "surrogatepass") for x in code[odd].tolist()]
        size[odd] = [len(x) for x in coded]
        out = np.repeat(sym, size)
        out[np.repeat(np.isin(np.arange(len(sym)), odd), size)] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        return out, size

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each text from the ids of all."""
        m = self.size[ids]
        total = int(m.sum())
        flat = self.flat[np.repeat(self.begin[ids] - (np.cumsum(m) - m), m) + np.arange(total)].tobytes()
        edge = np.concatenate(([0], np.cumsum(m)))[np.concatenate(([0], np.cumsum(sizes)))]
        return [flat[a + 1 : b] for a, b in zip(edge[:-1], edge[1:])]  # without the mark put before the text


def codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def _skips(key: np.ndarray, a: np.ndarray, mid: np.ndarray, b: np.ndarray, drop: float) -> np.ndarray:
    """Whether the pair (a, mid, b) of the word with ``key`` is skipped."""
    where = (a.astype(np.uint64) << np.uint64(42)) | (mid.astype(np.uint64) << np.uint64(21)) | b.astype(np.uint64)
    with np.errstate(over="ignore"):
        return (mix(key ^ mix(where + np.uint64(1))) >> np.uint64(11)).astype(np.float64) < drop * float(1 << 53)


def encode_long(c: Codec, word: str, key: int, drop: float) -> np.ndarray:
    """One word by an agenda: a heap of candidate merges and linked neighbours."""
    code = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = c.char[code].tolist()
    n = len(sym)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list = []
    one = np.array([key], np.uint64)

    def offer(i: int) -> None:
        j = nxt[i]
        if j < 0 or sym[i] < 0 or sym[j] < 0:
            return
        f = c.found.get((sym[i] << 20) | sym[j])
        if f is not None:
            heapq.heappush(heap, (f[0], i, j, end[j], f[1]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, j, e, into = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or nxt[i] != j or end[j] != e or end[i] != j:
            continue
        if drop and _skips(one, np.array([i]), np.array([j]), np.array([e]), drop)[0]:
            continue
        sym[i], end[i], alive[j] = into, e, False
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    at = np.array([i for i in range(n) if alive[i]], np.int64)
    return c.symbols_to_ids(np.array(sym, np.int32)[at], code[at])[0]


def encode_words(c: Codec, words: list[str], keys: np.ndarray, drop: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each word). All words of up to ``LONG`` characters go forward together, a merge each a round."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    long = np.flatnonzero(size > LONG)
    ends = [encode_long(c, words[i], int(keys[i]), drop) for i in long]
    ids = [x for x in ends if len(x)]
    owner = [np.repeat(long, [len(x) for x in ends])] if ids else []
    unit = np.flatnonzero(size <= LONG)
    if len(unit):
        sym, code, word = _together(c, words, unit, size[unit], keys, drop)
        got, n = c.symbols_to_ids(sym, code)
        ids.append(got)
        owner.append(np.repeat(word, n))
    if not ids:
        return np.empty(0, np.int32), np.zeros(len(words), np.int64)
    word = np.concatenate(owner)
    return np.concatenate(ids)[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


def _together(c: Codec, words: list[str], unit: np.ndarray, n: np.ndarray, keys: np.ndarray, drop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, code point it begins with, word) of the words ``unit``, each word's symbols in order."""
    code = np.frombuffer("".join([words[i] for i in unit]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = c.char[code]
    out = []
    word = np.repeat(unit.astype(np.int32), n)
    start = (np.arange(len(sym)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    end = start + np.int32(1)

    def offers(i: np.ndarray, characters: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(place in the agenda, merged symbol) of the pairs (i, i+1); they are of one word."""
        rank, into = c.lookup_characters(code[i], code[i + 1], sym[i], sym[i + 1]) if characters else c.lookup(sym[i], sym[i + 1])
        ok = rank >= 0
        if drop:
            at = np.flatnonzero(ok)
            j = i[at]
            ok[at] = ~_skips(keys[word[j]], start[j], start[j + 1], end[j + 1], drop)
        return np.where(ok, (rank << np.int32(8)) | start[i], _NONE), into

    agenda, into = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
    i = np.flatnonzero(word[:-1] == word[1:])
    agenda[i], into[i] = offers(i, True)
    while True:
        begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        best = np.minimum.reduceat(agenda, begin)
        count = np.diff(np.append(begin, len(word)))
        done = best == _NONE
        if done.mean() > 0.3:
            gone = np.repeat(done, count)
            out.append((sym[gone], code[gone], word[gone]))
            if done.all():
                return tuple(np.concatenate(x) for x in zip(*out))
            stay = ~gone
            sym, code, word, start, end, agenda, into = (x[stay] for x in (sym, code, word, start, end, agenda, into))
            count, best = count[~done], best[~done]
        at = np.flatnonzero((agenda == np.repeat(best, count)) & (agenda != _NONE))
        sym[at], end[at] = into[at], end[at + 1]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        at -= np.arange(len(at))  # where they are after the removal
        sym, code, word, start, end, agenda, into = (x[stay] for x in (sym, code, word, start, end, agenda, into))
        for here in (at, at[at > 0] - 1):
            near = np.minimum(here + 1, len(sym) - 1)
            pair = (near > here) & (word[here] == word[near])
            agenda[here[~pair]] = _NONE
            i = here[pair]
            agenda[i], into[i] = offers(i)


def encode(c: Codec, texts: list[str], rows: np.ndarray, drop: float = DROPOUT) -> tuple[np.ndarray, np.ndarray]:
    """(token ids, tokens of each text); ``rows`` has a 64-bit key of each text, from which its words' keys are made."""
    units, sizes = [], []
    for t in texts:
        u = _UNIT.findall(" " + t) if t else []
        sizes.append(len(u))
        units += u
    if not units:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    sizes = np.array(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    if drop:
        place = np.arange(len(units)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        with np.errstate(over="ignore"):
            keys = mix(rows[doc] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        parts = [encode_words(c, units[i : i + TOGETHER], keys[i : i + TOGETHER], drop) for i in range(0, len(units), TOGETHER)]
        out, m = (np.concatenate(x) for x in zip(*parts))
    else:  # every occurrence of a word is segmented alike
        back, words = pd.factorize(np.array(units, object))
        flat, n = encode_words(c, words.tolist(), np.zeros(len(words), np.uint64), 0.0)
        m = n[back]
        out = flat[np.repeat((np.cumsum(n) - n)[back] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
    return out, np.bincount(doc, m, minlength=len(texts)).astype(np.int64)


def encode_documents(docs: DataFrame, model_path: str | None = None, drop: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids, lossless (decoding the ids gave the text).

    A null or empty text has no ids and is lossless. Draws are keyed by the id, or by the text where there is none, so rows with one id and
    text are encoded alike. An empty table gives no rows."""
    name = vocabulary_file(docs.sparkSession, model_path or f"{TOKENIZERS}/{MODEL}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(local_vocabulary(name))
        for p in parts:
            texts, number = clean(p["text"]), p["doc_id"].astype("Int64")
            for a, b in slabs(texts, 4_000_000):
                ids, size = encode(c, texts[a:b], row_keys(number.iloc[a:b].reset_index(drop=True), texts[a:b], seed), drop)
                back = c.decode(ids, size)
                edge = np.cumsum(size)
                yield pd.DataFrame({"doc_id": number.iloc[a:b].to_numpy(object, na_value=None), "n_tokens": size, "ids": np.split(ids, edge[:-1]), "lossless": [x == t.encode("utf-8", "surrogatepass") for x, t in zip(back, texts[a:b])]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids array<int>, lossless boolean")


def decode_documents(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows of doc_id and ids; null ids count as none."""
    name = vocabulary_file(encoded.sparkSession, model_path or f"{TOKENIZERS}/{MODEL}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(local_vocabulary(name))
        for p in parts:
            ids = [np.asarray(x, np.int32) if x is not None else np.empty(0, np.int32) for x in p["ids"]]
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "text": [x.decode("utf-8", "surrogatepass") for x in c.decode(flat, np.array([len(x) for x in ids], np.int64))]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
