"""Operator 8, quality rules on tokeniser fertility.

Two public vocabularies encode each whole text, one with byte fall-back and one of bytes for many languages; characters per token, the share
of byte tokens and the entropy of the token distribution are compared with bands fitted for each language (or script, where the language
is unknown) and length over all documents.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.base import TOKENIZERS, local_vocabulary, materialise, vocabulary_file
from brindle.llm.textvec import clean, slabs

MODEL, BYTE_LEVEL = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
VOCABULARIES = ("piece", "bytes")
#: how the byte-level vocabulary cuts a text before it merges
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_loaded: dict[str, tuple] = {}


def processor(path: str):
    """(processor, flags of the byte pieces), loaded once a worker."""
    if path not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        _loaded[path] = sp, np.fromiter((sp.is_byte(i) for i in range(sp.get_piece_size())), bool)
    return _loaded[path]


def split_words(text: str) -> list[str]:
    """Pieces of ``text`` that the vocabulary never merges across: each word with the spaces before it. Joined they are the
    text; pieces of the vocabulary have space marks at their beginning only, so encoding word by word is exact."""
    out, gap = [], ""
    for w in text.split(" "):
        if w:
            out.append(gap + w)
            gap = ""
        gap += " "
    if len(gap) > 1:
        out.append(gap[:-1])
    return out


def encode_slab(sp, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tokens of each text), each distinct word encoded once."""
    place: dict[str, int] = {}
    seq, sizes = [], []
    for t in texts:
        words = split_words(t)
        # the vocabulary puts one space mark before the text; the other words have their own
        words = [w[1:] if i and w[0] == " " else w for i, w in enumerate(words)]
        sizes.append(len(words))
        seq += [place.setdefault(w, len(place)) for w in words]
    if not seq:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    coded = sp.encode(list(place), num_threads=1)
    if "" in place:  # one space at the end of a text
        coded[place[""]] = [sp.piece_to_id("\u2581")]
    n = np.fromiter(map(len, coded), np.int64, len(coded))
    flat = np.fromiter((i for c in coded for i in c), np.int32, int(n.sum()))
    begin = np.cumsum(n) - n
    seq = np.array(seq)
    m = n[seq]
    ids = flat[np.repeat(begin[seq] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
    edge = np.concatenate(([0], np.cumsum(m)))[np.concatenate(([0], np.cumsum(sizes)))]
    return ids, np.diff(edge)


def script(text: str) -> str:
    """The script of most of the letters, by the first word of their Unicode names; ``none`` without letters."""
    seen: dict[str, int] = {}
    for c in set(text):
        if c.isalpha():
            k = unicodedata.name(c, "NONE").split(" ")[0].lower()
            seen[k] = seen.get(k, 0) + text.count(c)
    return max(sorted(seen), key=seen.get) if seen else "none"


class ByteLevel:
    """A byte-level vocabulary: its tokens that aren't whole characters are its fall-back to bytes."""

    def __init__(self, path: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.core = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.broken = np.zeros(max(ranks.values()) + 1, bool)
        for token, i in ranks.items():
            self.broken[i] = not _whole(token)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.core.encode_to_numpy(t, disallowed_special=()) if t else np.empty(0, np.uint32) for t in texts]
        return np.concatenate(ids).astype(np.int64), np.fromiter(map(len, ids), np.int64, len(ids))


def _whole(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def byte_level(path: str) -> ByteLevel:
    if path not in _loaded:
        _loaded[path] = ByteLevel(path)
    return _loaded[path]


def _of_documents(ids: np.ndarray, size: np.ndarray, is_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte tokens, entropy of the tokens in bits) of each text."""
    doc = np.repeat(np.arange(len(size)), size)
    key = np.sort((doc << 20) + ids)
    if not len(key):
        return np.zeros(len(size)), np.zeros(len(size))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    c = np.diff(np.append(at, len(key)))
    d = key[at] >> 20
    return np.bincount(doc, is_byte[ids], minlength=len(size)), np.bincount(d, -c * np.log2(c / size[d]), minlength=len(size)) / np.maximum(size, 1)


def measures(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, band, n_chars, and for each vocabulary v of ``piece`` and ``bytes``: v_tokens, v_chars_per_token, v_byte_share, v_entropy) of every row.
    band is the language, or ``script:`` and the script where lang is null. An empty text has no tokens, and null measures."""
    folder = folder or TOKENIZERS
    piece, multi = (vocabulary_file(docs.sparkSession, f"{folder}/{x}") for x in (MODEL, BYTE_LEVEL))
    names = [f"{v}_{x}" for v in VOCABULARIES for x in ("tokens", "chars_per_token", "byte_share", "entropy")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp, is_byte = processor(local_vocabulary(piece))
        level = byte_level(local_vocabulary(multi))
        for p in parts:
            texts = clean(p["text"])
            chars = np.fromiter(map(len, texts), np.int64, len(texts))
            cols = {c: np.zeros(len(texts)) for c in names}
            for a, b in slabs(texts):
                for v, (ids, size), flag in zip(VOCABULARIES, (encode_slab(sp, texts[a:b]), level.encode(texts[a:b])), (is_byte, level.broken)):
                    by, ent = _of_documents(ids, size, flag)
                    for c, x in zip(("tokens", "chars_per_token", "byte_share", "entropy"), (size, chars[a:b] / np.maximum(size, 1), by / np.maximum(size, 1), ent)):
                        cols[f"{v}_{c}"][a:b] = x if c == "tokens" else np.where(size > 0, x, np.nan)
            for v in VOCABULARIES:
                cols[f"{v}_tokens"] = cols[f"{v}_tokens"].astype(np.int64)
            band = [x if isinstance(x, str) else f"script:{script(t)}" for x, t in zip(p["lang"], texts)]
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "band": band, "n_chars": chars, **cols})

    schema = ", ".join(f"{c} {'long' if c.endswith('_tokens') else 'double'}" for c in names)
    return docs.select("doc_id", "text", "lang").mapInPandas(run, f"doc_id long, band string, n_chars long, {schema}")


#: rule -> floor of its deviation: a constant, and a part that shrinks with the number of tokens as the measure's own error does
RULES = {"chars_per_token": (0.05, 2.0), "byte_share": (0.01, 1.0), "evenness": (0.01, 0.5)}
BROADCAST_CELLS = 20_000


def _smoothed(cells: DataFrame, names: list[str]) -> DataFrame:
    """Each cell's figures averaged with those of the cells of the same band at other lengths, by their documents, half as much for each
    three steps of length between them. A cell of few documents follows its neighbours."""
    near = cells.select(F.col("band").alias("_b"), F.col("step").alias("_s"), F.col("n").alias("_n"), *[F.col(c).alias(f"_{c}") for c in names])
    w = F.col("_n") * F.pow(F.lit(2.0), -F.abs(F.col("step") - F.col("_s")) / 3)
    return cells.select("band", "step").join(near, F.col("band") == F.col("_b")).groupBy("band", "step").agg(*[(F.sum(w * F.col(f"_{c}")) / F.sum(w)).alias(c) for c in names])


def _medians(rows: DataFrame, values: dict) -> DataFrame:
    """(band, step, n, median of each value) by counting in bins of a hundredth or a thousandth: the counts add up on the way, whatever the size of a cell,
    and don't depend on how the rows are spread."""
    width = {c: 0.01 if c.endswith("chars_per_token") else 0.001 for c in values}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.floor(x / width[c]).alias("bin")) for c, x in values.items()])).alias("x")
    counts = rows.select("band", "step", each).groupBy("band", "step", "x.name", "x.bin").count()
    cell = Window.partitionBy("band", "step", "name")
    up = counts.withColumn("upto", F.sum("count").over(cell.orderBy("bin"))).withColumn("n", F.sum("count").over(cell))
    mid = up.where("2 * upto >= n").groupBy("band", "step", "name").agg(F.min("bin").alias("bin"), F.max("n").alias("n"))
    return mid.groupBy("band", "step").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == c, (F.col("bin") + 0.5) * width[c])).alias(c) for c in values])


def judged(rows: DataFrame, spread: float = 5.0) -> DataFrame:
    """Add the reasons and the verdict.

    evenness is the entropy over log2(1 + tokens). A rule's band is median +- ``spread`` times the scaled median deviation of the documents of one
    language (or script) and about one length, over all documents; lengths are told apart in quarters of an octave of tokens. Both ends reject, but
    for a low byte share. Every text is judged, by a band as wide as its length makes it; an empty one is rejected as such."""
    rows = rows.withColumn("step", F.floor(4 * F.log2(F.col("piece_tokens") + F.lit(1.0))).cast("int"))
    for v in VOCABULARIES:
        rows = rows.withColumn(f"{v}_evenness", F.col(f"{v}_entropy") / F.log2(F.col(f"{v}_tokens") + F.lit(1.0)))
    names = [f"{v}_{c}" for v in VOCABULARIES for c in RULES]
    some = rows.where("piece_tokens > 0")
    mid = materialise(_smoothed(_medians(some, {c: F.col(c) for c in names}), names), "fertility-mid")
    small = mid.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS  # cells of languages and lengths: few, unless the labels are dirty

    def beside(left: DataFrame, cells: DataFrame, prefix: str) -> DataFrame:
        right = cells.select(F.col("band").alias("_band"), F.col("step").alias("_step"), *[F.col(c).alias(f"{prefix}_{c}") for c in names])
        return left.join(F.broadcast(right) if small else right, (F.col("band") == F.col("_band")) & (F.col("step") == F.col("_step")), "left").drop("_band", "_step")

    away = {c: F.abs(F.col(c) - F.col(f"mid_{c}")) for c in names}
    off = materialise(_smoothed(_medians(beside(some, mid, "mid"), away), names), "fertility-off")
    out = beside(beside(rows, mid, "mid"), off, "off")

    def outside(v: str, c: str):
        fixed, falling = RULES[c]
        limit = F.lit(spread * 1.4826) * (F.col(f"off_{v}_{c}") + F.lit(fixed) + F.lit(falling) / F.greatest(F.col(f"{v}_tokens"), F.lit(1)))
        gap = F.col(f"{v}_{c}") - F.col(f"mid_{v}_{c}")
        return (gap if c == "byte_share" else F.abs(gap)) > limit

    reasons = F.array_compact(F.array(F.when(F.col("n_chars") == 0, F.lit("empty")), *[F.when(outside(v, c), F.lit(f"{v}_{c}")) for v in VOCABULARIES for c in RULES]))
    shown = [c if c.endswith("_tokens") else F.round(c, 6).alias(c) for v in VOCABULARIES for c in (f"{v}_tokens", f"{v}_chars_per_token", f"{v}_byte_share", f"{v}_entropy")]
    return out.withColumn("reasons", reasons).select("doc_id", "band", "n_chars", *shown, "reasons", (F.size("reasons") == 0).alias("keep"))


def judge(docs: DataFrame, folder: str | None = None, **params) -> DataFrame:
    """One row a document with its measures under two public vocabularies, the ``reasons`` for rejection and ``keep``.

    A null text counts as empty: no tokens, null measures, rejected as empty. Rows with one id are judged each; an empty table gives no rows."""
    return judged(materialise(measures(docs, folder), "fertility"), **params)
