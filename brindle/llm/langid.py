"""Operator 7, language identification of documents that mix languages.

Each language has a model of hashed character trigrams, and a flat component ``und`` stands for text like
none of them. A word's likelihood under a language is the product over its trigrams. For each
document, expectation-maximisation over its words estimates the proportions of the components; nested
sets of the strongest components are refitted and the set of largest penalised likelihood is kept, however small its
shares (``least`` refuses sets with a smaller share; 0 by default).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.base import hash_fraction, temp_name
from brindle.llm.textvec import Tokens, clean, mix, slabs

BITS = 15
UND = "und"
LANGUAGES = 200


def trigrams(tok: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, token) of the character trigrams of every word with a space at either end."""
    n = tok.end - tok.start  # a word of n letters has n trigrams
    if not len(n):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.repeat(np.arange(len(n)), n)
    pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(tok.start, n)
    c = tok.codes.astype(np.uint64)
    left = np.where(pos > tok.start[at], c[np.maximum(pos - 1, 0)], np.uint64(32))
    right = np.where(pos + 1 < tok.end[at], c[np.minimum(pos + 1, len(c) - 1)], np.uint64(32))
    with np.errstate(over="ignore"):
        g = mix((left << np.uint64(42)) | (c[pos] << np.uint64(21)) | right)
    return (g >> np.uint64(64 - BITS)).astype(np.int64), at


@dataclass
class Model:
    languages: list[str]  # the last is UND
    logp: np.ndarray  # languages x buckets

    def mixture(self, texts: list[str], penalty: float, least: float = 0.0, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(proportions, words, against): a row of proportions for each text, 0 for languages outside the chosen set; how much the penalised log
        likelihood of the chosen set exceeds that of each language alone."""
        k = len(self.languages)
        out, words, against = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64), np.zeros((len(texts), k))
        for a, b in slabs(texts):
            tok = Tokens(texts[a:b])
            words[a:b] = tok.counts()
            if len(tok.hash):
                out[a:b], against[a:b] = self._slab(tok, penalty, least, rounds)
        return out, words, against

    def _slab(self, tok: Tokens, penalty: float, least: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        k, t = len(self.languages), len(tok.hash)
        g, _ = trigrams(tok)
        begin = np.cumsum(tok.end - tok.start) - (tok.end - tok.start)
        like = np.empty((k, t), np.float64)
        for i in range(k):
            like[i] = np.add.reduceat(self.logp[i][g], begin)
        like -= like.max(0)
        have = np.flatnonzero(tok.counts())
        n = tok.counts()[have]
        alone = np.add.reduceat(like, tok.first[:-1][have], axis=1)
        like = np.exp(like)
        first, row = tok.first[:-1][have], np.repeat(np.arange(len(have)), n)

        def em(share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(steps):
                r = like * share[:, row]
                r /= np.maximum(r.sum(0), 1e-300)
                share = np.add.reduceat(r, first, axis=1) / n
            total = np.log(np.maximum((like * share[:, row]).sum(0), 1e-300))
            return share, np.add.reduceat(total, first)

        full, _ = em(np.full((k, len(have)), 1.0 / k), rounds)
        order = np.argsort(-full, axis=0, kind="stable")
        best_score, best = np.full(len(have), -np.inf), np.zeros((k, len(have)))
        for m in range(1, k + 1):
            mask = np.zeros((k, len(have)))
            np.put_along_axis(mask, order[:m], 1.0, axis=0)
            share = full * mask
            share /= share.sum(0)
            share, fit = em(share, 0 if m == 1 else 3)
            score = fit - penalty * (m - 1) * np.log(n + 1.0)
            better = (score > best_score) & ((share > 0).sum(0) == m) & ((m == 1) | (np.where(share > 0, share, 1).min(0) >= least))
            best_score, best = np.where(better, score, best_score), np.where(better, share, best)
            if m > 1 and not (np.take_along_axis(full, order[m : m + 1], 0) >= least / 2).any():
                break
        res, against = np.zeros((len(tok.first) - 1, k)), np.zeros((len(tok.first) - 1, k))
        res[have], against[have] = best.T, (best_score - alone).T
        return res, against


def fit(docs: DataFrame, per_language: int = 1000, languages: int = LANGUAGES, seed: int = 11) -> Model:
    """Train on about ``per_language`` labelled documents of each of the ``languages`` most frequent labels (a hash sample of rows whose ``lang`` is
    not null, by id and text; the two bounds keep the fit equally large at any size of the input)."""
    counts = {r["lang"]: r["count"] for r in docs.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([UND], np.full((1, 1 << BITS), -BITS * np.log(2.0)))
    rate = F.create_map(*[x for c in langs for x in (F.lit(c), F.lit(min(1.0, per_language / counts[c])))])
    sample = docs.where(F.col("lang").isin(langs)).select("lang", "text").where(hash_fraction(F.xxhash64("doc_id", "text"), seed) < rate[F.col("lang")])
    place = {c: i for i, c in enumerate(langs)}

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(place) << BITS)
        for p in parts:
            texts, lang = clean(p["text"]), p["lang"].map(place).to_numpy(np.int64)
            for a, b in slabs(texts):
                tok = Tokens(texts[a:b])
                g, at = trigrams(tok)
                n += np.bincount((lang[a:b][tok.doc[at]] << BITS) + g, minlength=len(n))
        at = np.flatnonzero(n)
        yield pd.DataFrame({"slot": at, "n": n[at]})

    got = sample.mapInPandas(count, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n = np.full(len(langs) << BITS, 0.05)
    n[got["slot"]] += got["n"]
    n = n.reshape(len(langs), -1)
    logp = np.log(n / n.sum(1, keepdims=True))
    und = np.full((1, 1 << BITS), -9.5)  # a flat component that beats a language only on words it finds improbable
    return Model([*langs, UND], np.concatenate([logp, und]))


def detect(docs: DataFrame, model: Model | None = None, penalty: float = 3.0, least: float = 0.0) -> DataFrame:
    """One row a document: doc_id, languages and shares (by falling share, equal ones by name), language (the first), n_words, keep.

    A text without words, null included, has no languages, language null and keep false. With a label (``lang``) that the model knows, keep says
    whether the text has a share of that language, or that language alone explains it nearly as well as the chosen set: the loss is
    no more than the penalty for one more language, so a few words are rejected only if they speak against the label. Without such a label keep
    says whether the main language is other than ``und``. Rows with one id are judged each; an empty table gives no rows."""
    model = model or fit(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        names = np.array(m.languages, object)
        for p in parts:
            share, words, against = m.mixture(clean(p["text"]), penalty, least)
            order = np.argsort(-share, axis=1, kind="stable")
            size = (share > 0).sum(1)
            yield pd.DataFrame({
                "doc_id": p["doc_id"].astype("Int64"), "languages": [list(names[o[:s]]) for o, s in zip(order, size)], "shares": [np.round(x[o[:s]], 4).tolist() for x, o, s in zip(share, order, size)],
                "language": [names[o[0]] if s else None for o, s in zip(order, size)], "n_words": words, "keep": accepted(m, p["lang"], share, words, against, penalty),
            })

    return docs.select("doc_id", "text", "lang").mapInPandas(run, "doc_id long, languages array<string>, shares array<double>, language string, n_words long, keep boolean")


def accepted(m: Model, labels, share: np.ndarray, words: np.ndarray, against: np.ndarray, penalty: float) -> np.ndarray:
    """Whether each text is kept, given its label."""
    place = {c: i for i, c in enumerate(m.languages[:-1])}
    label = np.array([place.get(x, -1) if isinstance(x, str) else -1 for x in labels], np.int64)
    row = np.arange(len(label))
    told = (share[row, label] > 0) | (against[row, label] <= penalty * np.log(words + 1.0))
    return np.where(label >= 0, told, share.argmax(1) != len(m.languages) - 1) & (words > 0)


def keep_identified(docs: DataFrame, penalty: float = 3.0, least: float = 0.0) -> DataFrame:
    """Pipeline form: the documents that ``detect`` keeps, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @F.pandas_udf("boolean")
    def kept(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = held.value
        for text, lang in parts:
            yield pd.Series(accepted(m, lang, *m.mixture(clean(text), penalty, least), penalty))

    mark = temp_name(docs, "_kept")
    return docs.withColumn(mark, kept("text", "lang")).where(F.col(mark)).drop(mark)
