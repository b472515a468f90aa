"""Operator 5, quality classifier by importance resampling.

Target and raw text each get a bag model over hashed word and symbol n-grams (orders 1 and 2). A
document's weight is the log ratio of its likelihoods under the two models. The n-grams of a text overlap and repeat, so n of them
count as ``length`` n / (``length`` + n) independent ones. Gumbel noise keyed by the document id (by the text where there is none) is
added, and the k largest sums are the sample: Gumbel top-k draws without replacement in proportion to the weights. The queries draw k = ``TARGET``: as
many documents as have a weight like the target's, a number that doesn't depend on the noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.base import discard, hash_fraction, materialise, row_keys, temp_name
from brindle.llm.textvec import Tokens, clean, mix, slabs

BITS = 14
TARGET = "target"
_REPEAT = np.uint64(0xA5A5_0F0F_1234_9876)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every unigram and bigram; a bigram of equal tokens is one feature of its
    own whatever the token."""
    tok = Tokens(texts, symbols=True)
    h, d = tok.hash, tok.doc
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    same = d[1:] == d[:-1]
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    pair[h[:-1] == h[1:]] = mix(_REPEAT)
    f = np.concatenate([h, pair[same]]) >> np.uint64(64 - BITS)
    return f.astype(np.int64), np.concatenate([d, d[1:][same]])


@dataclass
class Model:
    log_ratio: np.ndarray
    length: float
    temperature: float
    seed: int
    folds: tuple = ()  # log ratios for documents of half 1 and half 2, each from the other half's labels

    def score(self, texts: list[str], ids: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, weight, weight / temperature + Gumbel noise) of each document."""
        n, w = np.zeros(len(texts)), np.zeros(len(texts))
        for a, b in slabs(texts):
            f, d = features(texts[a:b])
            n[a:b] = np.bincount(d, minlength=b - a)
            w[a:b] = np.bincount(d, self.log_ratio[f], minlength=b - a)
        w = w * self.length / (n + self.length)
        w[n == 0] = -np.inf
        u = (row_keys(ids, texts, self.seed) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        gumbel = -np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))
        return n.astype(np.int64), w, w / self.temperature + gumbel


def labelled_sample(labels: DataFrame, bound: int, seed: int) -> DataFrame:
    """At most ``bound`` labelled ids (doc_id, quality) in hash order; null ids or labels are left out, an id
    with labels that disagree counts as rejected."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    return one.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(bound)


def _ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the two smoothed distributions; 0 without any target."""
    if not target.any():
        return np.zeros(len(raw))
    target, raw = target + 1.0, raw + 1.0
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _half(col, seed: int):
    return F.when(hash_fraction(col, seed + 1) < 0.5, 1).otherwise(2)


def fit(docs: DataFrame, labels: DataFrame, label_bound: int = 20_000, length: float = 64.0, temperature: float = 1.0, seed: int = 7) -> tuple[Model, DataFrame]:
    """Count n-grams over all of ``docs`` (raw) and over the good rows of at most ``label_bound`` labelled ones (target), those in two halves for
    ``calibrated_cut``. Gives the model and that sample. The model has 3 x 2**14 numbers at any size of the input."""
    spark = docs.sparkSession
    sample = materialise(labelled_sample(labels, label_bound, seed), "quality-sample")
    small = F.broadcast(sample.where("quality = 1").select(F.col("doc_id").alias("_id"), _half(F.col("doc_id"), seed).alias("_q")))
    flagged = docs.select("doc_id", "text").join(small, F.col("doc_id") == F.col("_id"), "left").select("text", F.coalesce("_q", F.lit(0)).alias("_q"))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((3, 1 << BITS))
        for p in parts:
            texts, half = clean(p["text"]), p["_q"].to_numpy(np.int64)
            for a, b in slabs(texts):
                f, d = features(texts[a:b])
                n += np.bincount((half[a:b][d] << BITS) + f, minlength=3 << BITS).reshape(3, -1)
        at = np.flatnonzero(n.any(0))
        yield pd.DataFrame({"bucket": at, "n0": n[0][at], "n1": n[1][at], "n2": n[2][at]})

    got = flagged.mapInPandas(count, "bucket long, n0 double, n1 double, n2 double").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "n2")]).toPandas()
    n = np.zeros((3, 1 << BITS))
    n[:, got["bucket"]] = got[["n0", "n1", "n2"]].to_numpy().T
    raw = n.sum(0)
    return Model(_ratio(n[1] + n[2], raw), length, temperature, seed, (_ratio(n[2], raw), _ratio(n[1], raw))), sample


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_features, log_weight, gumbel_key)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for p in parts:
            n, w, key = m.score(clean(p["text"]), p["doc_id"].astype("Int64"))
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "n_features": n, "log_weight": w, "gumbel_key": key})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_features long, log_weight double, gumbel_key double")


def calibrated_cut(docs: DataFrame, model: Model, sample: DataFrame, lost: float = 0.001, column: str = "gumbel_key") -> float:
    """The key (or what ``column`` names) below which at most the share ``lost`` of the labelled good documents lies, each scored by a model that hasn't
    seen it (of the other half's labels). Without labels: everything that isn't empty stays."""
    good = F.broadcast(sample.where("quality = 1").select(F.col("doc_id").alias("_id"), _half(F.col("doc_id"), model.seed).alias("_q")))
    mine = docs.select("doc_id", "text").join(good, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_q")
    keys = []
    for half in (1, 2):
        m = replace(model, log_ratio=model.folds[half - 1], folds=())
        keys.append(scored(mine.where(F.col("_q") == half), m).where("n_features > 0").select(column).toPandas()[column].to_numpy())
    keys = np.concatenate(keys)
    return float(np.quantile(keys, lost, method="lower")) if len(keys) else -1e300


def top_k(keys: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of largest gumbel_key, ties by smaller doc_id; exact, without a global sort: the k-th key is
    found by counting in ever narrower ranges."""
    keys = materialise(keys.where("n_features > 0"), "gumbel-keys")
    lo, hi = keys.agg(F.min("gumbel_key"), F.max("gumbel_key")).first()
    if lo is None or k <= 0:
        return keys.limit(0)
    above = 0
    for _ in range(6):
        if hi <= lo:
            break
        width = (hi - lo) / 1024
        bins = dict(keys.where(F.col("gumbel_key").between(lo, hi)).groupBy(F.least(F.floor((F.col("gumbel_key") - lo) / width), F.lit(1023)).cast("int").alias("b")).count().collect())
        for b in sorted(bins, reverse=True):
            if above + bins[b] >= k:
                break
            above += bins[b]
        else:
            return keys
        lo, hi = lo + b * width, min(hi, lo + (b + 1) * width)
        if bins[b] <= 10_000:
            break
    sure = keys.where(F.col("gumbel_key") > hi)
    near = keys.where(F.col("gumbel_key").between(lo, hi)).orderBy(F.desc("gumbel_key"), "doc_id")
    return sure.unionByName(near.limit(max(0, k - sure.count())))


def target_size(rows: DataFrame, docs: DataFrame, model: Model, sample: DataFrame) -> int:
    """The size of the draw by ``TARGET``: how many documents have a weight, without noise, that loses one in a thousand labelled good ones."""
    return rows.where((F.col("n_features") > 0) & (F.col("log_weight") >= calibrated_cut(docs, model, sample, column="log_weight"))).count()


def select(docs: DataFrame, labels: DataFrame, k: int | str | None = None, **params) -> DataFrame:
    """One row a document: doc_id, n_features, log_weight, gumbel_key, selected. With a number ``k`` the sample has
    exactly min(k, non-empty documents) rows; with ``TARGET`` k is ``target_size``. Without k nothing is drawn: a filter at ``calibrated_cut``. Empty texts
    weigh minus infinity and are never selected."""
    model, sample = fit(docs, labels, **params)
    rows = scored(docs, model)
    if k is None:
        return rows.withColumn("selected", F.col("gumbel_key") >= F.lit(calibrated_cut(docs, model, sample)))
    rows = materialise(rows, "quality-rows")
    k = target_size(rows, docs, model, sample) if k == TARGET else k
    order = Window.partitionBy("doc_id", "gumbel_key").orderBy("log_weight")
    chosen = top_k(rows, k).groupBy("doc_id", "gumbel_key").agg(F.count("*").alias("_n"))
    ranked = rows.withColumn("_r", F.row_number().over(order))
    return ranked.join(chosen.withColumnRenamed("doc_id", "_d").withColumnRenamed("gumbel_key", "_k"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("gumbel_key") == F.col("_k")), "left").select("doc_id", "n_features", "log_weight", "gumbel_key", F.coalesce(F.col("_r") <= F.col("_n"), F.lit(False)).alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, k: int | str | None = None, **params) -> DataFrame:
    """Pipeline form: the documents of the sample (``k`` as in ``select``), with all their columns. Documents are scored again as they are read, against the
    middle between the last key drawn and the next; only documents whose key is the last one, where not all of these are drawn, are sorted."""
    model, sample = fit(docs, labels, **params)
    mark, left, last = temp_name(docs, "_key"), 0, 0.0
    if k is None:
        cut = calibrated_cut(docs, model, sample)
    else:
        rows = materialise(scored(docs, model), "quality-rows")
        drawn = top_k(rows, target_size(rows, docs, model, sample) if k == TARGET else k)
        n, last = drawn.agg(F.count("*"), F.min("gumbel_key")).first()
        if not n:
            return docs.limit(0)
        above, ties, below = rows.agg(F.count_if(F.col("gumbel_key") > last), F.count_if(F.col("gumbel_key") == last), F.max(F.when((F.col("gumbel_key") < last) & (F.col("n_features") > 0), F.col("gumbel_key")))).first()
        left = n - above if above + ties > n else 0
        cut = float(np.nextafter(last, np.inf)) if left else (last + below) / 2 if below is not None else -1e300
        discard(rows)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def key(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, ids in parts:
            yield pd.Series(held.value.score(clean(text), ids.astype("Int64"))[2])

    marked = docs.withColumn(mark, key("text", "doc_id"))
    kept = marked.where(F.col(mark) >= cut).drop(mark)
    return kept.unionByName(marked.where(F.col(mark) == last).orderBy("doc_id").limit(left).drop(mark)) if left else kept


__all__ = ["TARGET", "calibrated_cut", "fit", "hash_fraction", "keep_selected", "scored", "select", "target_size", "top_k"]
