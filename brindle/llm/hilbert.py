"""Operator 6, packing along a space-filling curve.

A document's hashed bag-of-words vector is projected to ``DIMS`` dimensions by random signs, each dimension cut into
equal shares of the corpus (``2**BITS`` cells by its quantiles), and the cell's place on the Hilbert curve is the key. Documents
are range-sorted by the key and laid end to end, and every ``capacity`` tokens a new pack begins: a document that crosses the
boundary goes on in the next pack, so all packs but the last are full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.base import materialise
from brindle.llm.exchange import buckets_for
from brindle.llm.textvec import Tokens, clean, mix, slabs

DIMS, BITS, CAPACITY = 4, 8, 4096


def project(texts: list[str], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(texts x dims, tokens). A word adds a sign to each dimension, from its hash; the sum is divided by the root of the
    number of words, so that length doesn't order the documents."""
    out, n = np.zeros((len(texts), dims)), np.zeros(len(texts), np.int64)
    for a, b in slabs(texts):
        tok = Tokens(texts[a:b], symbols=True)
        n[a:b] = tok.counts()
        h = mix(tok.hash ^ np.uint64(0xC2B2AE3D27D4EB4F))
        for d in range(dims):
            sign = ((h >> np.uint64(d)) & np.uint64(1)).astype(np.float64) * 2 - 1
            out[a:b, d] = np.bincount(tok.doc, sign, minlength=b - a)
    return out / np.sqrt(np.maximum(n, 1))[:, None], n


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer ``cells`` (each below 2**bits), by Gray-code rotation of the
    axes from the coarsest bit to the finest."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def vectors(docs: DataFrame, dims: int = DIMS) -> DataFrame:
    """(doc_id, n_tokens, tie, v0..) of every row; tie is a hash of the text that orders rows of equal key and id."""
    names = [f"v{d}" for d in range(dims)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = clean(p["text"])
            v, n = project(texts, dims)
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "n_tokens": n, "tie": p["tie"], **{c: v[:, i] for i, c in enumerate(names)}})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInPandas(run, "doc_id long, n_tokens long, tie long, " + ", ".join(f"{c} double" for c in names))


def keyed(rows: DataFrame, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """Add ``hilbert_key``. The cells are cut at the quantiles of all rows with tokens."""
    names = [f"v{d}" for d in range(dims)]
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = rows.where("n_tokens > 0").agg(*[F.percentile_approx(c, at, 10_000).alias(c) for c in names]).first()
    edges = [np.array(cuts[c] if cuts[c] is not None else []) for c in names]

    @F.pandas_udf("long")
    def key(*cols: pd.Series) -> pd.Series:
        cells = np.column_stack([np.searchsorted(e, c.to_numpy(), "right") for e, c in zip(edges, cols)]) if len(cols[0]) else np.empty((0, dims), int)
        return pd.Series(hilbert_key(cells, bits))

    return rows.withColumn("hilbert_key", key(*names))


def pack(docs: DataFrame, capacity: int = CAPACITY, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """One row for each piece of a document in a pack: doc_id, hilbert_key, pack_id, pack_offset (tokens before it in the pack),
    doc_offset (tokens of the document before it) and n_tokens.

    Order is hilbert_key, doc_id (null first), hash of the text. A null or empty text has no tokens and is one
    row of 0 tokens with a null pack_id. Rows with one id are packed each. A document longer than a pack has a
    piece in each pack it crosses. An empty table gives no rows."""
    rows = materialise(vectors(docs, dims), "hilbert-vectors")
    keys = keyed(rows, dims, bits).select("doc_id", "n_tokens", "tie", "hilbert_key")
    full = keys.where("n_tokens > 0")
    parts = buckets_for(rows.count(), 500_000, 8)
    order = ["hilbert_key", F.col("doc_id").asc_nulls_first(), "tie"]
    ranged = full.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "hilbert-sorted")
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).select("part", "base")
    placed = ranged.withColumn("end", F.sum("n_tokens").over(within)).join(F.broadcast(before), "part").withColumn("start", F.col("base") + F.col("end") - F.col("n_tokens"))
    c = F.lit(capacity).cast("long")
    first = F.floor(F.col("start") / c)
    last = F.floor((F.col("start") + F.col("n_tokens") - 1) / c)
    pieces = placed.withColumn("pack_id", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest("start", F.col("pack_id") * c), F.least(F.col("start") + F.col("n_tokens"), (F.col("pack_id") + 1) * c)
    out = pieces.select("doc_id", "hilbert_key", "pack_id", (lo - F.col("pack_id") * c).alias("pack_offset"), (lo - F.col("start")).alias("doc_offset"), (hi - lo).alias("n_tokens"))
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    return out.unionByName(keys.where("n_tokens = 0").select("doc_id", "hilbert_key", none.alias("pack_id"), zero.alias("pack_offset"), zero.alias("doc_offset"), zero.alias("n_tokens")))
