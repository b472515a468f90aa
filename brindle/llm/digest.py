"""Operator 4, document fingerprints: exact copies after canonicalisation.

Canonical form: Unicode NFKC, case folded, NFKC again, runs of white space one space, ends trimmed. Its 128-bit
xxh3 digest is the bucket; inside a bucket of several rows the canonical bytes are compared (as the grouping key, losslessly
compressed), so documents that only share a digest are never merged.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.base import bit_filter, in_filter, materialise


def canonical(text: str | None) -> str:
    s = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(s.split())


def digest(text: str, bits: int = 128) -> bytes:
    d = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
    return d if bits == 128 else bytes([d[0] & ((1 << bits) - 1)])


def digests(docs: DataFrame, bits: int = 128, clashing=None) -> DataFrame:
    """(row, doc_id, digest, low: its first 8 bytes) of every row; ``row`` is a number of its own once the result has been written. With ``clashing``, a filter
    of digests, (doc_id, digest, canon) of the rows that it may hold; canon is the compressed canonical text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1, write_checksum=False)
        for p in parts:
            forms = [canonical(t if isinstance(t, str) else None) for t in p["text"]]
            found = [digest(x, bits) for x in forms]
            low = np.array([int.from_bytes(x[:8], "little", signed=True) for x in found], np.int64)
            out = pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "digest": found})
            if clashing is None:
                yield out.assign(low=low)
            else:
                some = np.flatnonzero(in_filter(clashing.value, low))
                yield out.iloc[some].assign(canon=[pack.compress(forms[i].encode("utf-8", "surrogatepass")) for i in some])

    rows = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, digest binary, " + ("low long" if clashing is None else "canon binary"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def _grouped(rows: DataFrame, *key: str) -> DataFrame:
    """Each row of ``rows`` with its group's smallest id, its size, and whether it is the one that stays."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    groups = rows.groupBy(*key).agg(first, F.count("*").alias("copies"))
    return rows.join(groups, list(key)).select("doc_id", F.col("first.doc_id").alias("group_id"), "copies", (F.col("row") == F.col("first.row")).alias("keep"))


def exact_groups(docs: DataFrame, bits: int = 128) -> DataFrame:
    """One row a document: doc_id, group_id (the smallest id of the documents with the same canonical text),
    copies (rows in the group), keep (it is the row that stays).

    One row of each group has keep: that of the smallest id, one of them if rows repeat id and text; null ids yield to others, and a
    group without ids has a null group_id. Null and empty texts share the group of the empty text. Rows with one id count each; an empty
    table gives no rows. ``bits`` below 8 makes digests collide, for tests."""
    spark = docs.sparkSession
    rows = materialise(digests(docs, bits), "digest-rows")
    # only digests that occur twice can hide two texts: the bytes of those rows are compared
    twice = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("low").alias("low")).where("n > 1").select("digest", "low")
    on = bit_filter(twice.select("low"))
    if on is None:
        return rows.select("doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("copies"), F.lit(True).alias("keep"))
    held = spark.sparkContext.broadcast(on)
    texts = digests(docs, bits, held).groupBy("digest", "canon").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts"), F.sum("n").alias("rows"))
    clash = materialise(texts.where("texts > 1").select("digest"), "digest-clash")
    if clash.isEmpty():
        return _grouped(rows, "digest")
    # rows of digests with several texts are told apart by their bytes
    told = materialise(digests(docs, bits, held).join(clash, "digest", "left_semi"), "digest-told")
    return _grouped(rows.join(clash, "digest", "left_anti"), "digest").unionByName(_grouped(told, "digest", "canon"))
