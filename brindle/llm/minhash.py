"""Operator 10, near duplicates by MinHash with a signature-coordinate inverted join.

A document's signature has K minima over its distinct word pairs; a (coordinate, value) pair is a posting key. Two
documents match if they agree in ``least`` coordinates or more. Keys are ordered from rare to frequent over the corpus, and a
document is posted under a prefix only: with s keys that some other document has too, two matching documents
must meet in the first s - least + 1 keys of either, so no pair is lost. The dense lists beyond the prefix are
skipped: for documents that meet in a list, the collisions are counted by merging their signatures' fingerprints, coordinate by coordinate.
Documents with equal signatures are one entry of the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.base import bit_filter, discard, in_filter, materialise, temp_name
from brindle.llm.exchange import buckets_for, by_bucket, cut, distinct, merged, next_block, pack, pack_sorted, spread, unpack, unpack_sorted
from brindle.llm.textvec import Tokens, clean, mix, shingles, slabs

COORDINATES, SHINGLE, THRESHOLD = 64, 2, 0.6
HOT = 20_000  # entries that one task may compare with each other
SLICES = 2  # of the posting keys, one after another, so that only one slice's postings are on disk
_rng = np.random.default_rng(20_240_229)
_XOR = _rng.integers(0, 1 << 63, 512).astype(np.uint64)
_MUL = (_rng.integers(0, 1 << 63, 512).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def signatures(texts: list[str], k: int, n: int) -> tuple[np.ndarray, list[bytes | None]]:
    """(texts x k minima as uint32, digest of each text's words; None for a text without words)."""
    sig = np.zeros((len(texts), k), np.uint32)
    marks: list[bytes | None] = []
    for a, b in slabs(texts, 400_000):
        tok = Tokens(texts[a:b])
        marks += [xxhash.xxh3_128_digest(tok.hash[i:j].tobytes()) if j > i else None for i, j in zip(tok.first[:-1], tok.first[1:])]
        h, doc = shingles(tok, n)
        if not len(h):
            continue
        at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        with np.errstate(over="ignore"):
            for c in range(k):
                low = np.minimum.reduceat((h ^ _XOR[c]) * _MUL[c], at)
                sig[a + doc[at], c] = (mix(low) >> np.uint64(32)).astype(np.uint32)
    return sig, marks


def keys_of(sig: np.ndarray) -> np.ndarray:
    """Posting keys of signatures: coordinate and value, mixed to 64 bits."""
    c = np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(32)
    return mix(sig.astype(np.uint64) | c)


def signed(docs: DataFrame, k: int, n: int) -> DataFrame:
    """(row, doc_id, digest of the words, low: its first 8 bytes as a number, key of the signature, sig) of every row; ``row`` is a number of its own once
    the result has been written. Without words digest and key are null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            sig, marks = signatures(clean(p["text"]), k, n)
            sigs = [x.tobytes() if m else None for x, m in zip(sig, marks)]
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "digest": marks, "low": _low(marks), "key": [xxhash.xxh3_128_digest(x) if x else None for x in sigs], "sig": sigs})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, digest binary, low long, key binary, sig binary").withColumn("row", F.monotonically_increasing_id())


def _low(marks: list[bytes | None]) -> np.ndarray:
    return np.array([int.from_bytes(m[:8], "little", signed=True) if m else 0 for m in marks], np.int64)


def _pieces(rows: DataFrame) -> DataFrame:
    """The index: one entry for each distinct signature (equal ones agree everywhere), a few thousand entries packed in a row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                ids = p["doc_id"].astype("Int64")
                yield pd.DataFrame([{
                    "piece": next_block(), "n": len(p), "sigs": b"".join(p["sig"]), "keys": b"".join(p["key"]), "ids": pack(ids.fillna(0).to_numpy(np.int64)),
                    "no_id": pack(ids.isna().to_numpy(np.uint8)), "rows": pack(p["row"].to_numpy(np.int64)), "copies": pack(p["copies"].to_numpy(np.int64)),
                }])

    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    one = rows.where("key is not null").groupBy("key").agg(F.min("sig").alias("sig"), first, F.count("*").alias("copies"))
    schema = "piece long, n long, sigs binary, keys binary, ids binary, no_id binary, rows binary, copies binary"
    return one.select("key", "sig", "first.doc_id", "first.row", "copies").mapInPandas(run, schema)


def _entries(pieces: DataFrame) -> DataFrame:
    """(entry, key, doc_id and row of its first document, copies)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                ids = pd.array(unpack(r.ids, np.int64), dtype="Int64")
                ids[unpack(r.no_id, np.uint8).astype(bool)] = pd.NA
                yield pd.DataFrame({"entry": _numbers(r.piece, r.n), "key": [r.keys[i : i + 16] for i in range(0, len(r.keys), 16)], "doc_id": ids, "row": unpack(r.rows, np.int64), "copies": unpack(r.copies, np.int64)})

    return pieces.drop("sigs").mapInPandas(run, "entry long, key binary, doc_id long, row long, copies long")


def _numbers(piece: int, n: int) -> np.ndarray:
    return (piece << 20) + np.arange(n)


def _key_counts(pieces: DataFrame, k: int, buckets: int) -> DataFrame:
    """How many entries each key of a piece has, as replies."""

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                keys, _, _, count = distinct(keys_of(_matrix(r, k)).ravel())
                yield pd.DataFrame([(b, r.piece, pack_sorted(keys[s]), pack(count[s].astype(np.uint32))) for b, s in cut(keys, buckets)], columns=["bucket", "piece", "keys", "data"])

    def reply(p: pd.DataFrame) -> pd.DataFrame:
        keys, _, place, slices = merged([unpack_sorted(x) for x in p["keys"]])
        total = np.bincount(place, np.concatenate([unpack(x, np.uint32) for x in p["data"]]), minlength=len(keys)).astype(np.uint32)
        return pd.DataFrame({"piece": p["piece"], "bucket": p["bucket"], "data": [pack(total[place[s]]) for s in slices]})

    asked = pieces.select("piece", "n", "sigs").mapInPandas(ask, "bucket int, piece long, keys binary, data binary")
    return by_bucket(asked, buckets).groupBy("bucket").applyInPandas(reply, "piece long, bucket long, data binary")


def _matrix(r, k: int) -> np.ndarray:
    return np.frombuffer(r.sigs, np.uint32).reshape(r.n, k)


def _postings(pieces: DataFrame, counts: DataFrame, k: int, least: int, buckets: int, hot: int, parts: int, low: int, high: int) -> DataFrame:
    """Postings under the prefix keys from ``low`` on and below ``high``, packed by bucket; those of a key that more than ``hot`` entries have in rows of their own, of bucket -1."""

    def run(p: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in p.itertuples():
            mine = replies.sort_values("bucket")
            all_keys = keys_of(_matrix(r, k))
            uniq, _, place, _ = distinct(all_keys.ravel())
            df = np.concatenate([unpack(x, np.uint32) for x in mine["data"]])[place].reshape(all_keys.shape)
            shared = (df > 1).sum(1)
            have = np.flatnonzero(shared >= least)  # others can't agree with anyone in ``least`` coordinates
            keys, df, shared = all_keys[have], df[have], shared[have]
            rank = np.lexsort((keys, np.where(df > 1, df, np.iinfo(np.uint32).max)), axis=1)
            order = np.argsort(rank, axis=1)  # position of each coordinate's key from rare to frequent
            at, col = np.nonzero((order < (shared - least + 1)[:, None]) & (keys >= np.uint64(low)) & (keys <= np.uint64(high - 1)))
            prints = (keys & np.uint64(0xFFFF)).astype(np.uint16)
            key, entry, often = keys[at, col], _numbers(r.piece, r.n)[have][at], df[at, col] > hot
            by = np.argsort(key)
            key, entry, at, often = key[by], entry[by], at[by], often[by]
            few = np.flatnonzero(~often)
            out += [(b, None, pack_sorted(key[few[s]]), pack(entry[few[s]]), prints[at[few[s]]].tobytes()) for b, s in cut(key[few], buckets)]
            for s in np.split(np.flatnonzero(often), np.flatnonzero(np.diff(key[often])) + 1):
                if len(s):
                    out.append((-1, int(key[s[0]].view(np.int64)), None, entry[s].tobytes(), prints[at[s]].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "key", "keys", "entries", "prints"])

    return spread(pieces.select("piece", "n", "sigs"), "piece", parts).groupBy("piece").cogroup(spread(counts, "piece", parts).groupBy("piece")).applyInPandas(run, "bucket int, key long, keys binary, entries binary, prints binary")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(-1)


def _agreements(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.concatenate([_agree(prints[i : i + 20_000], one) for i in range(0, len(prints), 20_000)]) if len(prints) else np.empty(0, np.int64)


def _list_edges(entry: np.ndarray, prints: np.ndarray, least: int, every: bool) -> list[np.ndarray]:
    """Edges (a, b, collisions) within one posting list. Not ``every``: enough matching pairs to connect all that matching pairs
    connect. Disagreements obey the triangle inequality: sorted by those with a pivot, a document is compared only with documents whose number is
    within the limit of its own, and documents found once with those not found yet."""
    limit = prints.shape[1] - least
    out, left = [], np.arange(len(entry))

    def meet(x: int, others: np.ndarray) -> np.ndarray:
        n = _agreements(prints[others], prints[x])
        hit = n >= least
        if hit.any():
            out.append(np.column_stack((np.full(int(hit.sum()), entry[x]), entry[others[hit]], n[hit])))
        return hit

    while len(left) > 1:
        far = prints.shape[1] - _agreements(prints[left], prints[left[0]])
        by = np.argsort(far, kind="stable")
        left, far = left[by], far[by]
        if every:
            for i in range(len(left) - 1):
                meet(left[i], left[i + 1 : np.searchsorted(far, far[i] + limit, "right")])
            break
        near = int(np.searchsorted(far, limit, "right"))
        meet(left[0], left[1:near])
        rest, rest_far = left[near:], far[near:]
        front = [(x, d) for x, d in zip(left[1:near].tolist(), far[1:near].tolist()) if len(rest) and d >= rest_far[0] - limit]
        while front and len(rest):
            x, d = front.pop()
            a, b = np.searchsorted(rest_far, d - limit), np.searchsorted(rest_far, d + limit, "right")
            hit = meet(x, rest[a:b])
            if hit.any():
                front += zip(rest[a:b][hit].tolist(), rest_far[a:b][hit].tolist())
                stay = np.ones(len(rest), bool)
                stay[a:b] = ~hit
                rest, rest_far = rest[stay], rest_far[stay]
        left = rest
    return out


EDGE_SCHEMA = "a long, b long, collisions long"


def _edge_frame(found: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame(np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64), columns=["a", "b", "collisions"])


def _edges(postings: DataFrame, k: int, least: int, buckets: int, every: bool) -> DataFrame:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([unpack_sorted(x) for x in p["keys"]])
        entry = np.concatenate([unpack(x, np.int64) for x in p["entries"]])
        prints = np.frombuffer(b"".join(p["prints"]), np.uint16).reshape(len(key), k)
        by = np.lexsort((entry, key))
        key, entry, prints = key[by], entry[by], prints[by]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begin, len(key)))
        group, first = np.repeat(np.arange(len(begin)), size), np.repeat(begin, size)
        same = np.concatenate([_agree(prints[i : i + 50_000], prints[first[i : i + 50_000]]) for i in range(0, len(key), 50_000)])
        hit = (same >= least) & (np.arange(len(key)) != first)
        found = [np.column_stack((entry[first[hit]], entry[hit], same[hit]))]
        # everyone has met the first of the list; where someone doesn't match it, the list is gone through
        others = size - 1 - np.bincount(group[hit], minlength=len(begin))
        for g in np.flatnonzero((size > 2) & ((others > 0) | every)):
            s = slice(begin[g], begin[g] + size[g])
            found += _list_edges(entry[s], prints[s], least, every)
        return _edge_frame(found)

    return by_bucket(postings.where("bucket >= 0").select("bucket", "keys", "entries", "prints"), buckets).groupBy("bucket").applyInPandas(run, EDGE_SCHEMA)


def _hot_edges(postings: DataFrame, k: int, least: int, hot: int, every: bool, rounds: int = 3) -> list[DataFrame]:
    """Edges of the lists too long for one task, which stay in pieces of a few thousand. In each round a list's first entry is its pivot and meets every
    piece: what matches it is connected, and leaves the list unless a document that doesn't match the pivot may still match it (their numbers of
    disagreements with the pivot differ by no more than the limit). What is left of a list after the rounds is cut in chunks, and each pair of
    chunks is one task, so no task holds more than ``hot`` entries and no pair of entries is left out."""
    limit, out = k - least, []
    lists = postings.where("bucket < 0").select("key", "entries", "prints")
    if lists.isEmpty():
        return []

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            far = [k - _agreements(np.frombuffer(x, np.uint16).reshape(-1, k), np.frombuffer(y, np.uint16)) for x, y in zip(p["prints"], p["pivot_print"])]
            yield p.drop(columns="pivot_print").assign(far=[x.astype(np.uint8).tobytes() for x in far], least_far=[int(x[x > limit].min()) if (x > limit).any() else k + 1 for x in far])

    def connected(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                entry, far = np.frombuffer(r.entries, np.int64), np.frombuffer(r.far, np.uint8).astype(np.int64)
                hit = (far <= limit) & (entry != r.pivot)
                yield pd.DataFrame({"a": np.full(int(hit.sum()), r.pivot), "b": entry[hit], "collisions": k - far[hit]})

    def remaining(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                far = np.frombuffer(r.far, np.uint8).astype(np.int64)
                stay = (far > limit) | (far >= r.nearest - limit)
                if r.nearest <= k and stay.any():
                    yield pd.DataFrame([(r.key, np.frombuffer(r.entries, np.int64)[stay].tobytes(), np.frombuffer(r.prints, np.uint16).reshape(-1, k)[stay].tobytes())], columns=["key", "entries", "prints"])

    for _ in range(0 if every else rounds):
        head = F.struct(F.substring("entries", 1, 8).alias("e"), F.substring("prints", 1, 2 * k).alias("p"))
        pivots = lists.groupBy("key").agg(F.min(head).alias("x")).select(F.col("key").alias("_k"), F.col("x.p").alias("pivot_print"), F.col("x.e").alias("pivot_bytes"))
        near = lists.join(pivots, F.col("key") == F.col("_k")).drop("_k")
        far = materialise(near.mapInPandas(measured, "key long, entries binary, prints binary, pivot_bytes binary, far binary, least_far int"), "minhash-hot")
        out.append(far.select("entries", "far", "pivot_bytes").mapInPandas(lambda parts: connected(p.assign(pivot=[int.from_bytes(x, "little") for x in p["pivot_bytes"]]) for p in parts), EDGE_SCHEMA))
        nearest = far.groupBy("key").agg(F.min("least_far").alias("nearest")).withColumnRenamed("key", "_k")
        lists = materialise(far.select("key", "entries", "prints", "far").join(nearest, F.col("key") == F.col("_k")).mapInPandas(remaining, "key long, entries binary, prints binary"), "minhash-left")
        if lists.isEmpty():
            return out

    # chunks of half of ``hot``; a piece is in one chunk and meets its own and every other chunk of the list
    sized = lists.withColumn("n", (F.length("entries") / 8).cast("long"))
    chunks = sized.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(2 * F.sum("n") / F.lit(hot))).cast("int").alias("chunks")).withColumnRenamed("key", "_k")
    own = sized.join(chunks, F.col("key") == F.col("_k")).withColumn("c", F.pmod(F.xxhash64("entries"), F.col("chunks")).cast("int"))
    pairs_of = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "entries", "prints")

    def compared(p: pd.DataFrame) -> pd.DataFrame:
        entry = np.frombuffer(b"".join(p["entries"]), np.int64)
        return _edge_frame(_list_edges(entry, np.frombuffer(b"".join(p["prints"]), np.uint16).reshape(-1, k), least, every))

    return [*out, pairs_of.groupBy("key", "i", "j").applyInPandas(compared, EDGE_SCHEMA)]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge, root the smallest node it is connected with: large and small stars
    in turn, each round written, until nothing changes."""
    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    e0, state = e, None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        before, e = e0, materialise(e, "stars")
        discard(before)
        e0 = e
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now


def matching(docs: DataFrame, coordinates: int = COORDINATES, shingle: int = SHINGLE, threshold: float = THRESHOLD, every: bool = False, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(document rows, index entries, matching pairs of entries); ``every`` asks for all pairs, not only a connecting set."""
    least = math.ceil(coordinates * threshold)
    full = materialise(signed(docs, coordinates, shingle), "minhash-signatures")
    pieces = materialise(_pieces(full), "minhash-pieces")
    rows = materialise(full.drop("sig"), "minhash-rows")
    discard(full)
    n, parts = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    counts = materialise(_key_counts(pieces, coordinates, buckets_for(n * coordinates)), "minhash-counts")
    buckets = buckets_for(n * (coordinates - least + 1), 400_000)
    edges = None
    for i in range(SLICES):  # a key's list is in one slice
        low, high = ((x << 64) // SLICES for x in (i, i + 1))
        postings = materialise(_postings(pieces, counts, coordinates, least, buckets, hot, parts, low, high), "minhash-postings")
        found = _edges(postings, coordinates, least, buckets, every)
        for more in _hot_edges(postings, coordinates, least, hot, every):
            found = found.unionByName(more)
        found = materialise(found, "minhash-edges")
        discard(postings)
        edges = found if edges is None else edges.unionByName(found)
    entries = materialise(_entries(pieces), "minhash-entries")
    discard(pieces)
    discard(counts)
    return rows, entries, edges


def pairs(docs: DataFrame, **params) -> DataFrame:
    """All matching pairs of distinct signatures: doc_a < doc_b (each the smallest id of those that have the signature) and collisions."""
    _, entries, edges = matching(docs, every=True, **params)
    name = entries.select("entry", "doc_id")
    both = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "collisions").distinct()
    e = both.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b")
    return e.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "collisions")


def _grouped(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, group_id, group_size, stays: the row that stays) of every entry."""
    roots = components(edges)
    e = entries.join(roots, entries["entry"] == roots["node"], "left").select("key", "doc_id", "row", "copies", F.coalesce("root", "entry").alias("root"))
    total = e.groupBy("root").agg(F.sum("copies").alias("group_size"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    return e.select("key", "root").join(total, "root").select("key", F.col("first.doc_id").alias("group_id"), "group_size", F.col("first.row").alias("stays"))


def near_groups(docs: DataFrame, **params) -> DataFrame:
    """One row a document: doc_id, group_id (smallest id of its group), group_size (rows), keep (it is the row that stays).

    Groups are what matching pairs connect; pairs within a group aren't counted, which would be quadratic in a group of many texts. A null, empty or
    wordless text is a group of its own with group_id its own id and stays. Rows with one id are rows of the group each and one of them
    stays; null ids yield to others, and a group without ids has a null group_id. An empty table gives no rows."""
    rows, entries, edges = matching(docs, **params)
    groups = _grouped(entries, edges)
    ids = rows.select("doc_id", "key", "row")
    lone = ids.where("key is null").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("keep"))
    return lone.unionByName(ids.where("key is not null").join(groups, "key").select("doc_id", "group_id", "group_size", (F.col("row") == F.col("stays")).alias("keep")))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """Pipeline form: the documents that stay, with all their columns. Only texts of groups of several rows, found by a fixed-size filter of
    their digests, go through a join; the others stay as they are read."""
    rows, entries, edges = matching(docs, **params)
    groups = _grouped(entries, edges).where("group_size > 1")
    member = rows.where("key is not null").select("key", "digest", "low", "row").join(groups, "key")
    # of a digest's rows at most one stays: the one of that id, whichever of its repeats
    many = materialise(member.groupBy("digest").agg(F.min("low").alias("low"), F.max("group_id").alias("group_id"), F.max(F.col("row") == F.col("stays")).alias("stays")), "minhash-many")
    on = bit_filter(many.select("low"))
    if on is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(on)

    @F.pandas_udf("binary")
    def digest_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """The digest of a text whose group may have several rows, null for others."""
        for t in texts:
            out = []
            t = clean(t)
            for a, b in slabs(t):
                tok = Tokens(t[a:b])
                out += [xxhash.xxh3_128_digest(tok.hash[i:j].tobytes()) if j > i else None for i, j in zip(tok.first[:-1], tok.first[1:])]
            may = in_filter(held.value, _low(out))
            yield pd.Series([x if x and m else None for x, m in zip(out, may)], dtype=object)

    mark, same, group, stays = (temp_name(docs, c) for c in ("_digest", "_same", "_group", "_stays"))
    marked = docs.withColumn(mark, digest_of("text"))
    alone = marked.where(F.col(mark).isNull()).select(*docs.columns)
    some = marked.where(F.col(mark).isNotNull()).join(many.select(F.col("digest").alias(same), F.col("group_id").alias(group), F.col("stays").alias(stays)), F.col(mark) == F.col(same), "left")
    single = some.where(F.col(same).isNull()).select(*docs.columns)
    kept = some.where(F.col(stays) & F.col("doc_id").eqNullSafe(F.col(group))).dropDuplicates([mark]).select(*docs.columns)
    return alone.unionByName(single).unionByName(kept)
