"""Operator 1, language-model scoring with Katz backoff.

Words are the tokens, a document is padded with begin marks and ends in an end mark that is predicted too. An
n-gram that occurs ``cutoffs[n-1]`` times or more in the corpus is stored with its count; counts up to ``K`` have
Good-Turing discounts. P(w|h) is d(c) c / (C(h)+1) for a stored n-gram and alpha(h) P(w|h') otherwise; the one
pseudo-count keeps some mass for backoff in every context, and alpha(h) is the mass left over by the
exact sum over the stored words of h. Unigrams leave their discounted mass to unknown words. With the default cut-offs every n-gram
is stored.

Passes of request and reply between blocks of documents and buckets of the hash space (see ``exchange``): counts, context sums,
evaluation. A context that occurs in one block only is summed there, without asking. The counts and backoff weights stay in tables partitioned
by kind (model, backoff) in rows of one bucket or block each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.base import materialise, materialise_bucketed, ship
from brindle.llm.exchange import buckets_for, by_bucket, cut, distinct, merged, next_block, pack, pack_sorted, pack_values, spread, unpack, unpack_sorted, unpack_values
from brindle.llm.textvec import Tokens, clean, mix, slabs

K = 5
CUTOFFS = (1, 1, 1)
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
BLOCK_CHARS, PER_BUCKET, SLICES = 10_000_000, 1_500_000, 2
MOST_BLOCK_BUCKETS = 50_000  # files of the table of blocks; Spark allows 100,000
_M = np.uint64(0x9E3779B97F4A7C15)
BLOCK_SCHEMA = "block long, n_docs long, n_tokens long, doc_ids binary, no_id binary, sizes binary, words binary, tokens binary"


def key_bits(grams: float) -> int:
    """Bits of an n-gram's key: one key in 2**24 meets another's at any size of the corpus."""
    return min(64, max(40, math.ceil(math.log2(max(2.0, grams))) + 24))


def sizes(chars: int) -> tuple[int, int]:
    """(characters a block, keys a bucket). A block sends a row to each bucket, so both grow with the root of the input from 30 GB of text on, up
    to ten times, which is what a worker of a few GB can hold."""
    scale = min(10.0, max(1.0, math.sqrt(chars / 3e10)))
    return int(BLOCK_CHARS * scale), int(PER_BUCKET * scale)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * _M + b)


def encode_block(number: int, ids: pd.Series, texts: list[str]) -> dict:
    """A block as one row: its distinct word hashes, and the words of its documents as places among them."""
    hashes, sizes = [], []
    for a, b in slabs(texts):
        tok = Tokens(texts[a:b])
        hashes.append(tok.hash)
        sizes.append(tok.counts())
    words, _, place, _ = distinct(np.concatenate(hashes) if hashes else np.empty(0, np.uint64))
    sizes = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    return {"block": number, "n_docs": len(texts), "n_tokens": len(place), "doc_ids": pack(ids.fillna(0).to_numpy(np.int64)), "no_id": pack(ids.isna().to_numpy(np.uint8)), "sizes": pack(sizes.astype(np.uint32)), "words": pack_sorted(words), "tokens": pack(place.astype(np.uint32))}


def blocks_of(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = clean(p["text"])
            ids = p["doc_id"].astype("Int64")
            for a, b in slabs(texts, block_chars):
                yield pd.DataFrame([encode_block(next_block(), ids.iloc[a:b], texts[a:b])])

    return docs.select("doc_id", "text").mapInPandas(run, BLOCK_SCHEMA)


class Grams:
    """The n-grams of a block. Position p predicts the word ``target[p]``; ``begins`` marks a document's first. ``grams`` has the key of each position's
    n-gram and ``context`` that of its context, by order. After ``sort``: for each order the sorted distinct ``keys``, ``place`` of each position's n-gram
    among them, ``one`` position of each and ``counts``."""

    def __init__(self, row, order: int, bits: int):
        mask = np.uint64((1 << 64) - (1 << (64 - bits)))
        sizes = unpack(row.sizes, np.uint32).astype(np.int64)
        words, tokens = unpack_sorted(row.words), unpack(row.tokens, np.uint32)
        self.sizes = sizes
        n = sizes + 1
        end = np.cumsum(n) - 1
        total = int(n.sum())
        self.words, of = np.unique(np.append(words, END) & mask, return_inverse=True)
        self.word = np.empty(total, np.int32)
        is_end = np.zeros(total, bool)
        is_end[end] = True
        self.word[~is_end] = of[tokens]
        self.word[end] = of[-1]
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.begins = np.zeros(total, bool)
        self.begins[end - sizes] = True
        target = self.words[self.word]
        grams = [target]
        context = [np.zeros(total, np.uint64)]  # the whole keys of contexts; those of documents' begins keep all their bits
        for _ in range(1, order):
            ctx = np.empty(total, np.uint64)
            # the context of order n at p is the (n-1)-gram that ends at p - 1
            ctx[1:] = grams[-1][:-1]
            ctx[self.begins] = _start(len(context))
            context.append(ctx)
            grams.append(_pair(ctx, target) & mask)
        self.grams, self.context = grams, context

    def sort(self) -> Grams:
        one = np.empty(len(self.words), np.int32)
        one[self.word] = np.arange(len(self.word), dtype=np.int32)
        self.keys, self.one, self.place, self.counts = [self.words], [one], [self.word], [np.bincount(self.word, minlength=len(self.words)).astype(np.int32)]
        for g in self.grams[1:]:
            k, o, p, c = distinct(g)
            self.keys.append(k), self.one.append(o), self.place.append(p), self.counts.append(c)
        return self

    def counted(self, n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts) of order n's n-grams with a key from ``low`` on and below ``high``."""
        if n == 0:
            some = (self.words >= np.uint64(low)) & (self.words <= np.uint64(high - 1))
            return self.words[some], np.bincount(self.word, minlength=len(self.words))[some]
        g = self.grams[n]
        g = np.sort(g[(g >= np.uint64(low)) & (g <= np.uint64(high - 1))])
        at = np.flatnonzero(np.concatenate((np.ones(min(1, len(g)), bool), g[1:] != g[:-1])))
        return g[at], np.diff(np.append(at, len(g)))

    def context_place(self, n: int) -> np.ndarray:
        """For each distinct n-gram of order n (0 is unigrams) the place of its context among the (n-1)-grams; -1 at a document's begin."""
        at = self.one[n]
        prev = self.place[n - 1][np.maximum(at - 1, 0)]
        return np.where(self.begins[at], -1, prev)


def _start(n: int) -> np.uint64:
    """The context of n begin marks."""
    return mix(BEGIN + np.uint64(n))[()] if n > 1 else BEGIN


@dataclass
class Params:
    """What is global: discounts by order and count (at 0 those beyond ``K`` and not discounted), tokens, documents."""

    order: int
    cutoffs: tuple
    discount: np.ndarray
    tokens: float
    docs: float
    bits: int

    def weight(self, n: int, c: np.ndarray) -> np.ndarray:
        """Discounted count, 0 where the n-gram isn't stored."""
        d = self.discount[n][np.where(c > K, 0, c).astype(np.int64)]
        return np.where(c >= self.cutoffs[n], d * c, 0.0)


def discounts(counts: np.ndarray, cutoff: int) -> np.ndarray:
    """Katz's discounts from the counts of counts (index r). A discount that isn't in (0, 1], which small corpora
    can give, is replaced by r* of absolute discounting, (r - n1 / (n1 + 2 n2)) / r. Index 0 is the discount beyond K."""
    d = np.ones(K + 1)
    n = counts.astype(float)
    low = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 0.0
    for r in range(max(1, cutoff), K + 1):
        v = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail != 1 else -1.0
        d[r] = v if 0 < v <= 1 else (r - min(low, 0.99)) / r
    return d


def _count_requests(blocks: DataFrame, order: int, bits: int, buckets: int, low: int, high: int) -> DataFrame:
    """Of the keys from ``low`` on and below ``high``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for row in p.itertuples():
                g, out = Grams(row, order, bits), []
                for n in range(order):
                    keys, counts = g.counted(n, low, high)
                    out += [(b, n, row.block, pack_sorted(keys[s]), pack(counts[s].astype(np.uint32))) for b, s in cut(keys, buckets)]
                yield pd.DataFrame(out, columns=["bucket", "n", "block", "keys", "data"])

    return blocks.mapInPandas(run, "bucket int, n int, block long, keys binary, data binary")


def _count_replies(requests: DataFrame, cutoffs: tuple) -> DataFrame:
    """kind reply: for each key of a block 2 count + (1 for one block, its owner); kind model: the stored n-grams;
    kind stats: counts of counts."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        bucket = int(p["bucket"].iloc[0])
        for n, rows in p.groupby("n"):
            keys, one, place, slices = merged([unpack_sorted(x) for x in rows["keys"]])
            given = np.concatenate([unpack(x, np.uint32) for x in rows["data"]])
            total = np.bincount(place, given, minlength=len(keys)).astype(np.uint64)
            reply = total[place] << np.uint64(1)
            reply[one] |= np.uint64(1)
            out += [("reply", bucket, n, block, None, pack(reply[s])) for block, s in zip(rows["block"], slices)]
            kept = total >= cutoffs[n]
            out.append(("model", bucket, n, None, pack_sorted(keys[kept]), pack(total[kept])))
            out.append(("stats", bucket, n, None, None, np.bincount(np.minimum(total, K + 2).astype(np.int64), minlength=K + 3).astype(np.int64).tobytes()))
        return pd.DataFrame(out, columns=["kind", "bucket", "n", "block", "keys", "data"])

    return requests.groupBy("bucket").applyInPandas(run, "kind string, bucket int, n int, block long, keys binary, data binary")


def _counts(replies: pd.DataFrame, g: Grams) -> list[np.ndarray]:
    out = []
    for n in range(len(g.keys)):
        own = replies[replies["n"] == n].sort_values("bucket")
        out.append(np.concatenate([unpack(x, np.uint64) for x in own["data"]]) if len(own) else np.empty(0, np.uint64))
    return out


def _probabilities(g: Grams, reply: list[np.ndarray], m: Params) -> list[tuple]:
    """For each order (stored probability of each distinct n-gram, 0 where it isn't stored; place of its context; context's total)."""
    c = [(r >> np.uint64(1)).astype(np.float64) for r in reply]
    out = [(m.weight(0, c[0]) / m.tokens, None, None)]
    for n in range(1, m.order):
        ctx = g.context_place(n)
        total = np.where(ctx < 0, m.docs, c[n - 1][np.maximum(ctx, 0)])
        out.append((m.weight(n, c[n]) / (total + 1), ctx, total))
    return out


class Contexts:
    """Of order n's n-grams in a block: their stored probability and ownership, their contexts' keys (distinct ones, and the place of each n-gram's
    among them), and which contexts occur nowhere but in this block."""

    def __init__(self, g: Grams, reply: list[np.ndarray], prob: list[tuple], n: int, m: Params):
        self.stored, ctx, total = prob[n]
        self.own = (reply[n] & np.uint64(1)).astype(bool)
        self.count = reply[n] >> np.uint64(1)
        at = g.place[n - 1][g.one[n]]  # each n-gram's without its first word
        self.lower = prob[n - 1][0][at]
        self.lower_count = reply[n - 1][at] >> np.uint64(1)
        self.lower_total = prob[n - 1][2][at] if n > 1 else np.zeros(len(at))
        self.keys, _, self.place, _ = distinct(g.context[n][g.one[n]])
        here = np.where(ctx < 0, float(len(g.sizes)), g.counts[n - 1][np.maximum(ctx, 0)].astype(np.float64))
        self.local = self.of_each(here >= total)
        self.could = self.of_each(total >= m.cutoffs[n])  # frequent enough to have a stored word; the others' alpha is 1
        self.used = self.of_each(self.own | (self.stored == 0)) & self.could & ~self.local  # asked about: it adds to them or backs off from them
        self.backs = self.of_each(self.stored == 0)

    def of_each(self, flag: np.ndarray) -> np.ndarray:
        """Which contexts have an n-gram with ``flag``."""
        return np.bincount(self.place, flag, minlength=len(self.keys)) > 0

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.bincount(self.place, np.where(self.own & (self.stored > 0), x, 0.0), minlength=len(self.keys)) for x in (self.stored, self.lower))

    def local_alpha(self) -> np.ndarray:
        """Of the contexts that are only in this block: the exact weights; 1 elsewhere."""
        mass, lower = self.sums()
        return np.where(self.local & (mass > 0), _alpha(mass, lower), 1.0)


def _alpha(mass: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return (1 - mass) / np.maximum(1 - lower, 1e-12)


def _per_block(blocks: DataFrame, replies: DataFrame, m: Params, each, schema: str) -> DataFrame:
    """``each(row, grams, probabilities, contexts of each order, replies)`` gives rows or a frame for every block."""
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(_, p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in p.itertuples():
            mine = r[r["block"] == row.block]
            counts = mine[mine["kind"] == "reply"]
            g = Grams(row, m.order, m.bits).sort()
            reply = _counts(counts, g)
            prob = _probabilities(g, reply, m)
            got = each(row, g, prob, lambda n: Contexts(g, reply, prob, n, m), mine)  # noqa: B023
            out.append(got if isinstance(got, pd.DataFrame) else pd.DataFrame(got, columns=columns))
        return pd.concat(out) if out else pd.DataFrame(columns=columns)

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, schema)


def _local_backoff(blocks: DataFrame, replies: DataFrame, m: Params) -> DataFrame:
    """The weights of contexts that occur in one block only, a row for each block and order."""

    def each(row, g, prob, contexts, _):
        out = []
        for n in range(1, m.order):
            c = contexts(n)
            mass, lower = c.sums()
            some = c.local & (mass > 0)
            out.append(("backoff", None, n, row.block, pack_sorted(c.keys[some]), pack_values(_alpha(mass[some], lower[some]))))
        return out

    return _per_block(blocks, replies, m, each, "kind string, bucket int, n int, block long, keys binary, data binary")


def _context_requests(blocks: DataFrame, replies: DataFrame, m: Params, buckets: int) -> DataFrame:
    """Of contexts that other blocks have too: what each n-gram's owner knows of it, in whole numbers: its count, that of its lower-order n-gram and that of
    the latter's context. ``wants`` tells which weights the block needs to know."""

    def each(row, g, prob, contexts, _):
        out = []
        for n in range(1, m.order):
            c = contexts(n)
            mine = np.flatnonzero(c.own & c.used[c.place])
            mine = mine[np.argsort(c.place[mine], kind="stable")]
            has = np.bincount(c.place[mine], minlength=len(c.keys))[c.used]
            edge = np.concatenate(([0], np.cumsum(has)))
            asked, wants, told = c.keys[c.used], c.backs[c.used], [x[mine].astype(np.uint32) for x in (c.count, c.lower_count, c.lower_total)]
            for bk, s in cut(asked, buckets):
                grams = slice(edge[s.start], edge[s.stop])
                out.append((bk, n, row.block, pack_sorted(asked[s]), pack(has[s].astype(np.uint32)), *(pack(x[grams]) for x in told), pack(np.packbits(wants[s]))))
        return out

    return _per_block(blocks, replies, m, each, "bucket int, n int, block long, keys binary, has binary, counts binary, lower_counts binary, lower_totals binary, wants binary")


def _context_replies(requests: DataFrame, m: Params) -> DataFrame:
    """The weight of each context from all its n-grams, exact in double precision; kind alpha for the blocks that back off from it."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        bucket = int(p["bucket"].iloc[0])
        for n, rows in p.groupby("n"):
            keys, _, place, slices = merged([unpack_sorted(x) for x in rows["keys"]])
            counts, lower_counts, lower_totals, has = (np.concatenate([unpack(x, np.uint32) for x in rows[k]]).astype(np.float64) for k in ("counts", "lower_counts", "lower_totals", "has"))
            of = np.repeat(place, has.astype(np.int64))
            weight = m.weight(n, counts)
            stored = weight > 0
            total = np.bincount(of, counts, minlength=len(keys))
            mass = np.bincount(of, weight, minlength=len(keys)) / (total + 1)
            lower = m.weight(n - 1, lower_counts) / (lower_totals + 1 if n > 1 else m.tokens)
            alpha = np.where(mass > 0, _alpha(mass, np.bincount(of, np.where(stored, lower, 0.0), minlength=len(keys))), 1.0)
            for block, s, w in zip(rows["block"], slices, rows["wants"]):
                wanted = alpha[place[s]][np.unpackbits(unpack(w, np.uint8), count=s.stop - s.start).astype(bool)]
                if len(wanted):
                    out.append(("alpha", bucket, n, block, None, pack_values(wanted)))
            some = mass > 0
            out.append(("backoff", bucket, n, None, pack_sorted(keys[some]), pack_values(alpha[some])))
        return pd.DataFrame(out, columns=["kind", "bucket", "n", "block", "keys", "data"])

    return requests.groupBy("bucket").applyInPandas(run, "kind string, bucket int, n int, block long, keys binary, data binary")


SCORE_SCHEMA = "doc_id long, n_tokens long, log_prob double, log_prob_per_token double, perplexity double, backed_off long"


def _scores(blocks: DataFrame, replies: DataFrame, m: Params) -> DataFrame:
    def each(row, g, prob, contexts, mine):
        alphas = mine[mine["kind"] == "alpha"]
        p_now = prob[0][0][g.place[0]]
        backs = np.zeros(len(p_now), np.int64)
        for n in range(1, m.order):
            here = prob[n][0][g.place[n]]
            down = here == 0
            if down.any():
                c = contexts(n)
                alpha = c.local_alpha()
                told = alphas[alphas["n"] == n].sort_values("bucket")
                if len(told):
                    alpha[np.flatnonzero(c.used & c.backs)] = np.concatenate([unpack_values(x) for x in told["data"]])
                p_now = np.where(down, alpha[c.place[g.place[n]]] * p_now, here)
            else:
                p_now = here
            backs += down
        size = g.sizes + 1
        log = np.bincount(g.doc, np.log(p_now), minlength=len(size))
        ids = pd.array(unpack(row.doc_ids, np.int64), dtype="Int64")
        ids[unpack(row.no_id, np.uint8).astype(bool)] = pd.NA
        return pd.DataFrame({"doc_id": ids, "n_tokens": g.sizes, "log_prob": log, "log_prob_per_token": log / size, "perplexity": np.exp(-log / size), "backed_off": np.bincount(g.doc, backs, minlength=len(size)).astype(np.int64)})

    return _per_block(blocks, replies, m, each, SCORE_SCHEMA)


@dataclass
class Fitted:
    params: Params
    blocks: DataFrame  # in ``parts`` buckets by block
    parts: int
    tables: DataFrame  # kind, bucket, n, block, keys, data

    def stored(self, kind: str) -> DataFrame:
        """The model's packed tables: kind ``model`` (counts) or ``backoff`` (alpha)."""
        return self.tables.where(F.col("kind") == kind)

    def replies(self, *kinds: str) -> DataFrame:
        return spread(self.tables.where(F.col("kind").isin(*kinds)).select("kind", "block", "bucket", "n", "data"), "block", self.parts)


def _added(p: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"n": [int(p["n"].iloc[0])], "data": [np.sum([np.frombuffer(x, np.int64) for x in p["data"]], axis=0).tobytes()]})


def fit(docs: DataFrame, order: int = 3, cutoffs: tuple = CUTOFFS, block_chars: int | None = None, per_bucket: int | None = None) -> Fitted:
    """Count n-grams up to ``order`` over all of ``docs`` and normalise them. The sizes of blocks and buckets change the work only."""
    ship(docs.sparkSession, 16)  # a block is cut from one batch
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    block_chars, per_bucket = block_chars or sizes(chars)[0], per_bucket or sizes(chars)[1]
    parts = min(MOST_BLOCK_BUCKETS, max(1, math.ceil(chars / block_chars)))
    blocks = materialise_bucketed(blocks_of(docs, block_chars), "katz-blocks", "block", parts)
    r = blocks.agg(F.sum("n_tokens"), F.sum("n_docs")).first()
    tokens, n_docs = r[0] or 0, r[1] or 0
    grams = (tokens + n_docs) * order
    bits, buckets = key_bits(grams), buckets_for(grams, per_bucket)
    once = None
    for i in range(SLICES):  # of the keys, one after another, so that only one slice's requests are on disk
        low, high = ((x << 64) // SLICES for x in (i, i + 1))
        part = materialise(_count_replies(by_bucket(_count_requests(blocks, order, bits, buckets, low, high), buckets), cutoffs), "katz-counts", ("kind",))
        once = part if once is None else once.unionByName(part)
    table = np.zeros((order, K + 3), np.int64)
    # merged on the executors, first by bucket's remainder, to one row an order
    stats = once.where("kind = 'stats'").select("n", "data", F.pmod("bucket", F.lit(64)).alias("part"))
    for x in stats.groupBy("n", "part").applyInPandas(_added, "n int, data binary").groupBy("n").applyInPandas(_added, "n int, data binary").collect():
        table[x["n"]] += np.frombuffer(x["data"], np.int64)
    m = Params(order, tuple(cutoffs), np.array([discounts(t, c) for t, c in zip(table, cutoffs)]), float(tokens + n_docs), float(n_docs), bits)
    counted = Fitted(m, blocks, parts, once)
    again = materialise(_context_replies(by_bucket(_context_requests(blocks, counted.replies("reply"), m, buckets), buckets), m), "katz-backoff", ("kind",))
    local = materialise(_local_backoff(blocks, counted.replies("reply"), m), "katz-local", ("kind",))
    return Fitted(m, blocks, parts, once.unionByName(local).unionByName(again))


def score(docs: DataFrame, **params) -> DataFrame:
    """One row a document: doc_id, n_tokens, log_prob (natural, with the end mark), log_prob_per_token, perplexity,
    backed_off (steps down to a lower order). A null or empty text is its end mark only; rows with one id are scored
    each; an empty table gives no rows. With cut-offs of 1 every n-gram of the corpus itself is stored and nothing backs off."""
    model = fit(docs, **params)
    return _scores(model.blocks, model.replies("reply", "alpha"), model.params)


__all__ = ["Fitted", "Grams", "Params", "discounts", "fit", "score"]
