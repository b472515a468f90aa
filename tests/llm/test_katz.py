import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from brindle.llm import katz, registry
from tests.llm import helpers as h


class Brute:
    """Katz backoff with dictionaries, one document after another."""

    def __init__(self, texts, order, cutoffs):
        self.order, self.cutoffs = order, cutoffs
        self.docs = [["<s>"] * (order - 1) + (t or "").split() + ["</s>"] for t in texts]
        self.c = [Counter(tuple(d[i - n : i + 1]) for d in self.docs for i in range(order - 1, len(d))) for n in range(order)]
        self.d = []
        for n, c in enumerate(self.c):
            r = [0] * (katz.K + 3)
            for v in c.values():
                r[min(v, katz.K + 2)] += 1
            self.d.append(katz.discounts(np.array(r), cutoffs[n]))
        self.total = sum(self.c[0].values())
        self.context = [Counter() for _ in range(order)]
        for n in range(1, order):
            for g, v in self.c[n].items():
                self.context[n][g[:-1]] += v

    def stored(self, g):
        n, v = len(g) - 1, self.c[len(g) - 1][g]
        if v < self.cutoffs[n]:
            return 0.0
        w = (self.d[n][v] if v <= katz.K else 1.0) * v
        return w / self.total if n == 0 else w / (self.context[n][g[:-1]] + 1)

    def alpha(self, ctx):
        n = len(ctx)
        seen = [g for g in self.c[n] if g[:-1] == ctx and self.stored(g) > 0]
        return (1 - sum(map(self.stored, seen))) / (1 - sum(self.p(g[1:]) for g in seen)) if seen else 1.0

    def p(self, g):
        s = self.stored(g)
        return s if s or len(g) == 1 else self.alpha(g[:-1]) * self.p(g[1:])


@pytest.mark.parametrize(("order", "cutoffs"), [(2, (1, 2)), (3, (1, 2, 2)), (3, (1, 1, 1))])
def test_scores_equal_brute_force(spark, order, cutoffs):
    texts = [*h.mixed(24), "", None, "the the the of the the"]
    b = Brute(texts, order, cutoffs)
    got = {r["doc_id"]: r for r in katz.score(h.documents(spark, texts), order=order, cutoffs=cutoffs, block_chars=700, per_bucket=300).collect()}
    for i, d in enumerate(b.docs):
        want = sum(math.log(b.p(tuple(d[j - order + 1 : j + 1]))) for j in range(order - 1, len(d)))
        assert got[i]["log_prob"] == pytest.approx(want, rel=1e-11)
        assert got[i]["n_tokens"] == len(d) - order


def test_registered_query_keeps_what_is_seen_once(spark, tmp_path):
    texts = [*h.mixed(24), "", None, "the the the of the the"]
    h.documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    b = Brute(texts, 3, (1, 1, 1))
    got = {r["doc_id"]: r for r in registry.op1_katz_scores(spark, str(tmp_path)).collect()}
    for i, d in enumerate(b.docs):
        grams = [tuple(d[j - 2 : j + 1]) for j in range(2, len(d))]
        assert got[i]["log_prob"] == pytest.approx(sum(math.log(b.p(g)) for g in grams), rel=1e-5)
        assert got[i]["backed_off"] == 0  # each trigram of the corpus is in the model


@pytest.mark.parametrize("cutoffs", [(1, 2, 2), (1, 1, 1)])
def test_the_stored_model_is_exactly_normalised(spark, cutoffs):
    """Read the counts and weights back from the tables and sum each context over all words and the unknown one."""
    texts = [*h.mixed(24), "the the the of the the"]
    m = katz.fit(h.documents(spark, texts), cutoffs=cutoffs, block_chars=700, per_bucket=300)
    count, alpha = {}, {}
    for r in m.stored("model").collect():
        count |= zip(zip([r["n"]] * 10**6, katz.unpack_sorted(r["keys"]).tolist()), katz.unpack(r["data"], np.uint64).tolist())
    for r in m.stored("backoff").collect():
        new = dict(zip(zip([r["n"]] * 10**6, katz.unpack_sorted(r["keys"]).tolist()), katz.unpack_values(r["data"]).tolist()))
        assert not new.keys() & alpha.keys()
        alpha |= new
    mask = (1 << 64) - (1 << (64 - m.params.bits))
    words = sorted({w for t in texts for w in t.split()})
    of = {w: int(katz.Tokens([w]).hash[0]) & mask for w in words} | {"</s>": int(katz.END) & mask}
    pair = lambda a, b: int(katz._pair(np.array([a], np.uint64), np.array([b], np.uint64))[0]) & mask
    d, total, docs = m.params.discount, m.params.tokens, m.params.docs
    brute = Brute(texts, 3, cutoffs)
    stored = lambda n, key, c: (d[n][min(v, katz.K + 1) if v <= katz.K else 0] * v) / c if (v := count.get((n, key), 0)) else 0.0
    uni = {w: stored(0, k, total) for w, k in of.items()}
    unknown = 1 - sum(uni.values())
    assert unknown >= -1e-12

    def bigrams(ctx, c):
        p = {w: stored(1, pair(ctx, k), c + 1) or alpha.get((1, ctx), 1.0) * uni[w] for w, k in of.items()}
        return p, alpha.get((1, ctx), 1.0) * unknown

    for w in words[:15]:
        p1, rest1 = bigrams(of[w], brute.c[0][(w,)])
        assert sum(p1.values()) + rest1 == pytest.approx(1, abs=1e-12)
        for v in words[:15]:
            h2 = pair(of[v], of[w])
            if c2 := brute.c[1][(v, w)]:
                a2 = alpha.get((2, h2), 1.0)
                p2 = [stored(2, pair(h2, k), c2 + 1) or a2 * p1[x] for x, k in of.items()]
                assert sum(p2) + a2 * rest1 == pytest.approx(1, abs=1e-12)
    start, _ = bigrams(int(katz.BEGIN), docs)
    assert sum(start.values()) == pytest.approx(1 - alpha[1, int(katz.BEGIN)] * unknown, abs=1e-12)


def test_sizes_grow_with_the_root_of_the_input_and_keys_with_its_logarithm():
    assert katz.sizes(10**9) == (10_000_000, 1_500_000) and katz.sizes(10**14) == (100_000_000, 15_000_000)
    assert katz.key_bits(2**27) == 51 and katz.key_bits(10**14) == 64
    blocks, buckets = 10**14 / katz.sizes(10**14)[0], 10**14 / 2 / katz.sizes(10**14)[1]
    assert blocks * buckets < 10**14 / 10  # rows of the exchange stay below a tenth of the characters


def test_spread_does_not_matter(spark):
    d = h.documents(spark, h.mixed(40))
    a = {r["doc_id"]: r["log_prob"] for r in katz.score(d, block_chars=500, per_bucket=200).collect()}
    b = {r["doc_id"]: r["log_prob"] for r in katz.score(d.repartition(5)).collect()}
    assert all(a[i] == pytest.approx(b[i], rel=1e-6) for i in a)


def test_model_is_stored(spark):
    m = katz.fit(h.documents(spark, h.mixed(20)))
    assert m.stored("model").count() > 0 and m.stored("backoff").count() > 0


def test_requests_read_a_blocks_contexts_once_whatever_the_number_of_buckets(monkeypatch):
    """Gathering them anew for every bucket is quadratic in the input."""
    texts = h.mixed(60)
    g = katz.Grams(SimpleNamespace(**katz.encode_block(0, pd.Series(range(60), dtype="Int64"), texts)), 2, 64).sort()
    # as if another block had each n-gram once more, so that every context is asked about
    reply = [(c.astype(np.uint64) + np.uint64(1)) << np.uint64(1) | np.uint64(1) for c in g.counts]
    m = katz.Params(2, (1, 1), np.full((2, katz.K + 1), 0.9), 2.0 * sum(g.counts[0]), 120.0, 64)
    c = katz.Contexts(g, reply, katz._probabilities(g, reply, m), 1, m)
    masked = []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            masked.append(not isinstance(at, slice))
            return np.asarray(self)[at]

    c.keys = c.keys.view(Counting)
    monkeypatch.setattr(katz, "_per_block", lambda blocks, replies, m, each, schema: each)
    rows = katz._context_requests(None, None, m, 500)(SimpleNamespace(block=0), g, None, lambda n: c, None)
    assert len(rows) > 30 and sum(masked) == 1
    assert np.array_equal(np.concatenate([katz.unpack_sorted(r[3]) for r in rows]), np.asarray(c.keys)[c.used])
