"""Digest, licences, dropout, fertility."""

import base64
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
import sentencepiece
import tiktoken

from brindle.llm import digest, dropout, fertility, licences
from brindle.llm.base import TOKENIZERS
from tests.llm import helpers as h

SP = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{fertility.MODEL}")
ODD_TEXTS = ["", " ", "  a  b ", "x" * 300 + " y", "日本語 テスト\n\t é́ \U0001f600", "\n\n", "ab" * 100, "Größe straße ½ ﬁ", "a  "]


@pytest.mark.parametrize("bits", [128, 2])
def test_exact_groups_equal_brute_force(spark, bits):
    texts = ["A  cat", "a cat", "ＡＣａｔ", "a\ncat ", None, "", " ", "Straße", "STRASSE", "ﬁne", "fine", "a cat!"]
    got = {r["doc_id"]: (r["group_id"], r["copies"], r["keep"]) for r in digest.exact_groups(h.documents(spark, texts), bits).collect()}
    canon = [digest.canonical(t) for t in texts]
    for i, c in enumerate(canon):
        same = [j for j, x in enumerate(canon) if x == c]
        assert got[i] == (same[0], len(same), same[0] == i)


@pytest.mark.parametrize("bits", [128, 1])
def test_exact_groups_without_ids_and_with_repeats_keep_one_row(spark, bits):
    rows = [(None, "hello world"), (None, "Hello  World"), (1, "b"), (1, "b"), (2, "b"), (None, "b"), (3, None), (None, ""), (4, "c")]
    got = digest.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), bits).toPandas()
    assert len(got) == len(rows) and got["keep"].sum() == 4
    hello = got[(got["doc_id"].isna()) & (got["group_id"].isna())]
    assert len(hello) == 2 and hello["keep"].sum() == 1 and set(hello["copies"]) == {2}
    b = got[got["group_id"] == 1]
    assert len(b) == 4 and set(b["copies"]) == {4} and b[b["keep"]]["doc_id"].tolist() == [1]


def test_licences_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    filler = "the work under this version of mit das und mit der public license is general".split()
    texts = []
    for k in range(60):
        words = rng.choice(filler, rng.integers(0, 60)).tolist()
        if k % 2:
            notice = licences.TEMPLATES[k // 2 % len(licences.TEMPLATES)][1].split()
            at = rng.integers(0, len(words) + 1)
            words[at:at] = notice
        texts.append(" ".join(words))
    texts += ["This work is licensed under the GNU General Public License, version 2", "Licensed under the Apache Licence"]
    got = {(r["doc_id"], r["licence"]) for r in licences.scan(h.documents(spark, texts)).collect()}
    index, want = licences.base_index(), set()
    for i, t in enumerate(texts):
        w = licences.word_hashes(t)
        for n, tpl, phrases in zip(index.names, index.words, index.phrases):
            for at in range(-len(tpl), len(w) + 3):
                if licences.coverage(w, at, tpl, 3) >= licences.COVERAGE and licences.has_phrases(w, at, phrases, 3):
                    want.add((i, n))
    assert got == want and len(want) >= 30


def test_notice_with_a_changed_word_and_its_place(spark):
    t = "some words first Permission is hereby granted, free of charge, to every person obtaining a copy of this software and associated documentation files more"
    r = licences.scan(h.documents(spark, [t])).first()
    assert (r["licence"], r["first_word"], r["places"]) == ("MIT", 3, 1) and 0.75 < r["coverage"] < 1


def test_without_dropout_it_is_the_library_s_encoding():
    c = dropout.codec(f"{TOKENIZERS}/{dropout.MODEL}")
    texts = [*h.mixed(40), *ODD_TEXTS]
    ids, n = dropout.encode(c, texts, np.arange(len(texts), dtype=np.uint64), 0.0)
    for x, t in zip(np.split(ids, np.cumsum(n)[:-1]), texts):
        assert x.tolist() == SP.encode(t)


def brute_merges(text, row, drop):
    """Pieces of each word by the book: of all neighbours that form a piece and aren't skipped, merge the best until none is left."""
    rank = {SP.id_to_piece(i): (-SP.get_score(i), i) for i in range(SP.get_piece_size()) if not (SP.is_byte(i) or SP.is_control(i) or SP.is_unknown(i))}
    out = []
    for place, word in enumerate(re.findall(" +[^ ]*", " " + text) if text else []):
        key = dropout.mix(np.array([(row + place * 0x9E3779B97F4A7C15) % 2**64], np.uint64))
        parts = [(i, i + 1) for i in range(len(word))]
        known = {c for p in rank for c in p}
        s = "".join("▁" if c == " " else "?" if c == "▁" or c not in known else c for c in word)
        while True:
            able = []
            for k in range(len(parts) - 1):
                (a, m), (_, b) = parts[k], parts[k + 1]
                if "?" not in s[a:b] and s[a:b] in rank and not (drop and dropout._skips(key, *(np.array([x]) for x in (a, m, b)), drop)[0]):
                    able.append((rank[s[a:b]], a, k))
            if not able:
                break
            k = min(able)[2]
            parts[k : k + 2] = [(parts[k][0], parts[k + 1][1])]
        for a, b in parts:
            out += [rank[s[a:b]][1]] if s[a:b] in rank and "?" not in s[a:b] else [SP.piece_to_id("<0x%02X>" % x) for x in word[a:b].encode()]
    return out


@pytest.mark.parametrize("drop", [0.0, 0.1, 0.5])
def test_dropout_equals_brute_force(drop):
    c = dropout.codec(f"{TOKENIZERS}/{dropout.MODEL}")
    texts = [*h.mixed(20), *ODD_TEXTS, "internationalisation " * 5]
    rows = dropout.row_keys(pd.Series(range(len(texts)), dtype="Int64"), texts, 17)
    ids, n = dropout.encode(c, texts, rows, drop)
    for x, t, r in zip(np.split(ids, np.cumsum(n)[:-1]), texts, rows.tolist()):
        assert x.tolist() == brute_merges(t, r, drop), t


@pytest.mark.parametrize("drop", [0.1, 0.5, 1.0])
def test_dropout_is_lossless_and_keyed(drop):
    c = dropout.codec(f"{TOKENIZERS}/{dropout.MODEL}")
    texts = [*h.mixed(40), *ODD_TEXTS, "a▁b ▁"]
    at = np.arange(len(texts), dtype=np.uint64)
    ids, n = dropout.encode(c, texts, at, drop)
    assert c.decode(ids, n) == [t.encode() for t in texts]
    again, _ = dropout.encode(c, texts[::-1], at[::-1], drop)
    assert sorted(again.tolist()) == sorted(ids.tolist())
    other, _ = dropout.encode(c, texts, at + np.uint64(5), drop)
    assert drop == 1.0 or other.tolist() != ids.tolist()


def test_every_occurrence_of_a_word_draws_for_itself(spark):
    words = " ".join(["internationalisation"] * 400)
    e = {r["doc_id"]: r["ids"] for r in dropout.encode_documents(spark.createDataFrame([(1, words), (2, words), (None, words), (None, words + " x")], "doc_id long, text string")).collect() if r["doc_id"]}
    assert e[1] != e[2]
    starts = [i for i, x in enumerate(e[1]) if SP.id_to_piece(x).startswith("▁")] + [len(e[1])]
    assert len({tuple(e[1][a:b]) for a, b in zip(starts, starts[1:])}) > 60


def test_words_beyond_the_limit_are_encoded_alike(monkeypatch):
    c = dropout.codec(f"{TOKENIZERS}/{dropout.MODEL}")
    texts = [*h.mixed(20), "x" * 100 + " internationalisation ééé    "]
    rows = np.arange(len(texts), dtype=np.uint64)
    for drop in (0.0, 0.3):
        want = [x.tolist() for x in dropout.encode(c, texts, rows, drop)]
        for name, value in (("LONG", 3), ("TOGETHER", 7)):
            with monkeypatch.context() as m:
                m.setattr(dropout, name, value)
                assert [x.tolist() for x in dropout.encode(c, texts, rows, drop)] == want


def test_share_of_skipped_merges():
    keys = dropout.mix(np.arange(4000, dtype=np.uint64))
    skipped = dropout._skips(keys, *(np.full(4000, i) for i in (0, 1, 2)), 0.1).mean()
    assert abs(skipped - 0.1) < 0.02


def test_documents_round_trip(spark):
    texts = [*h.mixed(20), *ODD_TEXTS]
    e = dropout.encode_documents(h.documents(spark, texts))
    assert e.where("not lossless").count() == 0
    got = {r["doc_id"]: r["text"] for r in dropout.decode_documents(e).collect()}
    assert got == dict(enumerate(texts))


def test_fertility_equals_brute_force(spark):
    texts = [*h.mixed(20), *ODD_TEXTS, "naïve café 𝔘𝔫𝔦"]
    got = {r["doc_id"]: r for r in fertility.measures(h.documents(spark, texts)).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{TOKENIZERS}/{fertility.BYTE_LEVEL}", "rb"))}
    split = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    multi = tiktoken.Encoding("plain", pat_str=split, mergeable_ranks=ranks, special_tokens={})
    back = {i: t for t, i in ranks.items()}

    def is_part(i):
        try:
            back[i].decode()
        except UnicodeDecodeError:
            return True
        return False

    for i, t in enumerate(texts):
        for v, ids, broken in (("piece", SP.encode(t), SP.is_byte), ("bytes", multi.encode_ordinary(t), is_part)):
            assert got[i][f"{v}_tokens"] == len(ids)
            if ids:
                p = np.unique(ids, return_counts=True)[1] / len(ids)
                assert got[i][f"{v}_chars_per_token"] == pytest.approx(len(t) / len(ids))
                assert got[i][f"{v}_byte_share"] == pytest.approx(np.mean([broken(x) for x in ids]))
                assert got[i][f"{v}_entropy"] == pytest.approx(-(p * np.log2(p)).sum())
            else:
                assert got[i][f"{v}_entropy"] is None or np.isnan(got[i][f"{v}_entropy"])


def test_fertility_bands_reject_noise_and_keep_prose(spark):
    """Long and short noise, repetition, and its opposite: no text is too short to be judged."""
    rng = random.Random(4)
    texts = [h.sentence(rng, "en", rng.choice((8, 20, 60, 300))) for _ in range(400)]
    noise = ["".join(chr(rng.randrange(0x2500, 0x2600)) for _ in range(n)) for n in (600, 40)] + ["the " * 400, "the " * 60]
    got = {r["doc_id"]: (r["keep"], r["reasons"]) for r in fertility.judge(h.documents(spark, [*texts, *noise, "", None])).collect()}
    assert sum(got[i][0] for i in range(400)) >= 398
    assert not any(got[i][0] for i in range(400, 406)) and got[404][1] == got[405][1] == ["empty"]


def test_fertility_bands_equal_brute_force(spark):
    """Medians, smoothing over lengths and limits, from the measures of the documents."""
    rng = random.Random(6)
    texts = [h.sentence(rng, "en" if i % 3 else "de", rng.choice((1, 3, 8, 30, 90))) for i in range(150)] + ["the " * 50, "★" * 30]
    d = h.documents(spark, texts, ["en" if i % 3 else "de" for i in range(152)])
    rows = fertility.measures(d).toPandas().sort_values("doc_id").reset_index(drop=True)
    step = np.floor(4 * np.log2(rows["piece_tokens"] + 1.0)).astype(int)
    want = [[] for _ in texts]
    for v in fertility.VOCABULARIES:
        for c, (fixed, falling) in fertility.RULES.items():
            x = rows[f"{v}_entropy"] / np.log2(rows[f"{v}_tokens"] + 1.0) if c == "evenness" else rows[f"{v}_{c}"]
            width = 0.01 if c == "chars_per_token" else 0.001

            def smooth(values):
                cells = {}
                for band, s, y in zip(rows["band"], step, values):
                    cells.setdefault((band, s), []).append(math.floor(y / width))
                mid = {k: (len(y), (sorted(y)[(len(y) - 1) // 2] + 0.5) * width) for k, y in cells.items()}
                near = lambda k: [(n * 2.0 ** (-abs(k[1] - s) / 3), m) for (b, s), (n, m) in mid.items() if b == k[0]]
                return np.array([sum(w * m for w, m in near(k)) / sum(w for w, _ in near(k)) for k in zip(rows["band"], step)])

            mid = smooth(x)
            off = smooth(np.abs(x - mid))
            gap = x - mid if c == "byte_share" else np.abs(x - mid)
            for i in np.flatnonzero(gap > 5 * 1.4826 * (off + fixed + falling / rows[f"{v}_tokens"])):
                want[i].append(f"{v}_{c}")
    got = {r["doc_id"]: sorted(r["reasons"]) for r in fertility.judge(d).collect()}
    assert got == {i: sorted(x) for i, x in enumerate(want)} and any(want)


def test_unknown_language_goes_by_script():
    assert fertility.script("hello мир мир мир") == "cyrillic" and fertility.script("123") == "none"
