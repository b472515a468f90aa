"""Operator 2, licence scans by a positional rare-token index.

The index has postings (template, position) of licence words. A word's weight is its inverse document frequency over the whole corpus, and
each template is indexed under its anchors: of the words of its mandatory phrases, those of highest weight. A document looks up the
anchors it holds; a posting and the place in the document give a relative position, and a template is a candidate where all its anchors
fall on one relative position, give or take ``slack`` words. It counts if enough of its words agree along that position and each
mandatory phrase stands where it should, word for word. As anchors are mandatory, the look-up loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.textvec import Tokens, clean, slabs

ANCHORS, SLACK, COVERAGE = 4, 3, 0.75

#: licence, notice, mandatory phrases. The notices are the usual short forms.
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("Apache License", "Version 2.0")),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache.org/licenses/LICENSE-2.0",)),
    ("MIT", "Released under the MIT License", ("MIT License",)),
    ("MIT", "Licensed under the MIT License", ("MIT License",)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("free of charge", "associated documentation files")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ("GNU General Public License", "version 3")),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("GNU General Public License", "version 3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2", ("GNU General Public License", "version 2")),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("GNU General Public License", "version 2")),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", ("GNU Lesser General Public License", "version 2.1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3", ("GNU Lesser General Public License", "version 3")),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("GNU Affero General Public License", "version 3")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3", ("GNU Affero General Public License", "version 3")),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License", "2.0")),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("Creative Commons Attribution 4.0",)),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", ("CC BY 4.0",)),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ("CC BY-SA 4.0",)),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ("CC BY-NC 4.0",)),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("Creative Commons Attribution-NonCommercial 4.0",)),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright", "neighboring rights")),
    ("Unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)


def word_hashes(text: str) -> np.ndarray:
    return Tokens([text]).hash


@dataclass
class Index:
    names: list[str]
    words: list[np.ndarray]  # of each template
    phrases: list[list[tuple[int, np.ndarray]]]  # place in the template and words
    vocabulary: np.ndarray  # sorted distinct words of all templates
    anchors: list[np.ndarray]  # positions of each template's anchors
    postings: dict[int, list[tuple[int, int]]]  # anchor word -> (template, position)
    anchor_words: np.ndarray


def base_index(templates=TEMPLATES) -> Index:
    words = [word_hashes(t) for _, t, _ in templates]
    phrases = []
    for w, (_, _, said) in zip(words, templates):
        of = [word_hashes(x) for x in said]
        phrases.append([(next(i for i in range(len(w)) if np.array_equal(w[i : i + len(p)], p)), p) for p in of])
    return Index([n for n, _, _ in templates], words, phrases, np.unique(np.concatenate(words)), [], {}, np.empty(0, np.uint64))


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """In how many documents each word of the (fixed) vocabulary occurs, over all documents."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(vocabulary), np.int64)
        for p in parts:
            texts = clean(p["text"])
            for a, b in slabs(texts):
                tok = Tokens(texts[a:b])
                at = np.minimum(np.searchsorted(vocabulary, tok.hash), len(vocabulary) - 1)
                hit = vocabulary[at] == tok.hash
                both = np.unique(tok.doc[hit] * len(vocabulary) + at[hit])
                n += np.bincount(both % len(vocabulary), minlength=len(vocabulary))
        yield pd.DataFrame({"word": np.arange(len(vocabulary)), "n": n})

    df = np.zeros(len(vocabulary), np.int64)
    for r in docs.select("text").mapInPandas(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        df[r["word"]] = r["n"]
    return df


def with_anchors(index: Index, df: np.ndarray, anchors: int = ANCHORS) -> Index:
    """Index each template under the ``anchors`` rarest distinct words of its phrases, the rarest first, ties by place."""
    index.anchors, index.postings = [], {}
    for t, words in enumerate(index.words):
        places = sorted({i + j for i, p in index.phrases[t] for j in range(len(p))})
        seen = df[np.searchsorted(index.vocabulary, words)]
        at = []
        for i in sorted(places, key=lambda i: (seen[i], i)):
            if len(at) < anchors and words[i] not in words[at]:
                at.append(i)
        index.anchors.append(np.array(at))
        for i in at:
            index.postings.setdefault(int(words[i]), []).append((t, i))
    index.anchor_words = np.array(sorted(index.postings), np.uint64)
    return index


def coverage(words: np.ndarray, at: int, template: np.ndarray, slack: int) -> float:
    """Share of the template's words that the document has at the relative position ``at``, give or take ``slack``."""
    return sum(x in words[max(0, at + i - slack) : max(0, at + i + slack + 1)] for i, x in enumerate(template)) / len(template)


def has_phrases(words: np.ndarray, at: int, phrases: list[tuple[int, np.ndarray]], slack: int) -> bool:
    """Whether each phrase stands at its place, give or take ``slack``."""
    return all(any(np.array_equal(words[max(0, k) : k + len(p)], p) for k in range(max(0, at + i - slack), at + i + slack + 1)) for i, p in phrases)


def scan_document(index: Index, words: np.ndarray, places: np.ndarray, slack: int, least: float) -> list[tuple[str, int, float]]:
    """(licence, place, coverage) from the ``places`` of anchor words in a document."""
    near: dict[tuple[int, int], list[int]] = {}
    for p in places.tolist():
        for t, i in index.postings[int(words[p])]:
            near.setdefault((t, i), []).append(p - i)
    found: list[tuple[int, int, float]] = []
    for t in {t for t, _ in near}:
        template = index.words[t]
        diagonals = [np.array(near.get((t, i), [])) for i in index.anchors[t].tolist()]
        if any(not len(d) for d in diagonals):
            continue
        best = []
        for x in sorted({int(d) + s for d in diagonals[0] for s in range(-slack, slack + 1)}):
            if all((np.abs(d - x) <= slack).any() for d in diagonals[1:]):
                share = coverage(words, x, template, slack)
                if share >= least and has_phrases(words, x, index.phrases[t], slack):
                    best.append((-share, -coverage(words, x, template, 0), x))
        # of places that overlap, the one that agrees most
        for share, _, x in sorted(best):
            if not any(n == t and abs(x - y) < len(template) for n, y, _ in found):
                found.append((t, x, -share))
    out: dict[tuple[str, int], float] = {}
    for t, x, share in found:
        k = (index.names[t], max(0, x))
        out[k] = max(out.get(k, 0.0), share)
    return [(n, x, share) for (n, x), share in out.items()]


def scan(docs: DataFrame, templates=TEMPLATES, anchors: int = ANCHORS, slack: int = SLACK, least: float = COVERAGE) -> DataFrame:
    """One row for each licence of a document: doc_id, licence, places, first_word (of the first place), coverage (of the best).

    A document without a licence, a null or empty one included, has no row. Rows with one id are scanned each and
    have rows each. An empty table gives no rows."""
    index = base_index(templates)
    index = with_anchors(index, document_frequencies(docs, index.vocabulary), anchors)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rare = index.anchor_words
        for p in parts:
            out = []
            texts, ids = clean(p["text"]), p["doc_id"].astype("Int64").to_numpy(object, na_value=None)
            for a, b in slabs(texts):
                tok = Tokens(texts[a:b])
                at = np.minimum(np.searchsorted(rare, tok.hash), len(rare) - 1)
                hit = np.flatnonzero(rare[at] == tok.hash)
                edge = np.searchsorted(hit, tok.first)
                for d in np.flatnonzero(np.diff(edge)):
                    lo, hi = tok.first[d], tok.first[d + 1]
                    seen: dict[str, list[tuple[int, float]]] = {}
                    for name, place, share in scan_document(index, tok.hash[lo:hi], hit[edge[d] : edge[d + 1]] - lo, slack, least):
                        seen.setdefault(name, []).append((place, share))
                    out += [(ids[a + d], name, len(v), min(v)[0], max(s for _, s in v)) for name, v in sorted(seen.items())]
            yield pd.DataFrame(out, columns=["doc_id", "licence", "places", "first_word", "coverage"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, licence string, places long, first_word long, coverage double")
