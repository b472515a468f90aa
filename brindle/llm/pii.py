"""Operator 9, sanitising personal data by information content.

Protected entities (addresses, numbers, secrets) are found by their form and always replaced by the name of
their kind. Words that occur in the same documents as an entity may give it away as well: over the whole corpus, a term's pointwise
mutual information with the entity is compared with the entity's information content. Documents, whole ones, are the unit of all
counts. The ratio is 1 where the term tells the entity for sure. Above ``remove`` the term is taken out, above ``general`` it is
replaced by the class of its form, in the documents that hold the entity.
"""

from __future__ import annotations

import functools
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from brindle.llm.base import bit_filter, in_filter, materialise, temp_name
from brindle.llm.textvec import Tokens, clean, slabs

WINDOW, GENERAL, REMOVE = 8, 0.8, 0.95
SLICE_BYTES = 1 << 20  # of text that becomes strings at a time; a longer text is alone in its slice, whole
_FORMS = {
    "EMAIL": r"[\w.+%-]++@[\w-]+(?:\.[\w-]+)+",
    "KEY": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b|-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)",
    "SECRET": r"(?<=[=:\"'])[0-9a-fA-F]{32,64}\b",
    "IP": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)",
    "CARD": r"(?<![\w.])(?:\d{14,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w]|\.\d)",
    "SSN": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "PHONE": r"(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)|(?<!\w)(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w)",
    "IBAN": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
}
_NUMBERS = ("IP", "CARD", "SSN", "PHONE", "IBAN")
_ANY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in _FORMS.items()))
_DIGIT, _SECRET_START = re.compile(r"\d"), re.compile(r"[=:\"'][0-9a-fA-F]{32}")
_NUMBER_START = re.compile(r"\d(?:\d\d|\.\d)|\+\d|[A-Z]{2}\d{2}")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def valid(kind: str, s: str) -> bool:
    """Numbers that only look like an entity are left alone: cards need their check digit, addresses octets below 256."""
    if kind == "CARD":
        return luhn(re.sub(r"\D", "", s))
    if kind == "IP":
        try:
            ipaddress.IPv4Address(s)
        except ValueError:
            return False
    if kind == "IBAN":
        t = s.replace(" ", "")
        return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1
    return True


def possible(text: str) -> tuple[str, ...]:
    """The forms that may match: each is left out only if the text lacks what it can't match without."""
    out = ()
    if "@" in text:
        out += ("EMAIL",)
    if "AKIA" in text or "ASIA" in text or "sk-" in text or "PRIVATE KEY" in text or ("gh" in text and "_" in text):
        out += ("KEY",)
    if _SECRET_START.search(text):
        out += ("SECRET",)
    if _DIGIT.search(text) and _NUMBER_START.search(text):
        out += _NUMBERS
    return out


@functools.lru_cache(16)
def _pattern(kinds: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{k}>{_FORMS[k]})" for k in kinds))


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each entity, from left to right without overlap."""
    kinds = possible(text)
    return [(m.start(), m.end(), m.lastgroup) for m in _pattern(kinds).finditer(text) if valid(m.lastgroup, m.group())] if kinds else []


def _h(b: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b) - (1 << 63)


def entity_hash(s: str) -> int:
    return _h(re.sub(r"\s+", " ", s.lower()).encode("utf-8", "surrogatepass"))


def term_hash(word: str) -> int:
    """The number that stands for a word, in tables and maps."""
    return int(Tokens([word], fold=True).hash.view(np.int64)[0])


def text_key(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _free(tok: Tokens, spans: list[tuple[int, int, str]]) -> np.ndarray:
    """Which words lie outside all entities."""
    if not spans:
        return np.ones(len(tok.start), bool)
    a, b = (np.array([s[i] for s in spans]) for i in (0, 1))
    at = np.searchsorted(b, tok.start, "right")  # the first entity that ends after the word begins
    return (at == len(b)) | (a[np.minimum(at, len(b) - 1)] >= tok.end)


def facts_of(text: str, window: int) -> tuple[list[int], list[int], np.ndarray] | None:
    """(entities, setting of each, distinct words) of a document with entities. An entity's setting is a hash of the ``window`` words on either
    side of its first occurrence, without those of entities: copies of a passage are one setting."""
    spans = entities(text)
    if not spans:
        return None
    tok = Tokens([text], fold=True)
    free, seen = _free(tok, spans), {}
    for a, b, _ in spans:
        e = entity_hash(text[a:b])
        if e not in seen:
            i, j = np.searchsorted(tok.start, a), np.searchsorted(tok.start, b)
            near = np.concatenate((np.arange(max(0, i - window), i), np.arange(j, min(len(free), j + window))))
            seen[e] = _h(tok.hash[near[free[near]]].tobytes())
    return list(seen), list(seen.values()), np.unique(tok.hash).view(np.int64)


def facts(docs: DataFrame, window: int) -> DataFrame:
    """(text_key, low: its first 8 bytes as a number, entities, settings, terms) of each document that has entities."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [(k := text_key(t), int.from_bytes(k[:8], "little", signed=True), *f) for t in p["text"] if isinstance(t, str) and (f := facts_of(t, window))]
            yield pd.DataFrame(out, columns=["text_key", "low", "entities", "settings", "terms"])

    return docs.select("text").mapInPandas(run, "text_key binary, low long, entities array<long>, settings array<long>, terms array<long>")


def _document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) over all documents, of the words in ``terms``: each slab of texts counts what a fixed-size filter lets through."""
    on = docs.sparkSession.sparkContext.broadcast(bit_filter(terms))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = clean(p["text"])
            for a, b in slabs(texts):
                tok = Tokens(texts[a:b], fold=True)
                some = np.flatnonzero(in_filter(on.value, tok.hash))
                h, d = tok.hash[some], tok.doc[some]
                by = np.lexsort((d, h))
                h, d = h[by], d[by]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.empty(0, bool)
                words, n = np.unique(h[new], return_counts=True)
                yield pd.DataFrame({"term": words.view(np.int64), "df": n})

    return docs.select("text").mapInPandas(run, "term long, df long").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))


def _pairs(known: DataFrame, entities: DataFrame) -> DataFrame:
    """(text_key, low, setting, entity, n_entity, term) of the entities in ``entities`` and the words of their documents."""
    each = known.select("text_key", "low", F.explode(F.arrays_zip("entities", "settings")).alias("x"), "terms").select("text_key", "low", F.col("x.entities").alias("entity"), F.col("x.settings").alias("setting"), "terms")
    return each.join(entities, "entity").select("text_key", "low", "setting", "entity", "n_entity", F.explode("terms").alias("term"))


def disclosing(docs: DataFrame, known: DataFrame, general: float = GENERAL, remove: float = REMOVE) -> tuple[DataFrame, DataFrame]:
    """((entity, n_entity) of the entities seen in two different settings; (entity, term, both, df, ratio, action) of the terms that give one away).

    A pair counts only if it was seen in two different settings: in one setting every word beside an entity would tell it. Counts
    are numbers of documents, however often a document repeats entity or term."""
    two = F.col("low") < F.col("high")
    of = known.select(F.explode(F.arrays_zip("entities", "settings")).alias("x")).select(F.col("x.entities").alias("entity"), F.col("x.settings").alias("setting"))
    often = materialise(of.groupBy("entity").agg(F.count("*").alias("n_entity"), F.min("setting").alias("low"), F.max("setting").alias("high")).where(two).select("entity", "n_entity"), "pii-entities")
    joint = _pairs(known, often).groupBy("entity", "term").agg(F.count("*").alias("both"), F.min("setting").alias("low"), F.max("setting").alias("high"), F.max("n_entity").alias("n_entity")).where(two).drop("low", "high")
    joint = materialise(joint, "pii-joint")
    terms = joint.select("term").distinct()
    if terms.isEmpty():
        return often, joint.select("entity", "term", "both", F.lit(0).cast("long").alias("df"), F.lit(0.0).alias("ratio"), F.lit("").alias("action"))
    n = F.lit(float(docs.count()))
    pmi = F.log2(F.col("both") * n / (F.col("n_entity") * F.col("df")))
    content = F.log2(n / F.col("n_entity"))
    j = joint.join(_document_counts(docs, terms), "term").withColumn("ratio", F.when(content > 0, pmi / content).otherwise(0.0)).where(F.col("ratio") >= general)
    return often, materialise(j.select("entity", "term", "both", "df", "ratio", F.when(F.col("ratio") >= remove, "remove").otherwise("general").alias("action")), "pii-terms")


def term_class(s: str) -> str:
    return "[NUMBER]" if any(c.isdigit() for c in s) else "[NAME]" if s[:1].isupper() else "[TERM]"


def sanitise(text: str, terms: dict[int, str]) -> tuple[str, list[str], int]:
    """(text with its entities replaced and ``terms``, by hash, generalised or removed; kinds replaced; words changed)."""
    spans = entities(text)
    edits = [(a, b, f"[{kind}]") for a, b, kind in spans]
    if terms:
        tok = Tokens([text], fold=True)
        hashes = tok.hash.view(np.int64)
        for i in np.flatnonzero(np.isin(hashes, np.fromiter(terms, np.int64, len(terms))) & _free(tok, spans)).tolist():
            a, b = int(tok.start[i]), int(tok.end[i])
            edits.append((a, b, "" if terms[int(hashes[i])] == "remove" else term_class(text[a:b])))
        edits.sort()
    out, at = [], 0
    for a, b, new in edits:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]) if edits else text, [k for _, _, k in spans], len(edits) - len(spans)


def _added(docs: DataFrame) -> tuple[str, str]:
    return temp_name(docs, "kinds"), temp_name(docs, "n_terms")


def _keys(b: pa.RecordBatch) -> list[bytes]:
    """``text_key`` of each text, from its bytes as they lie in the batch."""
    return [xxhash.xxh3_128_digest(t) if t is not None else b"\0" * 16 for t in (x.as_buffer() for x in b.column("text"))]


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``b`` in runs of rows with about ``SLICE_BYTES`` of text each."""
    size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // SLICE_BYTES
    edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    yield from (b.slice(i, j - i) for i, j in zip(edge, edge[1:]))


def _may(on: np.ndarray, keys: list[bytes]) -> np.ndarray:
    return in_filter(on, np.frombuffer(b"".join(keys), np.uint64)[::2].copy())


def _rewritten(docs: DataFrame, drop: tuple[str, ...] = (), maps: str | None = None, held=None) -> DataFrame:
    """``docs`` with text sanitised and two columns more, kinds and n_terms. ``maps`` names the column of each row's terms; ``held`` is a filter of
    texts that are done elsewhere and left out here. Other columns pass through as Arrow arrays, untouched."""
    out = StructType([f for f in docs.schema.fields if f.name not in drop] + [StructField(n, t) for n, t in zip(_added(docs), (ArrayType(StringType()), LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in _slices(whole)):
            if held is not None:
                b = b.filter(pa.array(~_may(held.value, _keys(b)), pa.bool_()))
            told = [dict(m) if m else {} for m in b.column(maps).to_pylist()] if maps else [{}] * b.num_rows
            res = [sanitise(t, m) if t is not None else (None, [], 0) for t, m in zip(b.column("text").to_pylist(), told)]
            cols = {n: b.column(n) for n in b.schema.names if n not in drop}
            cols["text"] = pa.array([r[0] for r in res], pa.string())
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array([r[1] for r in res], pa.list_(pa.string())), pa.array([r[2] for r in res], pa.int64())], names=out.names)

    return docs.mapInArrow(run, out)


def _maps(known: DataFrame, often: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_key, low: its first 8 bytes, map: the text's terms and what becomes of them) of the texts that have any."""
    pairs = _pairs(known, often).join(terms.select("entity", "term", "action"), ["entity", "term"]).groupBy("text_key", "term").agg(F.max("action").alias("action"), F.max("low").alias("low"))
    return materialise(pairs.groupBy("text_key").agg(F.max("low").alias("low"), F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("map")), "pii-maps")


def _cleaned(docs: DataFrame, window: int = WINDOW, general: float = GENERAL, remove: float = REMOVE) -> DataFrame:
    """``docs`` sanitised, with kinds and n_terms. Only texts with terms to change, found by a fixed-size filter of their digests, go
    through a join; the others are rewritten as they are read."""
    known = materialise(facts(docs, window), "pii-facts")
    often, terms = disclosing(docs, known, general, remove)
    maps = _maps(known, often, terms)
    on = bit_filter(maps.select("low"))
    if on is None:
        return _rewritten(docs)
    held = docs.sparkSession.sparkContext.broadcast(on)
    key, told, name = (temp_name(docs, c) for c in ("_text_key", "_told", "_terms"))
    schema = StructType([*docs.schema.fields, StructField(key, BinaryType())])

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _keys(b)
            mask = _may(held.value, keys)
            few = b.filter(pa.array(mask, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*few.columns, pa.array([k for k, m in zip(keys, mask) if m], pa.binary())], names=[*few.schema.names, key])

    few = docs.mapInArrow(suspected, schema)
    known_few = few.join(maps.select(F.col("text_key").alias(told), F.col("map").alias(name)), F.col(key) == F.col(told), "left").drop(told)
    return _rewritten(docs, held=held).unionByName(_rewritten(known_few, (key, name), name))


def clean_documents(docs: DataFrame, **params) -> DataFrame:
    """One row a document: doc_id, text (sanitised), kinds (of the entities replaced, in order), n_terms (words changed).

    A null text stays null and an empty one empty. A text without entities isn't touched. Rows with one id are
    cleaned each, equal texts alike; an empty table gives no rows."""
    return _cleaned(docs.select("doc_id", "text"), **params)


def clean_columns(docs: DataFrame, **params) -> DataFrame:
    """Pipeline form: the documents with their columns, text sanitised and n_chars (if there is one) its new length."""
    out = _cleaned(docs, **params).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
