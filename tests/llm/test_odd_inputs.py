"""Every operator on odd rows and on an empty table: a row a document where it promises one, no crash, no lost row."""

import pytest

from brindle.llm import digest, dropout, fertility, hilbert, katz, langid, licences, minhash, pii, quality
from tests.llm import helpers as h


def lab(spark):
    return h.labels(spark, [(0, 1, 0), (4, 1, 0), (5, 0, 0), (None, 1, 1), (6, None, 0), (0, 0, 0)])


ROW_A_DOCUMENT = {
    "katz": katz.score,
    "dropout": dropout.encode_documents,
    "digest": digest.exact_groups,
    "quality": lambda d: quality.select(d, lab(d.sparkSession)),
    "langid": langid.detect,
    "fertility": fertility.judge,
    "pii": pii.clean_documents,
    "minhash": minhash.near_groups,
}
PIPELINE = {"quality": lambda d: quality.keep_selected(d, lab(d.sparkSession)), "langid": langid.keep_identified, "minhash": minhash.keep_one, "pii": pii.clean_columns}


@pytest.mark.parametrize("name", ROW_A_DOCUMENT)
def test_one_row_a_document(spark, name):
    d = h.odd(spark)
    got = ROW_A_DOCUMENT[name](d).select("doc_id").toPandas()["doc_id"]
    want = d.select("doc_id").toPandas()["doc_id"]
    assert sorted(got.fillna(-1)) == sorted(want.fillna(-1))


@pytest.mark.parametrize("name", [*ROW_A_DOCUMENT, "hilbert", "licences"])
def test_empty_table(spark, name):
    f = {**ROW_A_DOCUMENT, "hilbert": hilbert.pack, "licences": licences.scan}[name]
    assert f(h.empty(spark)).count() == 0


@pytest.mark.parametrize("name", PIPELINE)
def test_pipeline_forms_keep_columns(spark, name):
    d = h.odd(spark)
    assert PIPELINE[name](d).columns == d.columns
    assert PIPELINE[name](d).count() <= d.count()
    assert PIPELINE[name](h.empty(spark)).count() == 0


def test_licences_and_packing_on_odd_rows(spark):
    assert licences.scan(h.odd(spark)).count() == 0
    got = hilbert.pack(h.odd(spark), capacity=1000).toPandas()
    assert (got["n_tokens"] == 0).sum() == 4 and got[got["doc_id"] == 4]["n_tokens"].sum() == 30_000 + 14


def test_null_text_stays_null_when_cleaned(spark):
    got = {(r["doc_id"], r["text"]) for r in pii.clean_documents(h.odd(spark)).collect()}
    assert (1, None) in got and (2, "") in got
