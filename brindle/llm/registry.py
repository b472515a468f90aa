"""Queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from brindle.llm.base import table


def op1_katz_scores(spark, sf_dir):
    from brindle.llm import katz

    return katz.score(table(spark, sf_dir, "documents"))


def op2_licence_scan(spark, sf_dir):
    from brindle.llm import licences

    return licences.scan(table(spark, sf_dir, "documents"))


def op3_merge_dropout(spark, sf_dir):
    from brindle.llm import dropout

    return dropout.encode_documents(table(spark, sf_dir, "documents"))


def op4_exact_digest(spark, sf_dir):
    from brindle.llm import digest

    return digest.exact_groups(table(spark, sf_dir, "documents"))


def op5_importance_resampling(spark, sf_dir):
    from brindle.llm import quality

    return quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality.TARGET)


def op6_hilbert_packing(spark, sf_dir):
    from brindle.llm import hilbert

    return hilbert.pack(table(spark, sf_dir, "documents"))


def op7_language_mixture(spark, sf_dir):
    from brindle.llm import langid

    return langid.detect(table(spark, sf_dir, "documents"))


def op8_tokeniser_fertility(spark, sf_dir):
    from brindle.llm import fertility

    return fertility.judge(table(spark, sf_dir, "documents"))


def op9_sanitised_documents(spark, sf_dir):
    from brindle.llm import pii

    return pii.clean_documents(table(spark, sf_dir, "documents"))


def op10_minhash_groups(spark, sf_dir):
    from brindle.llm import minhash

    return minhash.near_groups(table(spark, sf_dir, "documents"))


_SQL = {
    # DuckDB has NFC but no compatibility form or full case folding; on texts without such characters they agree
    "op4_exact_digest": """
        WITH c AS (SELECT doc_id, trim(regexp_replace(nfc_normalize(lower(coalesce(text, ''))), '\\s+', ' ', 'g')) AS canon FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS group_id, count(*) OVER w AS copies, row_number() OVER (PARTITION BY canon ORDER BY doc_id NULLS LAST) = 1 AS keep
        FROM c WINDOW w AS (PARTITION BY canon)""",
}


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql():
    return dict(_SQL)
