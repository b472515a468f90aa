"""Collects the queries of the plan modules."""

from __future__ import annotations

import importlib

_NAMES = ("customer_queries", "relational_queries", "commerce_queries", "quality_queries", "statistics_queries", "text_queries", "storage_queries", "diagnostic_queries")


def _books():
    return [importlib.import_module(f"brindle.plans.{n}").book for n in _NAMES]


def flagship(spark, sf_dir):
    return queries()["cai_features"](spark, sf_dir)


def queries():
    return {k: f for b in _books() for k, f in b.queries.items()}


def oracle_sql():
    return {k: s for b in _books() for k, s in b.oracle.items()}
