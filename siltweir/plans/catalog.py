"""All queries of the core with their SQL."""

from __future__ import annotations

import importlib

MODULES = ("q_url", "q_relational", "q_eval", "q_text", "q_drift", "q_page", "q_models", "q_stream", "q_more")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"siltweir.plans.{m}"), name, {})
    return out


def flagship(spark, sf_dir):
    from siltweir.plans import q_url

    return q_url.url_fuzzy(spark, sf_dir)


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
