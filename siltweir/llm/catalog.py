"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

MODULES = ("split_groups", "look", "overlap", "body", "charset", "residue", "packing", "mixing", "pieces")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"siltweir.llm.{m}"), name, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
