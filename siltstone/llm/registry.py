"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

import importlib

MODULES = ("provenance", "docpairs", "credentials", "spans", "neardup", "parsing", "tokenize", "packing", "quality")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"siltstone.llm.{name}"), attribute)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
