"""Queries and SQL of the core operators, by name."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = (
    "operators.hygiene",
    "operators.structure",
    "operators.repomap",
    "operators.clones",
    "operators.increment",
    "operators.doclinks",
    "operators.history",
    "operators.metrics",
    "operators.markdown",
    "operators.crossfile",
    "operators.prompt_rules",
    "operators.suppression",
    "operators.project",
    "operators.fixers",
    "operators.reports",
)


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"siltstone.{name}"), attribute)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
