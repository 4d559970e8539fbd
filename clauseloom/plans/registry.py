"""Collects the query registrations of all operator modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q_functions", "q_matching", "q_search", "q_tables", "q_records", "q_structure", "q_provenance", "q_streams"]


def _books():
    return [import_module(f"{__package__}.{m}").book for m in MODULES]


def queries() -> dict:
    return {k: f for b in _books() for k, f in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for b in _books() for k, s in b.oracles.items()}
