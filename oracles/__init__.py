"""Independent SQL for the registered queries, run by DuckDB on the same tables."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("relational", "access", "requests", "evaluation", "merge", "corpus")


def all_sql() -> dict[str, str]:
    """Every check query; ``@name`` stands for a source table or adapter view."""
    found: dict[str, str] = {}
    for module in _MODULES:
        found.update(import_module(f"oracles.{module}").SQL)
    return found
