"""Named queries over the test tables, each with the same result written in SQL where possible."""

from __future__ import annotations

from tableloom.registry import generation, relational, storage, text

MODULES = (relational, generation, text, storage)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
