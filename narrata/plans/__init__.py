"""Queries by area; `load` imports them all."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """All queries and the SQL that checks them."""
    from . import checks, files, publish, registry, rules, series, signals, similar, text, volume  # noqa: F401

    return dict(registry.QUERIES), dict(registry.ORACLE_SQL)
