"""All registered queries of the engine by name."""

from __future__ import annotations

from . import reference


def queries() -> dict:
    return dict(reference.QUERIES)


def oracle_sql() -> dict:
    return dict(reference.ORACLE)
