"""The registered queries and the SQL that they are checked against."""

from __future__ import annotations

from docnav.plans import evaluating, retrieval, runs, scoring

_PARTS = (retrieval, scoring, runs, evaluating)


def queries() -> dict:
    return {f.__name__: f for part in _PARTS for f in part.QUERIES}


def oracle_sql() -> dict:
    return {k: s for part in _PARTS for k, s in part.ORACLES.items() if s}
