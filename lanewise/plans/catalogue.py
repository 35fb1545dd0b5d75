"""The registry: name -> query, and name -> oracle SQL."""

from __future__ import annotations

from lanewise.plans import evaluation, further, operations, streams, verification

_MODULES = [verification, evaluation, operations, streams, further]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
