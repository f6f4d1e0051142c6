"""Registered queries and their SQL twins."""

from __future__ import annotations

from slicewright.plans import catalogue, datawork, files, masks, scalars, supervise

MODULES = [masks, scalars, catalogue, supervise, datawork, files]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
