"""All registered queries of the core and their SQL."""

from __future__ import annotations

from . import aggregates, expanding, graphs, joins, linking, problem4, ranking, resolution, roles, sources, streams

MODULES = (problem4, sources, joins, linking, aggregates, expanding, graphs, ranking, resolution, roles, streams)


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracles() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.ORACLES
    return out
