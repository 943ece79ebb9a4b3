"""Registered queries: one module per area, each with QUERIES and ORACLES."""

from __future__ import annotations


def _modules():
    from barloom.queries import combination, curation, ingest, library, operators, portfolios, scoring, services, storage

    return (curation, operators, scoring, storage, ingest, library, combination, portfolios, services)


def all_queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def all_oracles() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
