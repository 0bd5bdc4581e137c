"""Registered queries by area."""

from __future__ import annotations

import importlib

from furlong.catalog import registry

AREAS = [
    "chance_queries", "relative_queries", "encode_queries", "settle_queries", "ledger_queries", "evaluate_queries",
    "text_queries", "source_queries", "stream_queries", "fit_queries",
]


def load() -> tuple[dict, dict]:
    for area in AREAS:
        importlib.import_module(f"furlong.catalog.{area}")
    return registry.QUERIES, registry.ORACLE
