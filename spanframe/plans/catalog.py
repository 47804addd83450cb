"""All registered queries, by operator id."""

from __future__ import annotations

import importlib

from spanframe.plans import registry

FAMILIES = (
    "interval_queries",
    "budget_queries",
    "sequence_queries",
    "stats_queries",
    "cohort_queries",
    "audit_queries",
    "region_queries",
    "metric_queries",
    "box_queries",
    "source_queries",
)


def _load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"spanframe.plans.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLES)
