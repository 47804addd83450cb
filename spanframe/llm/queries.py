"""Loads every operator and hands out the registered queries."""

from __future__ import annotations

import importlib

from spanframe.llm import registry

MODULES = ("piece_codec", "licenses", "exact_dedup", "html_text", "simhash", "multi_index", "line_dedup", "packing", "quality", "chat", "divergence", "lexical", "collocations")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"spanframe.llm.{name}")
    pipeline = importlib.import_module("corpus_pipeline")  # stands at the top of the repository
    registry.QUERIES["pipeline"] = pipeline.run
    if pipeline.ORACLE_SQL is not None:
        registry.ORACLES["pipeline"] = pipeline.ORACLE_SQL


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(registry.ORACLES)
