"""Named queries over the test tables, each with SQL that DuckDB can run."""

from __future__ import annotations

import importlib

FLAGSHIP = "bm25_calibrated"
MODULES: tuple[str, ...] = ("q_text", "q_urls", "q_rank", "q_pages", "q_state", "q_verify", "q_sources", "q_search", "q_result_pages")


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"quarry.plans.{name}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
