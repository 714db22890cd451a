"""Operators for preparing the training data of language models."""

from __future__ import annotations

import importlib

#: Modules that hold one operator each, with its QUERIES and ORACLES.
MODULES = ("token_counts", "packing", "quality", "line_dedup", "sharding", "bpe", "fingerprints", "licenses", "substrings", "jaccard")


def registered(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"quarry.llm.{name}"), what)
    return out
