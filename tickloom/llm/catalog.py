"""Registered queries of this subpackage: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ("line_dedup", "packing", "suffix_dedup", "decontamination", "lm_scoring", "quality", "licenses", "sharding",
           "chat", "near_dedup", "records", "vector_codes",
           "alignment")


def entries() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(importlib.import_module(f"tickloom.llm.{m}").QUERIES)
    return out
