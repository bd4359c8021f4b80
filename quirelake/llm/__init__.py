"""Operators for large training corpora. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib

#: Query name -> (module, function). A module's SQL, where it has one, is the query's oracle.
REGISTERED = {
    "op1_substring_dedup": ("substring_dedup", "op1"),
    "op2_license_scan": ("license_scan", "op2"),
    "op3_topk_search": ("topk_search", "op3"),
    "op4_mix_sources": ("mixing", "op4"),
    "op5_line_dedup": ("line_dedup", "op5"),
    "op6_byte_bpe": ("byte_bpe", "op6"),
    "op7_hash_ring": ("hash_ring", "op7"),
    "op8_jaccard_join": ("jaccard_join", "op8"),
    "op9_embedding_dedup": ("embedding_dedup", "op9"),
    "op10_language_id": ("language_id", "op10"),
}


def _module(name: str):
    return importlib.import_module(f"{__name__}.{name}")


def queries():
    return {k: getattr(_module(m), f) for k, (m, f) in REGISTERED.items()}


def oracle_sql():
    return {k: sql for k, (m, _) in REGISTERED.items() if (sql := getattr(_module(m), "SQL", None))}
