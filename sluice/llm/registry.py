"""Queries of this subpackage, and the SQL that states them where SQL can."""

from __future__ import annotations

from importlib import import_module

_QUERIES = {
    "op1_mix_sources": "mixing",
    "op2_toxicity": "toxicity",
    "op3_substring_dedup": "substrings",
    "op4_lm_score": "maxent",
    "op5_topk_exact": "topk",
    "op6_pii": "pii",
    "op7_decontaminate": "decontaminate",
    "op8_ngram_jaccard": "jaccard",
    "op9_url_filter": "urls",
    "op10_license_scan": "licenses",
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f".{module}", __package__), "ORACLE", None) for name, module in _QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
