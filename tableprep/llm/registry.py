"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ["quality_rules", "chat", "secrets", "warc", "packing", "near_dedup", "decontaminate", "suffix_dedup", "lm_score", "token_counts",
           "importance", "periodic", "html_text"]


def queries():
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in import_module(f"{__package__}.{m}").ORACLE.items()}
