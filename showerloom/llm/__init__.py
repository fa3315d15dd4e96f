"""Operators for building training data; nothing else in the package imports this folder."""

from __future__ import annotations

import importlib

MODULES = ("url_filter", "chat_format", "license_scan", "ann_search", "lm_score", "embedding_dedup", "minhash_dedup", "mixing", "quality_crf", "sentencepiece_lattice", "secret_scan", "whitening")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in importlib.import_module(f"{__name__}.{m}").ORACLE.items()}
