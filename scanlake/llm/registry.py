"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from scanlake.llm import imatch, language, mixing, packing, pii, quality, simhash, suffix_dedup, toxicity, url_filter

_MODULES = {
    "op1_suffix_dedup": suffix_dedup,
    "op2_simhash": simhash,
    "op3_url_filter": url_filter,
    "op4_toxicity": toxicity,
    "op5_mixing": mixing,
    "op6_language": language,
    "op7_quality": quality,
    "op8_imatch": imatch,
    "op9_pii": pii,
    "op10_packing": packing,
}


def queries():
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql():
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
