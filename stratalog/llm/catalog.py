"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: module, query
OPERATORS = (
    ("quality_rules", "op1_quality_rules"),
    ("license_scan", "op2_license_scan"),
    ("bin_packing", "op3_best_fit_packing"),
    ("chat_format", "op4_chat_formatting"),
    ("toxicity", "op5_toxicity"),
    ("substring_dedup", "op6_substring_dedup"),
    ("jaccard_join", "op7_ngram_jaccard_join"),
    ("byte_bpe", "op8_byte_bpe"),
    ("quality_classifier", "op9_quality_classifier"),
    ("nearest", "op10_nearest_neighbours"),
)


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for module, name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    sql = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for module, name in OPERATORS}
    return {k: v for k, v in sql.items() if v}
