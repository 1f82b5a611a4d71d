"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

from .sql import ORACLES

#: Query name and the module that holds it.
QUERIES = {
    "op1_best_fit_packing": "packing",
    "op2_pii_spans": "pii",
    "op3_license_notices": "licenses",
    "op4_suffix_tree_scores": "suffix_tree",
    "op5_language_id": "language",
    "op6_warc_round_trip": "warc",
    "op7_near_duplicates": "near_dups",
    "op8_benchmark_passages": "decontaminate",
    "op9_imatch": "imatch",
    "op10_token_counts": "token_count",
    "op11_vector_codes": "vector_codes",
    "op12_ngram_jaccard": "partenum",
    "op13_phrase_collocations": "collocations",
}


def queries():
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in QUERIES.items()}


def oracles():
    return {name: sql.strip() for name, sql in ORACLES.items()}
