"""Training-data operators. Nothing else in the library imports this package."""

from __future__ import annotations

from importlib import import_module

#: The query modules of this subpackage, one per operator.
QUERY_MODULES = ["q_line_dedup", "q_bpe", "q_language_id", "q_ann", "q_chat_format", "q_mixing", "q_minhash_dedup", "q_url_filter", "q_exact_dedup", "q_pii", "q_divergence", "q_vector_codes", "q_token_counts"]


def queries() -> dict:
    found = {}
    for name in QUERY_MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict:
    found = {}
    for name in QUERY_MODULES:
        found |= import_module(f"{__name__}.{name}").ORACLES
    return found
