"""The registered queries of the corpus operators."""

from __future__ import annotations

from . import chat, decontamination, langid, line_dedup, minhash_dedup, mixing, span_dedup, tokens, url_filter, vector_dedup

_MODULES = {"op1_line_dedup": line_dedup, "op2_minhash_dedup": minhash_dedup, "op3_language_id": langid, "op4_decontamination": decontamination, "op5_token_counts": tokens, "op6_vector_dedup": vector_dedup, "op7_span_dedup": span_dedup, "op8_mix_sources": mixing, "op9_url_filter": url_filter, "op10_chat_format": chat}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in _MODULES.items() if hasattr(module, "ORACLE")}
