"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import importlib

#: query name -> (module, function, SQL constant or function; None where SQL can't express it)
_KNOWN = {
    "op1_suffix_dedup": ("suffix", "op1_suffix_dedup", None),
    "op2_substring_dedup": ("substring", "op2_substring_dedup", "OP2_SQL"),
    "op3_decontamination": ("semantic", "op3_decontamination", None),
    "op4_near_dedup": ("bagminhash", "op4_near_dedup", "OP4_SQL"),
    "op5_quality": ("classifier", "op5_quality", None),
    "op6_chat": ("chat", "op6_chat", "oracle_sql"),
    "op7_rules": ("rules", "op7_rules", "oracle_sql"),
    "op8_tokens": ("tokencount", "op8_tokens", None),
    "op9_licenses": ("licenses", "op9_licenses", "oracle_sql"),
    "op10_mixing": ("mixing", "op10_mixing", "OP10_SQL"),
    "op11_bpe": ("bpe", "op11_bpe", None),
    "op12_merkle": ("merkle", "op12_merkle", "OP12_SQL"),
    "op13_hard_negatives": ("balltree", "op13_hard_negatives", "OP13_SQL"),
}


def _each():
    for name, (module, function, sql) in _KNOWN.items():
        m = importlib.import_module(f"tidemark.llm.{module}")
        s = getattr(m, sql) if sql else None
        yield name, getattr(m, function), s() if callable(s) else s


def queries() -> dict:
    return {name: f for name, f, _ in _each()}


def oracle_sql() -> dict[str, str]:
    return {name: s for name, _, s in _each() if s}
