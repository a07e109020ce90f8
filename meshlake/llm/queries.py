"""The corpus queries and their SQL twins."""

from __future__ import annotations

import importlib

#: query name -> module of this package that holds the function of that name
MODULES = {
    "op2_toxicity": "toxicity",
    "op1_decontaminate": "decontaminate",
    "op3_warc": "warc",
    "op4_ngram_join": "ngram_join",
    "op5_imatch": "imatch",
    "op6_packing": "packing",
    "op7_sharding": "sharding",
    "op8_quality": "quality",
    "op9_langid": "langid",
    "op10_chat": "chat",
}


def queries() -> dict:
    """Name -> function of (spark, sf_dir)."""
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL of those queries that SQL can express."""
    found = {}
    for name, module in MODULES.items():
        sql = getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", {}).get(name)
        if sql:
            found[name] = sql
    return found
