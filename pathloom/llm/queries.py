"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_sharding": "op01_sharding",
    "op2_tokens": "op02_tokens",
    "op3_lm": "op03_lm",
    "op4_simhash": "op04_simhash",
    "op5_suffix": "op05_suffix",
    "op6_decontam": "op06_decontam",
    "op7_topk": "op07_topk",
    "op8_toxicity": "op08_toxicity",
    "op9_bpe": "op09_bpe",
    "op10_pii": "op10_pii",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"pathloom.llm.{m}"), name) for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    mods = {name: importlib.import_module(f"pathloom.llm.{m}") for name, m in _MODULES.items()}
    return {name: m.SQL for name, m in mods.items() if getattr(m, "SQL", None)}
