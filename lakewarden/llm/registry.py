"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

import functools
import importlib

from lakewarden.llm.shared import ship

_QUERIES = {
    "op1_pii": "pii",
    "op2_warc": "warc",
    "op3_minhash": "minhash",
    "op4_sharding": "sharding",
    "op5_decontamination": "decontamination",
    "op6_mixing": "mixing",
    "op7_toxicity": "toxicity",
    "op8_quality": "quality",
    "op9_token_counts": "tokens",
    "op10_webp": "webp",
}


def _query(module: str, name: str):
    operator = getattr(importlib.import_module(f"lakewarden.llm.{module}"), name)

    @functools.wraps(operator)
    def run(spark, sf_dir):
        ship(spark)
        return operator(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _query(module, name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from lakewarden.llm.oracles import ORACLES

    return dict(ORACLES)
