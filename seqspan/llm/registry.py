"""The queries of this subpackage and their DuckDB SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op1_line_dedup": "linededup",
    "op2_quality_classifier": "quality",
    "op3_quality_rules": "rules",
    "op4_simhash": "simhash",
    "op5_lm_score": "lm",
    "op6_ann": "ann",
    "op7_pack": "packing",
    "op8_url_filter": "urls",
    "op9_mix": "mixing",
    "op10_toxicity": "toxicity",
    "op11_topk": "topk",
    "op12_fill_in_middle": "fim",
    "op13_whitening": "whitening",
}


def _query(name: str, module: str) -> Callable[[SparkSession, str], DataFrame]:
    return getattr(import_module(f"seqspan.llm.{module}"), name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name, module) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in _MODULES.items():
        if sql := getattr(import_module(f"seqspan.llm.{module}"), "ORACLE_SQL", None):
            found[name] = sql
    return found
