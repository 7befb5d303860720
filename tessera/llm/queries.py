"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tessera.llm._common import ship

#: query -> module of this subpackage that has it.
MODULES = {
    "op1_simhash_near_dedup": "simhash",
    "op2_quality": "quality",
    "op3_media_columns": "media",
    "op4_multiset_fingerprints": "multiset_hash",
    "op5_source_mixing": "mixing",
    "op6_token_store": "token_store",
    "op7_packing": "packing",
    "op8_substring_dedup": "substring_dedup",
    "op9_toxicity": "toxicity",
    "op10_token_counts": "token_counts",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(getattr(import_module(f"tessera.llm.{module}"), name)) for name, module in MODULES.items()}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    out = {}
    for module in set(MODULES.values()):
        out |= getattr(import_module(f"tessera.llm.{module}"), "ORACLE_SQL", {})
    return out
