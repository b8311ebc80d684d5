"""The queries of the training-data operators and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, divergence, hardnegatives, langid, licenses, neighbours, packing, pages, quality, secretscan, sentencepieces, simhash, toxicity

MODULES = (chat, sentencepieces, toxicity, neighbours, quality, packing, langid, simhash, pages, licenses, secretscan, hardnegatives, divergence)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit() and f.__module__ == m.__name__}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
