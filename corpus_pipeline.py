"""The corpus pipeline: quality rules, language ID, SimHash near-dedup, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, packing, quality, simhash
from tessera.llm.common import table
from tessera.operators.components import WRITTEN, cut_lineage, drop_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts fail the base rules; repeated rows share their verdict."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: neither `und` (null texts, texts without a letter) nor rejected. Of equal cross-entropies the first
    language by name counts; rows with a null lang are judged, not learned from."""
    return langid.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the smallest doc_id, null ids last. Repeated rows and rows that repeat an id leave one row."""
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences. A null or empty text is its end token alone; long texts are cut, never dropped."""
    return packing.pack(docs)


STAGES = [("quality rules", good_quality), ("language id", known_language), ("simhash near-dedup", one_of_each), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn on documents, each one's result written and read again; what earlier stages wrote is then deleted."""
    docs = table(spark, sf_dir, "documents")
    before = set(WRITTEN)
    for name, stage in STAGES[:-1]:
        docs, path = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        for old in [p for p in WRITTEN if p not in before and p != path]:
            drop_table(spark, old)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Models and packing are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
