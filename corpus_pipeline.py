"""From raw documents to packed training sequences, one operator a stage.

Language identification rejects texts that are in no learned language; SimHash keeps one document of each group of
near-duplicates; found secrets are blotted out; the mix repeats or leaves out documents to reach its source weights;
what remains is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintforge.llm import language, mixing, packing, secrets, simhash
from stintforge.llm.common import forget, written
from stintforge.llm.queries import documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject what the learned languages do not explain: null, without a letter, or no shorter in any than plain bytes."""
    return language.accept(docs, language.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group."""
    return simhash.leaders(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets; every document stays."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it."""
    return mixing.repeated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, with its sequence and place."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("packing", packing_stage)]

#: SQL cannot express these stages: they train, hash with XXH64, iterate and tokenise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote is deleted once the next one is written."""
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
