"""From raw documents to token ids: the stages in order, each written as Parquet and read again as the next one's input.

Each stage works on all that the one before kept. The first four return the columns of `documents`; the last returns ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assay.llm import decontaminate, language_id, near_dedup, pii, sentencepiece_viterbi
from assay.llm.common import scratch_dir, table, written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return language_id.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents holding a benchmark item go."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind."""
    return pii.redact_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digest of the text they decode to."""
    return sentencepiece_viterbi.encode_documents(docs, sentencepiece_viterbi.load_model(spark))


STAGES = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminated),
    ("pii", redacted),
    ("sentencepiece", encoded),
]

#: No stage but the fourth's base patterns is SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    path, docs = scratch_dir(spark), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{path}/{i}_{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
