"""Corpus pipeline: from documents to a training mix, stage by stage.

Each stage reads what the stage before wrote, and keeps the columns of documents; the last adds the copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramaline.llm import decontaminate, mixing, quality, secret_scan, simhash
from tramaline.session import cut, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects, by the Gumbel key of their importance weight.

    A null or empty text weighs 0, as does one of no telling words. Repeated rows and ties of keys stay or go alike; a
    null doc_id draws its noise like any key. Without labels, or without good or bad ones, all documents stay.
    """
    return quality.keep_selected(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id.

    Null and empty texts are copies of each other. Of rows that repeat a doc_id one stays; rows without one all stay.
    """
    return simhash.keep_dissimilar(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item.

    Rows with a null text or doc_id stay unless their text has a hit; repeated rows stay or go alike; items that are
    null, or whose text has no words, are left out. An empty benchmark keeps all.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by their kind; a null text stays null, repeated rows alike."""
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh alike, globally shuffled.

    Rows of one doc_id draw alike, those without one as one key; a null source is a source. The draw may be 0 copies.
    """
    return mixing.mix_sources(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The classifier and near copies can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
