"""The training-corpus pipeline: language ID, quality, near duplicates, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from causeway.llm.common import bounded_batches, discard, table, written
from causeway.llm.decontam import drop_contaminated
from causeway.llm.jaccard import keep_one
from causeway.llm.language import drop_unknown_languages
from causeway.llm.packing import pack_documents
from causeway.llm.quality import drop_low_quality


def _bounded(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@_bounded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents without a recognised language go, so null and empty texts, and those without a letter.

    Rows of any number, repeated or not, are judged each; all columns stay, whatever their names; an empty table gives none.
    """
    return drop_unknown_languages(spark, docs)


@_bounded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score below the threshold go.

    Texts of any length are scored whole; equal texts share a fate; without labels of both kinds all stay; all columns stay.
    """
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


@_bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group of similar ones stays, that of the smallest id.

    Texts without words and rows of null id stay; of rows that share an id one stays; all columns stay.
    """
    return keep_one(docs)


@_bounded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents with a leaked benchmark item go.

    Null items aren't looked for; an empty benchmark drops nothing; null texts and all columns stay.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_bounded
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the pieces of the kept documents in sequences of 2048 tokens.

    A row per piece with the columns of ``pack_documents`` only; a null text is its end id alone; an empty table gives no rows.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained models, iterated components and tokenizers aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it.

    Null and empty texts have no language and go; rows that share an id are one document;
    columns of any name are kept up to the packing; an empty table gives no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
