"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, token ids.

``STAGES`` are applied in order to ``documents``; each stage's result is written as Parquet and read
again as the next one's input.  All but the last return the columns of ``documents``.

Defined results: a null text counts as empty and a null id as no id in every stage (see the operators);
repeated rows are copies, of which one stays; documents without labels are judged by the ones that
have them, and without any labels or benchmark all pass those stages; an empty table gives no rows;
further columns, whatever their names, go along until the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontam, exact_dedup, quality, simhash
from quire.llm.common import pick, table, work_folder
from quire.llm.queries import bpe_digests
from quire.session import delete_now, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one with the smallest id."""
    return simhash.keep_one(docs, words=3, threshold=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without too much of a benchmark item in them."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token ids, their count and digest, and the digest of the bytes they decode to."""
    return bpe_digests(pick(docs, "doc_id", "text"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", encoding_stage),
]

#: The stages are a trained model, a graph search and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from ``documents``.

    A stage's intermediate tables go when its result is written, and so does the result before it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = work_folder(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            delete_now(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
