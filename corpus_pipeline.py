"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that the one before kept, written as Parquet and read again. All but the last return the columns
that they get, by name and type, whatever these are; ``doc_id`` and ``text`` must be among them. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from deepwell.llm.language import in_a_language
from deepwell.llm.mixing import mixed_documents
from deepwell.llm.packing import pack
from deepwell.llm.semicrf import redacted
from deepwell.llm.store import bounded_batches, table, written
from deepwell.llm.superminhash import without_near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined. Null and empty texts have none; ties have none; repeated rows are judged each."""
    return in_a_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id.

    Rows that share a doc_id are one document and stay or go together; rows without a doc_id stay.
    """
    return without_near_duplicates(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced by their kinds; null texts stay null."""
    return redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stretches of documents in the drawn blocks, a row each; texts without tokens are in none.

    Null sources are a source of their own. The stage returns text, not tokens, since its columns are those of documents;
    packing makes the tokens again.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of token sequences: each row's tokens, in pieces that fit. ``starts`` count from the start of the row's text."""
    return pack(docs)


def _bounded(stage: Stage) -> Stage:
    """The stage, with Arrow batches of bounded size."""

    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return call


STAGES: list[tuple[str, Stage]] = [(f.__name__, _bounded(f)) for f in (language_id, near_dedup, private_data, source_mix, packing)]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
