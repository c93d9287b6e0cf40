"""The subpackage's queries: each applies its operator, as in production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .store import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fertility import judge

    return judge(table(spark, sf_dir, "documents"))


def op2_language_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op4_toxic_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import find_toxic

    return find_toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op6_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .semicrf import find_private

    return find_private(table(spark, sf_dir, "documents"))


def op7_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multiindex import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(table(spark, sf_dir, "documents"))


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .superminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_fertility,
        op2_language_bloom,
        op3_source_mixing,
        op4_toxic_zstd,
        op5_best_fit_packing,
        op6_pii_semicrf,
        op7_inverted_multi_index,
        op8_backoff_automaton,
        op9_superminhash,
        op10_suffix_dedup,
    )
}

#: DuckDB SQL for queries that SQL can express. None of these can be: they train models, hash with 64-bit
#: words, tokenise or pack sequentially. tests/llm holds each against a brute-force version instead.
ORACLES: dict[str, str] = {}
