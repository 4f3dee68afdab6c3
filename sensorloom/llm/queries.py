"""Registered queries over the corpus tables, each with its SQL counterpart or None."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm import (
    chat,
    decontamination,
    extraction,
    language,
    lexical_search,
    line_dedup,
    mixing,
    oracles,
    quality,
    secrets,
    sharding,
    similarity,
    toxicity,
    vector_codes,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_mixing": (_over("documents", mixing.mix_digest), oracles.MIXING),
    "op2_quality": (_over("documents", quality.quality_digest), oracles.QUALITY),
    "op3_chat": (_over("conversations", chat.chat_digest), oracles.CHAT),
    "op4_secrets": (_over("documents", secrets.secrets_digest), oracles.SECRETS),
    "op5_language": (_over("documents", language.language_digest), None),
    "op6_decontamination": (
        lambda spark, sf_dir: decontamination.contamination_digest(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
        ),
        oracles.CONTAMINATION,
    ),
    "op7_similarity": (_over("documents", similarity.similarity_digest), None),
    "op8_toxicity": (
        lambda spark, sf_dir: toxicity.toxicity_digest(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
        ),
        None,
    ),
    "op9_extraction": (_over("pages", extraction.extraction_digest), None),
    "op10_sharding": (_over("documents", sharding.shard_digest), oracles.SHARDING),
    "op11_vector_codes": (_over("embeddings", vector_codes.vector_code_digest), oracles.VECTOR_CODES),
    "op12_search": (
        lambda spark, sf_dir: lexical_search.search_digest(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
        ),
        oracles.SEARCH,
    ),
    "op13_lines": (_over("documents", line_dedup.line_dedup_digest), oracles.LINES),
}
