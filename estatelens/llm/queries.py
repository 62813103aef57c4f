"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .oracles import DECONTAMINATION, JACCARD, MIXING, PII

TOKENIZER = "byte_bpe_50k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_digest

    return pii_digest(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_digest

    return language_digest(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_digest

    return contamination_digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_digest

    return mix_digest(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_digest

    return quality_digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import link_components

    return link_components(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_digest

    return shard_digest(documents(spark, sf_dir))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import lm_digest

    return lm_digest(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokencount import token_counts

    return token_counts(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_digest

    return media_digest(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_language_id, op3_decontamination, op4_mixing, op5_quality, op6_jaccard_join, op7_sharding, op8_lm_scores, op9_token_counts, op10_media_columns)
}

ORACLES: dict[str, str] = {"op1_pii": PII, "op3_decontamination": DECONTAMINATION, "op4_mixing": MIXING, "op6_jaccard_join": JACCARD}
