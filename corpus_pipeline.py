"""The corpus pipeline: language, near copies, benchmark passages, mixing, shards.

Each stage works on all rows that the one before it kept; all but the last return the columns of documents, whatever other columns
there are. The first stage rejects texts without letters, null and empty ones among them, whether or not there are labels to learn from;
texts in none of LANGUAGES; and texts whose language is doubtful. Of rows with equal id and text the second keeps one. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from estatelens.llm.common import id_residue, stored
from estatelens.llm.decontaminate import decontaminate
from estatelens.llm.jaccard import keep_first
from estatelens.llm.langid import learn_profiles, select_languages
from estatelens.llm.mixing import mix
from estatelens.llm.sharding import external_shuffle


#: Languages to keep; None: all that the labels name. A text needs this score (0 to 1): over 0.5, its language is likelier than all others together.
LANGUAGES, LEAST_SCORE = None, 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of LANGUAGES with a score of LEAST_SCORE at least; learns from two thirds of the labelled rows.

    Where no language could be learned, all documents with letters stay.
    """
    return select_languages(docs, learn_profiles(docs.filter(id_residue(3) != 1)), LANGUAGES, LEAST_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked ones."""
    return keep_first(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated with benchmark items and cuts the passages out of those with lesser hits."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it, in random order."""
    return external_shuffle(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_passages", benchmark_passages), ("mixing", mixing), ("shards", shards)]

#: SQL can't express the first and the last stage; a test holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
