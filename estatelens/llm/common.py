"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship
from ..plans.tables import bounded_broadcast, discard, shared_folder, stored

__all__ = ["bounded_broadcast", "discard", "documents", "id_residue", "shared_folder", "small_batches", "stored", "text_of", "trimmed", "unused", "utf8_of"]

#: Rows in one Arrow batch; texts are long, so the default of 10,000 rows could fill a worker's memory.
BATCH_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def utf8_of(column: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return text_of(column).cast("binary")


def id_residue(divisor: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"__{name}".lower() in taken:
            name += "_"
        out.append(f"__{name}")
    return out


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the rows of an Arrow batch, as whole texts travel in them, and sends this package to the workers."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def trimmed(run):
    """run, a function over Arrow batches, that gives free memory back to the system when a task ends: workers outlive it."""

    def task(batches):
        yield from run(batches)
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return task
