"""The graph index on disk: nodes, edges, reach pairs and search rows as tables, with a version and a pointer that moves last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"


class IndexError_(ValueError):
    """The index is missing or of another version."""


def generation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with a hash of all nodes and edges that doesn't depend on their order; reach isn't part of it."""
    part = lambda df, columns: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s"))
    a, b = part(nodes, ["key", "kind", "name", "owner", "file"]), part(edges, ["kind", "source", "target", "via"])
    both = a.select(F.concat_ws(":", "n", "s").alias("x")).union(b.select(F.concat_ws(":", "n", "s")))
    return both.agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "|"), 256)).alias("generation"))


def write_index(folder: str, nodes: DataFrame, edges: DataFrame, **tables: DataFrame) -> str:
    """Writes the tables under a new name and then a new pointer to it; readers see the old index until that is complete. Returns the name.

    A failure before that leaves the old pointer in force; of two writers at once, one fails as its pointer exists.
    """
    spark, name = nodes.sparkSession, f"index-{uuid.uuid4().hex}"
    meta = generation(nodes, edges).withColumn("version", F.lit(VERSION)).withColumn("name", F.lit(name))
    for table, df in {"nodes": nodes, "edges": edges, **tables}.items():
        df.write.parquet(f"{folder}/{name}/{table}")
    meta.coalesce(1).write.parquet(f"{folder}/{name}/meta")
    at = max(_pointers(spark, folder), default=0) + 1
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.parquet(f"{folder}/pointer={at}")
    return name


def _pointers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the complete pointers: those that end with the mark of a finished write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    made = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))
    return [int(n.split("=")[1]) for n in names if n.startswith("pointer=") and made(n)]


def read_index(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the current index. Another version is an error, not an empty answer."""
    numbers = _pointers(spark, folder)
    if not numbers:
        raise IndexError_(f"no index under {folder}")
    name = spark.read.parquet(f"{folder}/pointer={max(numbers)}").first()["name"]
    meta = spark.read.parquet(f"{folder}/{name}/meta").first()
    if meta["version"] != VERSION:
        raise IndexError_(f"the index has version {meta['version']}; {VERSION} is due")
    return spark.read.parquet(f"{folder}/{name}/{table}")


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """An ordered report in one file; reports are small by nature."""
    out = df.coalesce(1).write.mode("overwrite")
    out.option("header", "true").csv(path) if form == "csv" else out.json(path)
