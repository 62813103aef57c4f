"""A stream of manifest changes merged into the current snapshot, micro-batch by micro-batch.

Each batch holds whole rows with the key, a version and a deleted flag, and is written as a table of its own, its latest rows alone. Every COMPACT
batches all rows are merged into a new base. The current snapshot is the newest complete base with the complete batches after it, so a
batch that is tried again gives the same snapshot, and readers never see a half-written one. What a newer base has taken in is deleted
one base later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Batches after which all rows are merged into a new base.
COMPACT = 20


def latest(rows: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The row of the highest version of each key; of equal versions the deleted one, so that order doesn't matter."""
    order = Window.partitionBy(key).orderBy(F.desc(version), F.desc("deleted"))
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def merge_changes(snapshot: DataFrame, changes: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The snapshot after the changes; older versions than the snapshot's don't count. Deleted rows stay as marks."""
    return latest(snapshot.unionByName(changes), key, version)


def follow(changes: DataFrame, folder: str, checkpoint: str, key: str = "id", version: str = "version", compact: int = COMPACT) -> StreamingQuery:
    """Keeps a snapshot of a stream under folder: batch=<n> tables of changes, and base=<n> tables of all rows up to batch n."""
    spark = changes.sparkSession

    def apply(batch: DataFrame, n: int) -> None:
        latest(batch, key, version).write.mode("overwrite").parquet(f"{folder}/batch={n}")
        if (n + 1) % compact:
            return
        before = max((b for b in _complete(spark, folder, "base") if b < n), default=None)
        current(spark, folder, batch.schema, key, version, upto=n).write.mode("overwrite").parquet(f"{folder}/base={n}")
        for kind in ("batch", "base"):
            for old in _complete(spark, folder, kind):
                if before is not None and (old <= before if kind == "batch" else old < before):
                    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}={old}")
                    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _complete(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """The numbers of the tables of a kind whose write has finished."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    made = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and made(n))


def current(spark: SparkSession, folder: str, schema, key: str = "id", version: str = "version", upto: int | None = None) -> DataFrame | None:
    """The snapshot after batch upto (null: the newest), or None before the first."""
    counts = lambda n: upto is None or n <= upto
    bases = [b for b in _complete(spark, folder, "base") if counts(b) and b != upto]
    base = max(bases, default=None)
    parts = [f"{folder}/batch={n}" for n in _complete(spark, folder, "batch") if counts(n) and (base is None or n > base)]
    if base is None and not parts:
        return None
    read = lambda *paths: spark.read.schema(schema).parquet(*paths)
    whole = read(f"{folder}/base={base}") if base is not None else None
    if not parts:
        return whole
    return latest(read(*parts) if whole is None else whole.unionByName(read(*parts)), key, version)
