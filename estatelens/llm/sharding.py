"""Sharding by a two-pass external shuffle.

Pass one scatters the records by a seeded hash into buckets that fit in memory; a task of pass two takes a run of whole
buckets, so the number of tasks stays bounded however many buckets there are. Pass two goes through its buckets one at a time: it puts
each in one fixed order, applies a seeded Fisher-Yates permutation and deals the records out. The tasks' row counts
are known from pass one, so a record's place in the whole permutation is known without any global sort. Place p goes to
shard p mod n as its slot p div n, so the shards' row counts differ by one at most.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, MapType, StructField, StructType

from .common import small_batches, trimmed, unused

SHARDS = 24
BUCKET_BYTES = 32 << 20
#: Tasks of pass two at most; beyond so many buckets each takes several.
MAX_TASKS = 8192
#: Rows in a file that write_shards writes.
FILE_ROWS = 1 << 20
SEED = 20_240_607


def external_shuffle(df: DataFrame, n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text", max_tasks: int = MAX_TASKS) -> DataFrame:
    """df's columns, then shard (0 to n_shards-1) and slot (gapless from 0 in each shard), in random order.

    The order depends on seed, the rows and the numbers of buckets and tasks alone, not on df's order or partitions. Rows
    are dealt by all their columns (but maps), so of rows with equal key and text each has a place of its own; rows equal
    in all columns share a bucket, and their places are interchangeable. Null keys and texts are hashed as nulls. An
    empty table gives an empty table. Columns of df named shard or slot are replaced.
    """
    spark = df.sparkSession
    small_batches(spark)
    df = df.drop("shard", "slot")
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in (key, text) and "map<" not in f.dataType.simpleString()]
    maps = [F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema.fields if isinstance(f.dataType, MapType)]
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 64
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    n = max(1, -(-total // bucket_bytes), min(rows, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tasks = min(n, max_tasks)
    bucket, order, task = unused(df, "bucket", "order", "task")
    dealt = F.xxhash64(F.lit(seed), F.col(key), F.col(text), *plain)
    placed = df.withColumn(order, dealt).withColumn(bucket, F.pmod(F.col(order), F.lit(n))).withColumn(task, F.floor(F.col(bucket) * tasks / n).cast("int"))
    counts = {r[0]: r[1] for r in placed.groupBy(task).count().collect()}  # a row for each task at most
    starts = [0, *accumulate(counts.get(i, 0) for i in range(tasks))]

    def run(batches):
        held, now, at = [], None, None

        def dealt_out():
            group = pa.Table.from_batches(held)
            shuffled = np.arange(len(group))
            np.random.default_rng([seed, now]).shuffle(shuffled)  # Fisher-Yates
            place = np.arange(at, at + len(group))
            out = group.take(shuffled).drop_columns([bucket, order, task])
            out = out.append_column("shard", pa.array((place % n_shards).astype(np.int32))).append_column("slot", pa.array(place // n_shards))
            return out.to_batches(max_chunksize=1024)

        for batch in batches:
            if not batch.num_rows:
                continue
            buckets = batch.column(bucket).to_numpy()
            bounds = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
            if at is None:
                at = starts[batch.column(task)[0].as_py()]
            for lo, hi in zip(bounds, bounds[1:]):
                if held and buckets[lo] != now:
                    yield from dealt_out()
                    at += sum(map(len, held))
                    held = []
                now = int(buckets[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from dealt_out()

    fixed = placed.repartitionById(tasks, F.col(task)).sortWithinPartitions(bucket, order, F.col(key), *maps)
    return fixed.mapInArrow(trimmed(run), StructType([*df.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())]))


def shard_digest(df: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """The digest columns of documents(doc_id, text), dealt by external_shuffle; a null text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return external_shuffle(df.select("doc_id", "text"), n_shards).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, n_shards: int = SHARDS, seed: int = SEED, file_rows: int = FILE_ROWS) -> None:
    """Writes the shuffled records as Parquet, a folder for each shard with files of file_rows rows each, in slot order.

    A shard's files in the order of their names are its slots in order. An empty table gives no file.
    """
    shuffled = external_shuffle(df, n_shards, seed)
    files = max(1, -(-df.count() // (n_shards * file_rows)))
    file = (F.col("shard") * files + F.floor(F.col("slot") / file_rows)).cast("int")
    shuffled.repartitionById(n_shards * files, file).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
