"""Tables in the shared folder, and joins that broadcast only what has been counted."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side is broadcast unless a caller gives its own bound of rows.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 256 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where the session names none and everything runs on one machine, it is one under the machine's temporary folder; on a
    cluster that is an error, as each machine would write to its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or os.path.join(tempfile.gettempdir(), "checkpoints")).rstrip("/")


_made: list[tuple[SparkSession, str, DataFrame | None]] = []


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the process ends."""
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path, None))
    return path


def discard(df: DataFrame) -> None:
    """Deletes the table that stored() gave, which nothing reads any longer."""
    for at, (spark, path, frame) in enumerate(_made):
        if frame is df:
            _delete(spark, path)
            del _made[at]
            return


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    """Deletes this process's tables when it ends, as no DataFrame can read them then."""
    for spark, path, _ in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended already; the folder's owner clears it
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: it cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _made.append((df.sparkSession, path, out))
    return out


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, *wide: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small enough, else df as it is, for a shuffled join.

    Small: at most max_rows rows; and if it has columns without a bound of their own (wide), these take at most max_bytes in all.
    """
    size = lambda c: F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0))
    n, taken = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(map(size, wide), F.lit(0)).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and taken <= max_bytes else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
