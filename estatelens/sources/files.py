"""Files as rows, and tables of facts made from them by scanners that run where the file is."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.paths import has_segment, in_scope, matches_glob
from ..functions.text import language_of
from ..plans.ship import ship

#: Folders that hold builds and third-party code.
SKIPPED = (".git", ".hg", ".svn", ".idea", ".vs", ".vscode", "node_modules", "bower_components", "obj", "bin", "dist", "coverage", "vendor", "__pycache__", ".venv", "venv")
MOST_BYTES = 2 << 20
#: Files in one Arrow batch; a file may be up to MOST_BYTES.
BATCH_FILES = 256


def _qualified(spark: SparkSession, root: str) -> str:
    """root as the file system spells it, with its scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString().rstrip("/")


def _plain(uri: str) -> str:
    """A URI with one slash after its scheme, however many it is spelled with."""
    return re.sub(r"^([a-zA-Z][\w+.-]*):/+", r"\1:/", uri)


def discover(spark: SparkSession, root: str, excludes: Sequence[str] = (), scope: Sequence[str] = (), roots: Sequence[str] = ()) -> DataFrame:
    """(path, content, content_hash, length, lang, skipped) of the files under root, paths relative to it.

    A file in a skipped folder, excluded by a glob or outside the scope is left out; one that is too large or binary stays with the
    reason in `skipped` and no content. Files of no length hold no facts, and Spark's reader leaves them out.
    """
    base = _qualified(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.substring(F.regexp_replace("path", r"^([a-zA-Z][\w+.-]*):/+", "$1:/"), F.lit(len(_plain(base)) + 2), F.lit(1 << 30))
    rows = files.withColumn("rel", relative).filter(~has_segment(F.col("rel"), list(SKIPPED)) & in_scope(F.col("rel"), list(scope)) & in_scope(F.col("rel"), list(roots)))
    if excludes:
        rows = rows.filter(~matches_glob(F.col("rel"), list(excludes)))
    rows = rows.withColumn("content", F.when(F.col("length") <= MOST_BYTES, F.col("content")))
    binary = F.instr(F.substring("content", 1, 8000).cast("string"), "\0") > 0
    why = F.when(F.col("length") > MOST_BYTES, "too_large").when(binary, "binary")
    rows = rows.withColumn("skipped", why)
    return rows.select(
        F.col("rel").alias("path"), F.when(F.col("skipped").isNull(), F.col("content")).alias("content"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"),
        "length", language_of(F.col("rel")).alias("lang"), "skipped",
    )


def with_text(files: DataFrame) -> DataFrame:
    """Files with their content decoded, a byte-order mark dropped; undecodable bytes become replacement characters."""
    return files.filter("content is not null").withColumn("text", F.regexp_replace(F.col("content").cast("string"), "^\\uFEFF", "")).drop("content")


def scan(files: DataFrame, schema: StructType, scanner: Callable[[str, str], dict | Iterable[dict]]) -> DataFrame:
    """Rows that scanner(path, text) gives for each file of files(path, text, content_hash); path and content_hash lead, scan_error ends.

    A scanner returns one mapping or several. Where one fails, its file gives one row with the error in scan_error and nulls; all
    other files are read.
    """
    out = StructType().add("path", "string").add("content_hash", "string")
    for f in schema:
        out.add(f)
    out.add("scan_error", "string")
    arrow, names = to_arrow_schema(out), [f.name for f in out if f.name not in ("path", "content_hash")]

    def run(batches):
        for batch in batches:
            rows = []
            for path, text, digest in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    made = scanner(path, text or "")
                    found = [made] if isinstance(made, dict) else list(made)
                except Exception as e:  # noqa: BLE001  whatever ails a scanner stays with its file
                    found = [{"scan_error": f"{type(e).__name__}: {e}"}]
                for r in found:
                    rows.append({"path": path, "content_hash": digest} | {n: r.get(n) for n in names})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    spark = files.sparkSession
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_FILES:
        spark.conf.set(key, str(BATCH_FILES))
    return files.select("path", "text", "content_hash").mapInArrow(run, out)
