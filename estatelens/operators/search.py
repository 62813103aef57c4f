"""Free-text search over node fields: exact, prefix, substring, and trigrams only where nothing else matched."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import normalize_text, similarity

TRIGRAM_LEAST = 0.25
LIMIT = 10


def entries(nodes: DataFrame) -> DataFrame:
    """(node, field, text, norm) of a node's name, owner and file and of each of its attributes."""
    fields = F.concat(
        F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("name", "owner", "file"))),
        F.transform(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("text"))),
    )
    rows = nodes.select(F.col("key").alias("node"), F.inline(fields)).filter("text is not null and text <> ''")
    return rows.withColumn("norm", normalize_text(F.col("text")))


def resolve(search: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """(node, field, how, score) of search(node, field, norm): the best match of each node, best first, ties by node."""
    wanted = normalize_text(F.lit(query))
    norm = F.col("norm")
    how = F.when(norm == wanted, "exact").when(F.startswith(norm, wanted), "prefix").when(F.contains(norm, wanted), "substring")
    score = F.when(norm == wanted, 1.0).when(F.startswith(norm, wanted), 0.8).when(F.contains(norm, wanted), 0.6)
    hits = search.filter(wanted != "").withColumn("how", how).withColumn("score", score)
    plain = hits.filter("how is not null")
    if plain.isEmpty():
        close = similarity(wanted, norm)
        plain = hits.withColumn("how", F.lit("trigram")).withColumn("score", close).filter(F.col("score") >= TRIGRAM_LEAST).withColumn("score", F.bround("score", 3))
    best = plain.groupBy("node").agg(F.min_by(F.struct("field", "how", "score"), F.struct(-F.col("score"), F.col("field"))).alias("m"))
    return best.select("node", "m.field", "m.how", "m.score").orderBy(F.desc("score"), "node").limit(limit)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def similar_names(names: DataFrame, wanted: DataFrame, least: float = 0.7, limit: int = 5) -> DataFrame:
    """(wanted, name, ratio): names like each wanted one by sequence matching, the best first; a short form goes where its full one is.

    Each full name and each last segment is compared with the whole wanted name, but for pairs whose lengths alone rule the
    ratio out.
    """
    from pyspark.sql import Window

    from ..plans.ship import ship
    from ..plans.tables import bounded_broadcast

    ship(names.sparkSession)

    last = F.element_at(F.split("name", r"\."), -1)
    pool = names.select("name").union(names.select(last.alias("name"))).filter("name <> ''").distinct()
    pairs = pool.crossJoin(bounded_broadcast(wanted.select(F.col("name").alias("wanted")).filter("wanted is not null").distinct()))
    x, y = F.length(F.lower("wanted")), F.length(F.lower("name"))
    able = pairs.filter(2 * F.least(x, y) >= (least - 0.001) * (x + y))  # the ratio is rounded
    scored = able.withColumn("ratio", F.round(_ratio(F.lower("wanted"), F.lower("name")), 3)).filter(F.col("ratio") >= least)
    rank = F.row_number().over(Window.partitionBy("wanted").orderBy(F.desc("ratio"), "name"))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= limit)
    full = best.filter(F.col("name").contains(".")).select("wanted", last.alias("name")).distinct()
    return best.join(full, ["wanted", "name"], "left_anti").select("wanted", "name", "ratio")
