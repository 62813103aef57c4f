"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the copies each of its documents is due: the whole part is certain, the rest is an
inclusion probability. Documents are ranked by their random odds over their inclusion odds, and the first ones are
taken until the words still due are met (the last one if that comes nearer). The cut is found without sorting or
gathering a source: sums by rank bucket, then by bucket within the one bucket that the cut is in, then the few documents there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, stored

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = "mix-1"
BUCKETS = 4096
#: Sources up to which the plan is broadcast (some 150 bytes each).
BROADCAST_SOURCES = 200_000
_PLAN = ("source_size", "target", "whole", "odds", "first", "second", "cut", "cut_id")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number within (0, 1) that the key and the seed decide."""
    spelled = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(spelled.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _rank() -> Column:
    """Random odds over inclusion odds, brought to [0, 1): it keeps their order."""
    q = F.col("u") / (1 - F.col("u")) / F.when(F.col("odds") > 0, F.col("odds"))  # a source with whole copies alone has no rank
    return q / (1 + q)


def _first(rank: Column) -> Column:
    return F.least(F.floor(rank * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def _second(rank: Column) -> Column:
    return F.least(F.floor((rank * BUCKETS - _first(rank)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of sizes(source, size). Weights repeat over the sources in code-point order, null last.

    A source's cap is `most` times its size. In the order of cap over weight, sources take their cap as long as it is below their
    share of what remains; the others share the rest by weight. The window runs over the sources alone.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    big = "decimal(38,0)"
    ranked = totals.withColumn("w", weight).withColumn("cap", (F.col("source_size") * most).cast(big)).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything).cast(big) - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(big)
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    shared = ranked.select("source", "source_size", "w", "cap", rest.alias("rest"), left.alias("left"))
    shared = shared.withColumn("share", F.when(F.col("cap") * F.col("left") >= F.col("w") * F.col("rest"), F.col("rest").cast("double") / F.col("left")))
    level = F.max("share").over(everything)  # the first uncapped source has the largest share by weight, which holds for all of them
    return shared.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def mixing_plan(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """A row for each source of units(id, source, size, u): its target, certain copies and the place of its cut."""
    targets = source_targets(units, weights, most)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(due).cast("long")).withColumn("part", due - F.floor(due))
    targets = targets.withColumn("odds", F.col("part") / (1 - F.col("part"))).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = stored(targets, "mix-targets")
    ranked = _with(units, targets.filter("part > 0")).withColumn("y", _rank()).withColumn("b1", _first(F.col("y"))).withColumn("b2", _second(F.col("y")))

    def bucket_of_cut(rows: DataFrame, bucket: str, name: str) -> DataFrame:
        """The bucket in which the running size passes the rest, and the size before it."""
        sums = rows.groupBy("source", bucket).agg(F.sum("size").alias("s"), F.first("rest").alias("rest"), F.first("base").alias("base"))
        before = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("base", F.col("base") + F.coalesce(F.sum("s").over(before), F.lit(0)))
        return sums.filter("base <= rest and base + s > rest").select(F.col("source").alias("source2"), F.col(bucket).alias(name), F.col("base").alias("base2"))

    def within(rows: DataFrame, cut: DataFrame, bucket: str, name: str) -> DataFrame:
        cut = bounded_broadcast(cut, BROADCAST_SOURCES)
        return rows.join(cut, rows["source"].eqNullSafe(cut["source2"]) & (rows[bucket] == cut[name])).drop("source2", "base", name).withColumnRenamed("base2", "base")

    first = stored(bucket_of_cut(ranked.withColumn("base", F.lit(0).cast("long")), "b1", "first"), "mix-first")
    inner = within(ranked.withColumn("base", F.lit(0).cast("long")), first, "b1", "first")
    second = stored(bucket_of_cut(inner, "b2", "second"), "mix-second")
    last = within(inner, second, "b2", "second").groupBy("source", "y", "id").agg(F.sum("size").alias("size"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("y", "id").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("after", F.col("base") + F.sum("size").over(upto)).filter("after + after - size <= 2 * rest")
    cut = last.groupBy(F.col("source").alias("source3")).agg(F.max(F.struct("y", "id")).alias("c"))
    out = targets
    for more, name in ((first.select(F.col("source2").alias("source3"), "first"), "first"), (second.select(F.col("source2").alias("source3"), "second"), "second"), (cut, "c")):
        more = bounded_broadcast(more, BROADCAST_SOURCES)
        out = out.join(more, out["source"].eqNullSafe(more["source3"]), "left").drop("source3")
    return stored(out.select("source", "source_size", "target", "whole", "odds", "first", "second", F.col("c.y").alias("cut"), F.col("c.id").alias("cut_id")), "mix-plan")


def _with(units: DataFrame, plan: DataFrame) -> DataFrame:
    plan = bounded_broadcast(plan.withColumnRenamed("source", "__source"), BROADCAST_SOURCES)
    return units.join(plan, units["source"].eqNullSafe(plan["__source"])).drop("__source")


def copies() -> Column:
    """How often the mix takes a document, of the columns that units and a plan have."""
    y = _rank()
    same = (y < F.col("cut")) | ((y == F.col("cut")) & (F.col("id") <= F.col("cut_id")))
    extra = (_first(y) < F.col("first")) | ((_first(y) == F.col("first")) & ((_second(y) < F.col("second")) | ((_second(y) == F.col("second")) & same)))
    return (F.col("whole") + F.when((F.col("odds") > 0) & F.coalesce(extra, F.lit(False)), 1).otherwise(0)).cast("long")


def _units(docs: DataFrame, seed: str, key: str, text: str, source: str) -> DataFrame:
    return docs.select(F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h")).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), uniform(F.col(key), seed).alias("u"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED, most: int = MOST_COPIES, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it; columns as before.

    A null text has no words, a null source is one more source and the last. Rows with equal key and text share their fate. An
    empty table, or one without words, gives an empty table.
    """
    plan = mixing_plan(stored(_units(docs, seed, key, text, source), "mix-units"), weights, most)
    cells = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("k"), F.col(text).alias("t"), F.col(source).alias("source"))
    cells = cells.select("row", F.struct("k", F.xxhash64("t").alias("h")).alias("id"), "source", uniform(F.col("k"), seed).alias("u"))
    taken = _with(cells, plan).select("row", copies().alias("copies")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def mix_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of documents(doc_id, text, source); a row for each row."""
    units = stored(_units(docs, SEED, "doc_id", "text", "source"), "mix-units")
    return _with(units, mixing_plan(units)).select(F.col("id.k").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies()).cast("long").alias("taken"))
