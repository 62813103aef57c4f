"""Joins that resolve names: by rank, by narrowest interval, by longest prefix, one to one, exactly or almost.

Ambiguity is shared, counted or refused, never picked in silence; where one candidate must win, the order is stated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from ..plans.tables import bounded_broadcast, stored

#: Rows that a task of spread_join makes, and reads, about; rows of a side of a tile; pairs of a key from which it is cut into tiles; most tasks.
TASK_ROWS, TASK_INPUT, TILE_SIDE, TILED_ABOVE, MOST_TASKS = 8_000_000, 500_000, 2048, 4_000_000, 20_000


def ranked_resolution(wanted: DataFrame, key: Sequence[str], candidates: Column, known: DataFrame, name: str) -> DataFrame:
    """For each row of wanted the known name of the best rank.

    candidates: array of (rank, name). Result: key, resolved (null if none), rank, ambiguous (several names share the
    best rank; the smallest is taken).
    """
    tried = wanted.select(*key, F.explode_outer(candidates).alias("c")).select(*key, F.col("c.rank").alias("rank"), F.col("c.name").alias("__name"))
    hits = tried.join(known.select(F.col(name).alias("__name"), F.lit(True).alias("__known")).distinct(), "__name", "left")
    hit = F.when(F.col("__known"), F.struct("rank", "__name"))
    best = hits.groupBy(*key).agg(F.min(hit).alias("best"), F.array_sort(F.collect_set(hit)).alias("all"))
    same = F.filter("all", lambda x: x["rank"] == F.col("best")["rank"])
    return best.select(*key, F.col("best.__name").alias("resolved"), F.col("best.rank").alias("rank"), (F.size(same) > 1).alias("ambiguous"))


def weighted_links(left: DataFrame, right: DataFrame, on: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Equal names linked to all their bearers, each with weight round(1/n, 3), half to even."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return left.join(right, list(on)).withColumn("weight", F.bround(1 / n, 3))


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """left.join(right, on) for results far larger than both sides: the pairs are made where they are read and are never shuffled.

    Keys with very many pairs are cut into tiles of about TILE_SIDE by TILE_SIDE rows, each a key of its own, so that a few keys
    take as many tasks as many do. A side's rows go once into each tile of theirs. Both sides are read several times: give stored ones.
    """
    side = lambda df, n: df.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    sizes = side(left, "__l").join(side(right, "__r"), list(on)).withColumn("__pairs", F.col("__l") * F.col("__r"))
    total, rows = sizes.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in (F.col("__pairs"), F.col("__l") + F.col("__r")))).first()
    if total <= TILED_ABOVE:
        return left.join(right, list(on))
    tasks = min(8 + max(total // TASK_ROWS, rows // TASK_INPUT), MOST_TASKS)
    cuts = lambda n: F.ceil(F.col(n) / TILE_SIDE).alias(f"{n}_cuts")
    heavy = bounded_broadcast(stored(sizes.filter(F.col("__pairs") > TILED_ABOVE).select(*on, cuts("__l"), cuts("__r")), "heavy-keys"))

    def cut(df: DataFrame, own: str, other: str) -> DataFrame:
        l, r = (F.coalesce(f"{n}_cuts", F.lit(1).cast("long")) for n in ("__l", "__r"))  # noqa: E741
        mine, theirs = (l, r) if own == "__i" else (r, l)
        tiles = df.join(heavy, list(on), "left").select(*df.columns, F.pmod(F.xxhash64(*df.columns), mine).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), theirs - 1)).alias(other))
        return tiles.repartition(tasks, *on, "__i", "__j")

    return cut(left, "__i", "__j").join(cut(right, "__j", "__i").hint("merge"), [*on, "__i", "__j"]).drop("__i", "__j")


def fan_out(callers: DataFrame, bearers: DataFrame, on: Sequence[str], source: Sequence[str], target: str, best: dict[str, Callable], known: DataFrame | None = None, apart: Sequence[str] = ()) -> DataFrame:
    """(*source, *apart, target, *best): each source with each target that its groups (on) hold, once, without the known(*source, target).

    callers(*source, *on, ..) are distinct by source and group, bearers(*on, target, ..) by group and target; best: an aggregate for each
    column that equal pairs may differ in. apart: columns of on that a source's groups share, so that no pairs of others are equal to its own.
    Pairs that could be equal to others or known are known by their ends: a target of several groups at a source of several such
    groups, and a known pair's target at a known pair's source. These alone are grouped; all others are given out as they are made.
    """
    out = [*source, *apart, target, *best]
    n = F.count(F.lit(1))
    shared = n.over(Window.partitionBy(*apart, target)) > 1
    bearers = bearers.withColumn("__shared", shared)
    crowded = bearers.filter("__shared").select(*on).distinct().withColumn("__c", F.lit(1))
    callers = callers.join(crowded, list(on), "left").withColumn("__multi", F.count("__c").over(Window.partitionBy(*source)) > 1).drop("__c")
    mark = lambda df, of, keys, name: df.join(of.select(*keys).distinct().withColumn(name, F.lit(True)), list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))
    if known is None:
        callers, bearers = callers.withColumn("__had", F.lit(False)), bearers.withColumn("__known", F.lit(False))
    else:
        known = known.select(*source, target).join(bearers.select(target).distinct(), target, "left_semi").distinct()
        bearers, callers = mark(bearers, known, [target], "__known"), mark(callers, known, source, "__had")
    callers, bearers = stored(callers, "callers"), stored(bearers, "bearers")
    doubtful = (F.col("__multi") & F.col("__shared")) | (F.col("__had") & F.col("__known"))
    plain = spread_join(callers, bearers, on).filter(~doubtful).select(*out)
    some = callers.filter("__multi or __had"), bearers.filter("__shared or __known")
    if some[0].isEmpty() or some[1].isEmpty():
        return plain
    rest = spread_join(*some, on).filter(doubtful)
    rest = rest.groupBy(*source, *apart, target).agg(*(f(c).alias(c) for c, f in best.items())) if best else rest.select(*out).distinct()
    return plain.union(rest if known is None else rest.join(known, [*source, target], "left_anti").select(*out))


def narrowest_interval(points: DataFrame, ranges: DataFrame, on: Sequence[str], at: str, start: str, end: str, name: str, key: Sequence[str]) -> DataFrame:
    """For each point the range of its group that holds it, ends included: the narrowest, then the smallest name."""
    inside = points.join(ranges, list(on)).filter(F.col(at).between(F.col(start), F.col(end)))
    width = F.col(end) - F.col(start)
    return inside.groupBy(*key).agg(F.min_by(name, F.struct(width, F.col(name))).alias(name))


def longest_prefix(items: DataFrame, text: str, prefixes: DataFrame, prefix: str, separator: str = "/") -> DataFrame:
    """items with the longest of the prefixes that its text starts with by segment; null if none. Repeated rows stay.

    Each distinct text is cut at its separators, so that the lookup is an equi-join; what was found is joined back to the rows.
    """
    texts = items.select(F.col(text).alias("__t")).filter("__t is not null").distinct()
    parts = F.split("__t", separator)
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), separator).alias("p")))
    small = bounded_broadcast(prefixes.select(F.col(prefix).alias("__p")).filter("__p is not null").distinct())
    hits = texts.select("__t", F.inline(cuts)).join(small, F.col("p") == F.col("__p"))
    best = hits.groupBy("__t").agg(F.max_by("__p", "n").alias(prefix))
    return items.join(best, items[text] == best["__t"], "left").drop("__t")


def nearest_ancestor(files: DataFrame, path: str, owners: DataFrame, directory: str, owner: str) -> DataFrame:
    """(path, owner) by the deepest folder that has an owner; files without one go."""
    steps = files.select(F.col(path), F.explode(ancestors(F.col(path))).alias("s")).select(path, F.col("s.dir").alias("__dir"), F.col("s.depth").alias("__depth"))
    found = steps.join(bounded_broadcast(owners.select(F.col(directory).alias("__dir"), owner)), "__dir")
    return found.groupBy(path).agg(F.max_by(owner, F.struct("__depth", owner)).alias(owner))


def unique_both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs whose members occur in no other pair."""
    pairs = pairs.select(a, b).distinct()
    n_a, n_b = (F.count(F.lit(1)).over(Window.partitionBy(x)) for x in (a, b))
    return pairs.withColumn("__a", n_a).withColumn("__b", n_b).filter("__a = 1 and __b = 1").select(a, b)


def unique_matches(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """(a, b): rows of both sides that share a key's value and have no other candidate by any of the keys; empty keys don't count.

    A value that several rows of a side have makes all that have it ambiguous, so no pairs of such a group are made.
    """
    made = spoiled_a = spoiled_b = None
    for k in keys:
        l, r = (df.filter(F.coalesce(F.col(k).cast("string"), F.lit("")) != "").select(F.col(k).alias("k"), F.col(i).alias(i)) for df, i in ((left, a), (right, b)))  # noqa: E741
        n = l.groupBy("k").agg(F.count(F.lit(1)).alias("n_a"), F.min(a).alias(a)).join(r.groupBy("k").agg(F.count(F.lit(1)).alias("n_b"), F.min(b).alias(b)), "k")
        crowded = n.filter("n_a > 1 or n_b > 1").select("k")
        parts = n.filter("n_a = 1 and n_b = 1").select(a, b), l.join(crowded, "k", "left_semi").select(a), r.join(crowded, "k", "left_semi").select(b)
        made, spoiled_a, spoiled_b = parts if made is None else (made.union(parts[0]), spoiled_a.union(parts[1]), spoiled_b.union(parts[2]))
    return unique_both_ways(made, a, b).join(spoiled_a.distinct(), a, "left_anti").join(spoiled_b.distinct(), b, "left_anti").select(a, b)


def exact_almost_links(calls: DataFrame, endpoints: DataFrame, exact: Sequence[str], almost: Sequence[str], call: str, endpoint: str) -> DataFrame:
    """Each call's status: exact, almost or orphan, with the smallest endpoint of that match.

    exact: columns that equal keys share. almost: columns that keys share which differ in holes alone. Almost comes
    into play only where no key is equal.
    """
    ends = endpoints.select(*{*exact, *almost}, endpoint)
    hit = calls.join(ends.groupBy(*exact).agg(F.min(endpoint).alias("__exact")), list(exact), "left")
    hit = hit.join(ends.groupBy(*almost).agg(F.min(endpoint).alias("__almost")), list(almost), "left")
    status = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__almost").isNotNull(), "almost").otherwise("orphan")
    return hit.select(call, status.alias("status"), F.coalesce("__exact", "__almost").alias(endpoint))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def coverage(roots: DataFrame, anchors: DataFrame, key: Sequence[str], by: str) -> DataFrame:
    """Covered and uncovered roots by a column."""
    seen = anchors.select(*key).distinct().withColumn("__seen", F.lit(1))
    return roots.join(seen, list(key), "left").groupBy(by).agg(F.count("__seen").alias("covered"), (F.count(F.lit(1)) - F.count("__seen")).alias("uncovered"))
