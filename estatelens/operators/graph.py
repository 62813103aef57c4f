"""Reachability and rank over a property graph, as iterated DataFrame plans.

Loops write their state to a table in the shared folder each round, so a lost executor costs a round at most. What was seen is
brought into one table every COMPACT rounds, so that plans stay bounded; tables that nothing reads any longer are deleted. Only
counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import discard, stored

#: Edge kinds that reach crosses. Binding and inheritance aren't among them.
CROSSED = ("calls", "dispatches", "crosses", "touches", "reads", "writes")
SHARED_ABOVE = 50
PATH_DEPTH = 12
#: Rounds after which the tables of a loop are brought into one.
COMPACT = 8


class _Seen:
    """A growing table: rounds are added, and brought into one table every COMPACT rounds."""

    def __init__(self, first: DataFrame, name: str) -> None:
        self.parts, self.name = [first], name

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > COMPACT:
            whole = stored(self.rows(), self.name)
            for p in self.parts[:-1]:  # the last is the next round's frontier
                discard(p)
            self.parts = [whole]

    def rows(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.union(p)
        return out


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) that reach follows, of nodes(key, kind, owner) and edges(kind, source, target).

    Crossed kinds between known nodes, a member to its owner, and a type to its members where an entry point dispatches to it.
    """
    keys = nodes.select("key")
    crossed = edges.filter(F.col("kind").isin(*CROSSED)).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    owned = nodes.filter("kind = 'member' and owner <> ''").select(F.col("key").alias("src"), F.col("owner").alias("dst"))
    entries = nodes.filter("kind = 'entry_point'").select(F.col("key").alias("source"))
    targets = edges.filter("kind = 'dispatches'").join(entries, "source", "left_semi").select(F.col("target").alias("owner")).distinct()
    expanded = nodes.filter("kind = 'member'").join(targets, "owner").select(F.col("owner").alias("src"), F.col("key").alias("dst"))
    every = crossed.union(owned).union(expanded).filter("src <> dst").distinct()
    return every.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")


def reach_pairs(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, root, depth): each node a root reaches, itself at depth 0, with the least number of steps. Cycles end the walk."""
    edges = stored(edges.select("src", "dst").distinct(), "reach-edges")
    frontier = stored(roots.select(F.col("root").alias("node"), "root").distinct().withColumn("depth", F.lit(0)), "reach")
    seen, depth = _Seen(frontier, "reach"), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node"), "root").distinct()
        frontier = stored(step.join(seen.rows(), ["node", "root"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if frontier.isEmpty():
            break
        seen.add(frontier)
    discard(edges)
    return seen.rows()


def fanout(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("node").agg(F.count_distinct("root").alias("fanout"))


def shared_nodes(pairs: DataFrame, threshold: int = SHARED_ABOVE) -> DataFrame:
    return fanout(pairs).filter(F.col("fanout") > threshold).orderBy(F.desc("fanout"), "node")


def affects(pairs: DataFrame, changed: DataFrame, threshold: int = SHARED_ABOVE) -> DataFrame:
    """(root) that changed(node) reaches back to; nodes that too many roots share are left to shared_nodes."""
    hit = pairs.join(changed.select("node").distinct(), "node", "left_semi")
    wide = fanout(hit).filter(F.col("fanout") > threshold).select("node")
    return hit.join(wide, "node", "left_anti").select("root").distinct()


def shortest_path(edges: DataFrame, source, target, depth: int = PATH_DEPTH) -> DataFrame:
    """(step, node) of one shortest path; of several predecessors the smallest is kept. Empty if there is none within depth."""
    spark = edges.sparkSession
    edges = stored(edges.select("src", "dst").distinct(), "path-edges")
    kind = edges.schema["dst"].dataType.simpleString()
    seen = spark.range(1).select(F.lit(source).cast(kind).alias("node"), F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("level"))
    frontier, found = seen, source == target
    for level in range(1, depth + 1):
        if found:
            break
        step = frontier.join(edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = stored(step.join(seen, "node", "left_anti").select("node", "parent", F.lit(level).alias("level")), "path")
        if frontier.isEmpty():
            break
        seen, found = seen.union(frontier), not frontier.filter(F.col("node") == F.lit(target)).isEmpty()
    if not found:
        return spark.createDataFrame([], f"step int, node {kind}")
    path, at = [], target
    parents = seen.select("node", "parent", "level")
    while at is not None:  # one lookup a step, `depth` at most
        row = parents.filter(F.col("node") == F.lit(at)).first()
        path.append((row.level, at))
        at = row.parent
    return spark.createDataFrame(path, f"step int, node {kind}")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of its strongly connected component, for each node of edges.

    Nodes that no edge enters, or none leaves, are components of their own and are trimmed off, layer by layer from both ends. The rest goes through
    rounds of colouring: the smallest node that reaches a node colours it; what reaches back to the colour's own node
    within the colour is a component and leaves. Edges between colours then leave too, as no component crosses them.
    """
    inner = stored(edges.select("src", "dst").distinct(), "scc-edges")
    left = stored(inner.select(F.col("src").alias("node")).union(inner.select("dst")).distinct(), "scc-nodes")
    inner = stored(inner.filter("src <> dst"), "scc-inner")
    done = None
    while not left.isEmpty():
        while True:  # trim
            ends = inner.select(F.col("src").alias("node")).distinct().join(inner.select(F.col("dst").alias("node")).distinct(), "node")
            kept = stored(left.join(ends, "node", "left_semi"), "scc-nodes")
            single = stored(left.join(kept, "node", "left_anti").withColumn("component", F.col("node")), "scc-found")
            if single.isEmpty():
                break
            done = single if done is None else done.union(single)
            less = inner.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
            less = stored(less.select("src", "dst"), "scc-inner")
            discard(inner), discard(left)
            inner, left = less, kept
        if left.isEmpty():
            break
        colour = left.withColumn("c", F.col("node"))
        while True:
            pushed = inner.join(colour, inner["src"] == colour["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
            new = stored(colour.join(pushed, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("moved")), "scc-colour")
            # a colour's own colour is smaller or equal, so the way to it is halved each round
            own = new.select(F.col("node").alias("c"), F.col("c").alias("further"))
            last, colour = colour, stored(new.join(own, "c").select("node", F.col("further").alias("c"), (F.col("moved") | (F.col("further") < F.col("c"))).alias("moved")), "scc-colour")
            discard(new), discard(last)
            if colour.filter("moved").isEmpty():
                break
        same = inner.join(colour.select(F.col("node").alias("src"), F.col("c").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("c2")), "dst").filter("c1 = c2")
        back = reach_pairs(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.filter("node = c").select(F.col("node").alias("root")))
        found = stored(back.select("node", F.col("root").alias("component")), "scc-found")
        done = found if done is None else done.union(found)
        left = stored(left.join(found, "node", "left_anti"), "scc-nodes")
        inner = stored(same.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "scc-inner")
    return done if done is not None else left.withColumn("component", F.col("node"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) after exactly so many rounds; nodes without successors spread their rank evenly.

    Each round's ranks are written, as the next reads them twice: for what is given along edges and for what is spread.
    """
    edges = edges.select("src", "dst").distinct()
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = stored(edges.join(degree, "src"), "rank-links")
    base = stored(nodes.select("node").join(degree.withColumnRenamed("src", "node"), "node", "left"), "rank-nodes")
    rank = base.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        lost = rank.filter("degree is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")).scalar()
        given = links.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        new = F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)
        last, rank = rank, stored(base.join(given, "node", "left").select("node", "degree", new.alias("rank")), "rank")
        discard(last)
    return rank.select("node", "rank")


def owned_by_one(pairs: DataFrame) -> DataFrame:
    """(node, root) of nodes that exactly one root reaches, roots themselves left out."""
    others = pairs.filter(F.col("node") != F.col("root"))
    return others.groupBy("node").agg(F.min("root").alias("root"), F.count_distinct("root").alias("n")).filter("n = 1").select("node", "root")


def base_type_closure(direct: DataFrame) -> DataFrame:
    """(fqn, base): all transitive bases of direct(fqn, base). Unknown names enter and don't expand; the own name leaves."""
    pairs = reach_pairs(direct.select(F.col("fqn").alias("src"), F.col("base").alias("dst")), direct.select(F.col("fqn").alias("root")).distinct())
    return pairs.filter(F.col("node") != F.col("root")).select(F.col("root").alias("fqn"), F.col("node").alias("base"))
