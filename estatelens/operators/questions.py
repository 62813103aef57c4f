"""The fixed questions over a built index. Each answer says what it couldn't look up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, search

PAGE = 20
#: Kinds of nodes that an answer lists; their number and the totals cover all.
MOST_KINDS = 1000


@dataclass
class Answer:
    """rows, in order; total before the page was cut; and what has to be said with it."""

    rows: list[dict]
    total: int
    notes: dict


def _page(df: DataFrame, limit: int) -> tuple[list[dict], int]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()], df.count()


@dataclass
class Index:
    """nodes, edges, pairs(node, root), search rows, and the files that put an application together."""

    nodes: DataFrame
    edges: DataFrame
    pairs: DataFrame
    entries: DataFrame
    composition_roots: tuple[str, ...] = ()

    def affects(self, asked: Sequence[str], threshold: int = graph.SHARED_ABOVE, limit: int = PAGE) -> Answer:
        """Entry points that a change of these node keys or files reaches. Nodes that too many share are named, not spread out."""
        spark = self.nodes.sparkSession
        inputs = spark.createDataFrame([(a,) for a in dict.fromkeys(asked)], "asked string")
        by_key = inputs.join(self.nodes.select(F.col("key").alias("asked"), F.col("key").alias("node"), "file"), "asked")
        by_file = inputs.join(self.nodes.filter("file <> ''").select(F.col("file").alias("asked"), F.col("key").alias("node"), "file"), "asked").join(by_key.select("asked"), "asked", "left_anti")
        chosen = by_key.unionByName(by_file).cache()
        unknown = sorted(r.asked for r in inputs.join(chosen.select("asked").distinct(), "asked", "left_anti").collect())
        assembled = sorted({*unknown, *(r.file for r in chosen.select("file").distinct().filter(F.col("file").isin(*self.composition_roots or [""])).collect())} & set(self.composition_roots))
        wide = graph.fanout(self.pairs.join(chosen.select("node").distinct(), "node", "left_semi")).filter(F.col("fanout") > threshold).orderBy(F.desc("fanout"), "node")
        roots = graph.affects(self.pairs, chosen.select("node"), threshold)
        named = roots.join(self.nodes.select(F.col("key").alias("root"), "name", F.col("attributes")["entry_kind"].alias("kind")), "root", "left").orderBy("name", "root")
        rows, total = _page(named, limit)
        shared, n_shared = _page(wide, limit)
        why = "" if total else "composition root: a change here concerns all that is registered" if assembled else "only shared nodes" if shared else "none of the inputs is known" if len(unknown) == len(inputs.collect()) else "nothing reaches these nodes"
        chosen.unpersist()
        return Answer(rows, total, {"unknown": [u for u in unknown if u not in assembled], "shared": shared, "n_shared": n_shared, "composition_roots": assembled, "why_empty": why})

    def reaches(self, root: str, limit: int = PAGE) -> Answer:
        """What an entry point reaches, by kind, itself left out."""
        hit = self.pairs.filter((F.col("root") == root) & (F.col("node") != root)).join(self.nodes.select(F.col("key").alias("node"), "kind"), "node")
        totals = hit.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
        first = hit.withColumn("__n", F.row_number().over(Window.partitionBy("kind").orderBy("node"))).filter(F.col("__n") <= limit)
        shown = first.groupBy("kind").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
        rows, kinds = _page(totals.join(shown, "kind").orderBy("kind"), MOST_KINDS)
        total = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first().n
        return Answer(rows, total, {"known": not self.nodes.filter(F.col("key") == root).isEmpty(), "kinds": kinds})

    def card(self, key: str, threshold: int = graph.SHARED_ABOVE) -> Answer:
        """A node with its edges and how many roots reach it."""
        rows, total = _page(self.nodes.filter(F.col("key") == key), 1)
        if not rows:
            return Answer([], 0, {"near": [r["node"] for r in self.resolve(key).rows[:5]]})
        fan = graph.fanout(self.pairs.filter(F.col("node") == key)).first()
        out = _page(self.edges.filter(F.col("source") == key).select("kind", "target", "via").orderBy("kind", "target"), PAGE)
        into = _page(self.edges.filter(F.col("target") == key).select("kind", "source", "via").orderBy("kind", "source"), PAGE)
        n = fan.fanout if fan else 0
        return Answer(rows, total, {"fanout": n, "shared": n > threshold, "out": out, "in": into})

    def path(self, source: str, target: str, depth: int = graph.PATH_DEPTH) -> Answer:
        missing = [k for k in (source, target) if self.nodes.filter(F.col("key") == k).isEmpty()]
        if missing:
            return Answer([], 0, {"unresolved": missing})
        steps = graph.shortest_path(graph.adjacency(self.nodes, self.edges), source, target, depth).orderBy("step")
        rows, total = _page(steps, depth + 1)
        return Answer(rows, total, {} if rows else {"none_within": depth})

    def resolve(self, query: str, limit: int = search.LIMIT) -> Answer:
        rows, total = _page(search.resolve(self.entries, query, limit), limit)
        return Answer(rows, total, {"exact": any(r["how"] == "exact" for r in rows)})

    def overview(self) -> Answer:
        rows, total = _page(self.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy("kind"), MOST_KINDS)
        return Answer(rows, total, {"edges": {r.kind: r["count"] for r in self.edges.groupBy("kind").count().collect()}})
