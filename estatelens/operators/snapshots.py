"""Snapshots of documents: differences, merges, freshness and the work queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The statuses in the order in which work is handed out.
STATUS_ORDER = ("broken", "missing", "stale", "drifted", "undeclared", "empty", "relocated", "orphan", "current")


def diff(old: DataFrame, new: DataFrame, key: str = "id", kind: str = "kind", path: str = "doc_path", signature: str = "signature_hash") -> DataFrame:
    """(key, change, was, now): added, removed, or the weightiest of reclassified, moved, signature_changed; equal rows go."""
    pick = lambda df, x: df.select(F.col(key), *(F.col(c).alias(f"{x}_{n}") for c, n in ((kind, "kind"), (path, "path"), (signature, "signature"))), F.lit(True).alias(f"in_{x}"))
    both = pick(old, "a").join(pick(new, "b"), key, "full_outer")
    differs = lambda n: ~F.col(f"a_{n}").eqNullSafe(F.col(f"b_{n}"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(differs("kind"), "reclassified").when(differs("path"), "moved").when(differs("signature"), "signature_changed")
    shown = lambda x: F.when(F.col("change") == "reclassified", F.col(f"{x}_kind").cast("string")).when(F.col("change") == "moved", F.col(f"{x}_path").cast("string"))
    return both.withColumn("change", change).filter("change is not null").select(key, "change", shown("a").alias("was"), shown("b").alias("now"))


def merge_scoped(previous: DataFrame, partial: DataFrame, in_scope: Column, key: str = "id") -> DataFrame:
    """Rows of previous outside the scope, and all of partial, which wins by key."""
    kept = previous.filter(~F.coalesce(in_scope, F.lit(False))).join(partial.select(key), key, "left_anti")
    return kept.unionByName(partial)


def merge_facts(previous: DataFrame, partial: DataFrame, in_scope: Column) -> DataFrame:
    """Facts of previous outside the scope and of partial inside it; repeated facts stay."""
    inside = F.coalesce(in_scope, F.lit(False))
    return previous.filter(~inside).unionByName(partial.filter(inside))


def first_wins(sources: Sequence[DataFrame], key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The union of ranked sources with a column verdict: kept, shadowed (by an earlier source) or duplicate (within its own)."""
    every = None
    for rank, df in enumerate(sources):
        ranked = df.withColumn("source_rank", F.lit(rank))
        every = ranked if every is None else every.unionByName(ranked)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("source_rank", *order))
    first = F.min("source_rank").over(Window.partitionBy(*key))
    verdict = F.when(F.col("__n") == 1, "kept").when(F.col("source_rank") > F.col("__first"), "shadowed").otherwise("duplicate")
    return every.withColumn("__n", place).withColumn("__first", first).withColumn("verdict", verdict).drop("__n", "__first")


def overlay(existing: DataFrame, added: DataFrame, key: str = "key") -> DataFrame:
    """Nodes(key, name, source, attributes) of both: the added name wins, sources are joined by +, attributes overlaid."""
    a, b = (df.select(key, *(F.col(c).alias(f"{x}_{c}") for c in ("name", "source", "attributes"))) for x, df in (("a", existing), ("b", added)))
    both = a.join(b, key, "full_outer")
    empty = F.create_map().cast("map<string,string>")
    mine, theirs = F.coalesce("a_attributes", empty), F.coalesce("b_attributes", empty)
    merged = F.map_concat(F.map_filter(mine, lambda k, _: ~F.map_contains_key(theirs, k)), theirs)
    return both.select(key, F.coalesce("b_name", "a_name").alias("name"), F.concat_ws("+", "a_source", "b_source").alias("source"), merged.alias("attributes"))


def freshness(nodes: DataFrame, documents: DataFrame, key: str = "id") -> DataFrame:
    """(key, status, agent_action) of nodes(kind, signature_hash, impl_hash) against documents.

    documents: empty_sections (int), accepted (boolean), accepted_kind, accepted_signature, accepted_impl, relocated
    (boolean), and perhaps review_reason. The first that holds: missing, empty, stale, undeclared, relocated (or marked for
    review), drifted, current. A null says no: what nobody accepted is undeclared.
    """
    docs = documents.withColumn("__doc", F.lit(True)).withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    marked = F.coalesce(F.col("review_reason") != "", F.lit(False)) if "review_reason" in documents.columns else F.lit(False)
    docs = docs.withColumn("relocated", F.coalesce("relocated", F.lit(False)) | marked)
    j = nodes.join(docs, key, "left")
    other = lambda mine, theirs: F.coalesce((F.col(theirs) != "") & (F.col(theirs) != F.col(mine)), F.lit(False))
    status = (
        F.when(F.col("__doc").isNull(), "missing").when(F.col("empty_sections") > 0, "empty").when(F.col("accepted") & other("signature_hash", "accepted_signature"), "stale").when(~F.col("accepted"), "undeclared")
        .when(F.col("relocated"), "relocated").when(other("kind", "accepted_kind"), "drifted").when(other("impl_hash", "accepted_impl"), "drifted").otherwise("current")
    )
    action = F.when(F.col("status").isin("missing", "empty", "stale"), "write").when(F.col("status") == "current", "skip").otherwise("review")
    return j.withColumn("status", status).select(key, "status", action.alias("agent_action"))


def worklist(plan: DataFrame, actions: Sequence[str] = ("write", "review"), teams: Sequence[str] = (), limit: int | None = None, path: str = "doc_path") -> tuple[DataFrame, bool]:
    """The queue in order of status, then path, and whether the limit cut it."""
    chosen = plan.filter(F.col("agent_action").isin(*actions))
    if teams:
        chosen = chosen.filter(F.col("team").isin(*teams))
    rank = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status"))
    ordered = chosen.orderBy(rank, path)
    if limit is None:
        return ordered, False
    return ordered.limit(limit), chosen.limit(limit + 1).count() > limit


def source_status(snapshot: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status) of recorded hashes against current ones: source_missing, no_hash, stale, current."""
    now = files.select("path", F.col("content_hash").alias("__now"))
    j = snapshot.join(now, "path", "left")
    status = F.when(F.col("__now").isNull(), "source_missing").when(F.coalesce("content_hash", F.lit("")) == "", "no_hash").when(F.col("content_hash") != F.col("__now"), "stale").otherwise("current")
    return j.select("path", status.alias("status"))


def cached_or_pending(files: DataFrame, cache: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Cached results whose path, content hash and parser version agree, and the files that are left to parse."""
    valid = cache.filter(F.col("parser_version") == version)
    hits = valid.join(files.select("path", "content_hash"), ["path", "content_hash"], "left_semi")
    return hits, files.join(hits.select("path"), "path", "left_anti")


def accepted_state(nodes: DataFrame, key: str = "id") -> DataFrame:
    """(key, accepted_signature, accepted_impl, accepted_kind, accepted_members) as the nodes are now: what a reviewer accepts.

    members(kind, name, modifiers) of a node count by name if they are public. No time is part of it, so accepting twice changes nothing.
    """
    public = F.filter("members", lambda m: F.array_contains(m["modifiers"], "public"))
    return nodes.select(key, F.col("signature_hash").alias("accepted_signature"), F.col("impl_hash").alias("accepted_impl"), F.col("kind").alias("accepted_kind"), F.array_sort(F.array_distinct(F.transform(public, lambda m: m["name"]))).alias("accepted_members"))


def cache_put(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache with results in place of what it held for their paths."""
    return cache.join(results.select("path").distinct(), "path", "left_anti").unionByName(results)


def cache_prune(cache: DataFrame, files: DataFrame) -> DataFrame:
    """The cache without files that are no longer there."""
    return cache.join(files.select("path").distinct(), "path", "left_semi")
