"""Web workspaces: import resolution, route tables across files, receivers' types and calls from pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import routes
from ..functions.paths import clean
from ..plans.tables import bounded_broadcast, stored
from . import graph, links

SUFFIXES = ("", ".ts", ".tsx", ".d.ts", "/index.ts")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, source, file): imports(path, source) to files by suffix ladder; relative ones first, else by the longest alias.

    aliases(prefix, target): `@x/` to a folder. An import that leads to no file is external: file is null.
    """
    relative = F.col("source").startswith(".")
    here = clean(F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("source")))
    best = links.longest_prefix(imports.select("path", "source").distinct(), "source", aliases.select(F.regexp_replace("prefix", "/$", "").alias("prefix")), "prefix")
    joined = best.join(aliases.select(F.regexp_replace("prefix", "/$", "").alias("prefix"), "target"), "prefix", "left")
    base = F.when(relative, here).when(F.col("prefix").isNotNull(), clean(F.concat(F.regexp_replace("target", "/$", ""), F.expr("substring(source, length(prefix) + 1)"))))
    tried = joined.withColumn("__b", base).withColumn("__c", F.array(*(F.struct(F.lit(i).alias("rank"), F.concat("__b", F.lit(s)).alias("name")) for i, s in enumerate(SUFFIXES))))
    found = links.ranked_resolution(tried, ["path", "source"], F.col("__c"), files.select(F.col("path").alias("file")), "file")
    return found.select("path", "source", F.col("resolved").alias("file"))


def exported_names(names: DataFrame, re_exports: DataFrame) -> DataFrame:
    """(file, name, declared_in): what each file exports, its own declarations first, then through re-exports by depth, however deep.

    names(file, name): declarations. re_exports(file, target): files whose exports a file passes on; circles end.
    """
    re_exports = stored(re_exports.select("file", "target").distinct(), "re-exports")
    seen = stored(names.select("file", "name", F.col("file").alias("declared_in")).distinct(), "exports")
    frontier = seen
    while True:
        step = re_exports.join(frontier.withColumnRenamed("file", "target"), "target").groupBy("file", "name").agg(F.min("declared_in").alias("declared_in"))
        frontier = stored(step.join(seen, ["file", "name"], "left_anti"), "exports")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def expand_routes(rows: DataFrame) -> DataFrame:
    """(path, component, unresolved) of route tables. rows(table, path, component, spread): spread names another table.

    Tables that none refers to are roots. Each table is expanded once, under the smallest path of the least depth that reaches it, however deep; a
    reference to an unknown table stays as an unresolved row.
    """
    rows = stored(rows.select("table", "path", "component", "spread"), "route-rows")
    tables = rows.select("table").distinct()
    inner = rows.filter("spread is not null").select(F.col("spread").alias("table")).distinct()
    frontier = stored(tables.join(inner, "table", "left_anti").withColumn("prefix", F.lit("")), "routes")
    seen = frontier
    joined = lambda a, b: F.concat_ws("/", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    while True:
        step = rows.filter("spread is not null").join(frontier, "table").select(F.col("spread").alias("table"), joined(F.col("prefix"), F.col("path")).alias("prefix")).groupBy("table").agg(F.min("prefix").alias("prefix"))
        frontier = stored(step.join(tables, "table", "left_semi").join(seen.select("table"), "table", "left_anti"), "routes")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    placed = rows.join(seen, "table").withColumn("full", joined(F.col("prefix"), F.col("path")))
    lost = placed.filter("spread is not null").join(tables.withColumnRenamed("table", "spread"), "spread", "left_anti")
    return placed.filter("component is not null").select(F.col("full").alias("path"), "component", F.lit(False).alias("unresolved")).union(lost.select("full", F.col("spread"), F.lit(True))).distinct()


def usage_edges(usages: DataFrame, bindings: DataFrame, bases: DataFrame) -> DataFrame:
    """(type, member, target, method): usages(type, receiver, method, member) by what the receiver is bound to.

    bindings(type, name, target): the type's own first, else the inherited one of the smallest base. bases(type, base).
    """
    own = bindings.select("type", F.col("name").alias("receiver"), "target", F.lit("").alias("base"))
    inherited = bases.join(bindings.select(F.col("type").alias("base"), F.col("name").alias("receiver"), "target"), "base").select("type", "receiver", "target", "base")
    best = own.union(inherited).groupBy("type", "receiver").agg(F.min_by("target", F.struct("base", "target")).alias("target"))
    return usages.join(best, ["type", "receiver"]).select("type", "member", "target", "method").distinct()


def called_from(start: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(page, type, member, level, action): members that each page calls within depth, by the least level, then action.

    start(page, type, member); edges(type, member, to_type, to_member, action). An action is carried along the path.
    """
    frontier = stored(start.select("page", "type", "member").distinct().withColumn("level", F.lit(0)).withColumn("action", F.lit("")), "called")
    seen = frontier
    for level in range(1, depth + 1):
        j = frontier.join(edges, ["type", "member"]).select("page", F.col("to_type").alias("type"), F.col("to_member").alias("member"), F.coalesce(F.nullif(edges["action"], F.lit("")), frontier["action"]).alias("action"))
        step = j.groupBy("page", "type", "member").agg(F.min("action").alias("action")).withColumn("level", F.lit(level))
        frontier = stored(step.join(seen, ["page", "type", "member"], "left_anti").select(*seen.columns), "called")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def build_calls(calls: DataFrame, rewrites: DataFrame, registry_routes: Sequence[str] = (), discriminator: str = "listInnerName") -> tuple[DataFrame, DataFrame]:
    """(keys, unresolved) of calls(file, module, http_method, url, reason, member, line).

    rewrites(module, strip_prefix, add_prefix) apply by module. A registry's route keeps the named query parameter as
    discriminator. Calls without an address stay apart with their reason.
    """
    known = calls.filter("url is not null").join(bounded_broadcast(rewrites), "module", "left")
    path = routes.normalize_route(F.col("url"))
    strip, add = F.lower(F.regexp_replace(F.coalesce("strip_prefix", F.lit("")), "^/|/$", "")), F.lower(F.regexp_replace(F.coalesce("add_prefix", F.lit("")), "^/|/$", ""))
    has = lambda p, head: (head != "") & ((p == head) | F.startswith(p, F.concat(head, F.lit("/"))))
    cut = F.when(has(F.col("__p"), strip), F.regexp_replace(F.expr("substring(__p, length(__s) + 1)"), "^/", "")).otherwise(F.col("__p"))
    put = F.when((F.col("__a") != "") & ~has(F.col("__c"), F.col("__a")), F.concat_ws("/", "__a", F.nullif(F.col("__c"), F.lit("")))).otherwise(F.col("__c"))
    rows = known.withColumn("__p", path).withColumn("__s", strip).withColumn("__a", add).withColumn("__c", cut).withColumn("route", put)
    named = F.regexp_extract("url", rf"[?&]{discriminator}=([^&#]*)", 1)
    key = rows.withColumn("discriminator", F.when(F.col("route").isin(*registry_routes or [""]), named).otherwise(""))
    return key.select("file", F.upper("http_method").alias("http_method"), "route", "discriminator", "member", "line"), calls.filter("url is null").select("file", "reason", "member", "line")


def apply_overrides(found: DataFrame, added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routes, findings): routes(path, component) with manual ones added, then removed; removal wins.

    Findings: redundant (added, but found anyway), missing (removed, but not there) and ambiguous (removed without a path where
    the component has several).
    """
    mine = added.select("path", "component").distinct()
    both = found.select("path", "component").union(mine).distinct()
    redundant = mine.join(found.select("path", "component"), ["path", "component"], "left_semi").select(F.lit("redundant").alias("finding"), "path", "component")
    n = both.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    open_ = removed.filter("path is null").select("component").distinct().join(n, "component", "left")
    ambiguous = open_.filter("n > 1").select(F.lit("ambiguous"), F.lit(None).cast("string"), "component")
    whole = removed.filter("path is not null").select("path", "component").union(both.join(open_.filter("n = 1").select("component"), "component", "left_semi").select("path", "component"))
    missing = whole.join(both, ["path", "component"], "left_anti").select(F.lit("missing"), "path", "component").union(open_.filter("n is null").select(F.lit("missing"), F.lit(None).cast("string"), "component"))
    return both.join(whole, ["path", "component"], "left_anti"), redundant.union(missing).union(ambiguous)


def promote(nodes: DataFrame) -> DataFrame:
    """nodes(kind, n_routes, n_calls): a component with routes is a page, a service with calls an API service."""
    kind = F.when((F.col("kind") == "component") & (F.col("n_routes") > 0), "page").when((F.col("kind") == "service") & (F.col("n_calls") > 0), "api_service").otherwise(F.col("kind"))
    return nodes.withColumn("kind", kind)


def absorb(nodes: DataFrame, uses: DataFrame, features: DataFrame) -> DataFrame:
    """nodes(id, kind, path, impl_hash) with absorbed_by and inside_hash.

    A node under a feature's declared folder belongs to that feature; another to the one page that reaches it by
    uses(src, dst). Pages and features belong to no one; an owner's hash covers what it took in.
    """
    owners = nodes.filter("kind in ('page', 'feature')")
    free = nodes.filter("kind not in ('page', 'feature')")
    declared = links.longest_prefix(free.select("id", "path"), "path", features.select(F.col("folder").alias("folder")), "folder").filter("folder is not null")
    declared = declared.join(features.select("folder", F.col("id").alias("absorbed_by")), "folder").select("id", "absorbed_by")
    pairs = graph.reach_pairs(uses, owners.filter("kind = 'page'").select(F.col("id").alias("root")))
    single = graph.owned_by_one(pairs).select(F.col("node").alias("id"), F.col("root").alias("absorbed_by"))
    chosen = declared.union(single.join(declared.select("id"), "id", "left_anti").join(free.select("id"), "id", "left_semi"))
    out = nodes.join(chosen, "id", "left")
    inside = out.filter("absorbed_by is not null").groupBy(F.col("absorbed_by").alias("id")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("impl_hash")), "|"), 256).alias("inside_hash"))
    return out.join(inside, "id", "left")


def page_report(pages: DataFrame, routes_: DataFrame, called: DataFrame) -> DataFrame:
    """(page, n_routes, n_descendants, n_endpoints, unreached) of all pages: routes below theirs by segment, endpoints within reach."""
    mine = routes_.select(F.col("component").alias("page"), "path")
    cuts = routes_.select(F.col("path").alias("below"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))).alias("path")).filter("below <> path")
    below = mine.join(cuts, "path").groupBy("page").agg(F.count_distinct("below").alias("n_descendants"))
    own, ends = mine.groupBy("page").agg(F.count_distinct("path").alias("n_routes")), called.groupBy("page").agg(F.count_distinct("endpoint").alias("n_endpoints"))
    j = pages.select("page").distinct()
    for df in (own, below, ends):
        j = j.join(df, "page", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return j.select("page", zero("n_routes"), zero("n_descendants"), zero("n_endpoints"), (F.coalesce("n_routes", F.lit(0)) == 0).alias("unreached"))
