"""The whole way: from source files to a snapshot of symbols, documentation nodes and facts, and from that to an index that answers questions.

``scan`` reads files once, keeps what was parsed in a table that every later step reads, and returns a Snapshot. With a scope
it parses the files inside only: symbols of the files outside come from the cache, nodes and facts outside from the previous snapshot.
``build`` puts the graph together stage by stage and counts what each stage made and left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import in_scope
from ..plans.tables import stored
from ..sources import csharp, registries, sqltext, typescript
from . import binding, graph, links, questions, rules, search, seams, snapshots, symbols, web

#: Names a scan's result to the parse cache; it changes whenever the scanner's rows do.
PARSER_VERSION = "csharp-1"


@dataclass
class Snapshot:
    """parsed: a row for each file. file_modules(path, module). modules(module, project_file, domain, ...). symbols with their resolved bases.
    nodes: decided symbols with state, kind and doc_path. The rest are facts by file, and counters(what, n)."""

    parsed: DataFrame
    file_modules: DataFrame
    modules: DataFrame
    symbols: DataFrame
    nodes: DataFrame
    endpoints: DataFrame
    dependencies: DataFrame
    registrations: DataFrame
    handlers: DataFrame
    sends: DataFrame
    tables: DataFrame
    sql_usages: DataFrame
    sql_objects: DataFrame
    counters: DataFrame

    def stored(self) -> Snapshot:
        """The same, each part written to a table of the shared folder."""
        return Snapshot(**{f.name: stored(getattr(self, f.name), f"snapshot-{f.name}") for f in fields(self)})


def parse(files: DataFrame, cache: DataFrame | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Parse results of the C# files(path, text, content_hash), with parser_version; files that the cache holds as they are now aren't read.

    cache: what an earlier call returned. With a scope, files outside come from the cache alone, in whatever state it has them.
    """
    mine = files.filter(F.lower("path").endswith(".cs") & in_scope(F.col("path"), list(scope)))
    if cache is None:
        return csharp.parse_files(mine).withColumn("parser_version", F.lit(PARSER_VERSION))
    hits, pending = snapshots.cached_or_pending(mine, cache, PARSER_VERSION)
    out = hits.unionByName(csharp.parse_files(pending).withColumn("parser_version", F.lit(PARSER_VERSION)))
    if scope:
        outside = cache.filter(~in_scope(F.col("path"), list(scope)) & (F.col("parser_version") == PARSER_VERSION))
        out = out.unionByName(outside.join(files.select("path"), "path", "left_semi"))
    return out


def _modules(files: DataFrame, domains: Sequence[tuple[str, str]]) -> DataFrame:
    found = registries.projects(files)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.csproj$", "")
    rows = found.select(name.alias("module"), F.col("path").alias("project_file"), F.regexp_replace("path", "/?[^/]*$", "").alias("directory"), "target_frameworks", "project_references", "package_references")
    return symbols.domains(rows, domains)


def _decided(s: DataFrame, modules: DataFrame, excludes: Sequence[rules.Rule], kinds: Sequence[rules.Rule], require_public: bool) -> DataFrame:
    """Symbols with what rules look at, and what they decide."""
    d = modules.groupBy("module").agg(F.min("domain").alias("domain"))
    shaped = s.join(d, "module", "left").select(
        "key", "module", "fqn", "name", "type_kind", F.coalesce("namespace", F.lit("")).alias("namespace"), "modifiers", F.transform("attributes", lambda a: a["name"]).alias("attributes"), F.col("base_types_raw").alias("base_types"), "base_type_closure",
        F.transform("sources", lambda x: x["path"]).alias("paths"), F.array_distinct(F.flatten(F.transform("members", lambda m: F.transform(m["attributes"], lambda a: a["name"])))).alias("member_attributes"), F.lit("").alias("kind"), F.coalesce("domain", "module").alias("domain"),
        "signature_hash", "impl_hash",
    )
    return rules.classify(shaped.drop("kind"), excludes, kinds, rules.symbol_predicates(), require_public)


def scan(
    files: DataFrame, kinds: Sequence[rules.Rule], excludes: Sequence[rules.Rule] = (), require_public: bool = False, domains: Sequence[tuple[str, str]] = (), interfaces: Sequence[str] = (), sql_methods: Sequence[str] = (),
    scope: Sequence[str] = (), previous: Snapshot | None = None, cache: DataFrame | None = None,
) -> Snapshot:
    """Files(path, text, content_hash) to a Snapshot. kinds and excludes: rules over symbols; the rest is configuration.

    With a scope, nodes and facts outside it are those of previous; without previous there are none outside.
    """
    parsed = stored(parse(files, cache, scope), "scan-parsed")
    modules = stored(_modules(files, domains), "scan-modules")
    file_modules = stored(links.nearest_ancestor(parsed.select("path").distinct(), "path", modules, "directory", "module"), "scan-files")
    built = stored(symbols.build_symbols(parsed, file_modules), "scan-symbols")
    closures = symbols.base_closures(built, symbols.resolve_bases(built))
    whole = stored(built.join(closures, "fqn", "left"), "scan-closed")
    decided = _decided(whole, modules, excludes, kinds, require_public)
    ids = decided.filter("state = 'classified'").withColumn("id", F.col("key"))
    nodes = stored(decided.join(symbols.doc_paths(ids.select("id", "module", "kind", "name")).select(F.col("id").alias("key"), "doc_path"), "key", "left"), "scan-nodes")
    registrations = parsed.select(F.col("path").alias("file"), F.inline("registrations"))
    handlers = stored(symbols.dispatch_handlers(whole, interfaces), "scan-handlers") if interfaces else symbols.dispatch_handlers(whole, [""])
    facts = {
        "registrations": registrations, "sends": symbols.dispatch_sends(parsed, handlers), "tables": symbols.table_literals(parsed), "sql_usages": symbols.sql_usages(parsed, list(sql_methods) or [""]),
        "sql_objects": sqltext.sql_objects(files.filter(F.lower("path").endswith(".sql"))),
    }
    if scope:
        inside = in_scope(F.col("path"), list(scope))
        own = F.exists("paths", lambda p: in_scope(p, list(scope)))
        facts = {k: v.filter(in_scope(F.col("file" if k == "registrations" else "path"), list(scope))) for k, v in facts.items()}
        part = nodes.filter(own)
        if previous is not None:
            nodes = stored(snapshots.merge_scoped(previous.nodes, part, own, "key"), "scan-nodes")
            facts = {k: snapshots.merge_facts(getattr(previous, k), v, in_scope(F.col("file"), list(scope)) if k == "registrations" else inside) for k, v in facts.items()}
        else:
            nodes = part
    count = lambda df, what: df.agg(F.count(F.lit(1)).cast("long").alias("n")).select(F.lit(what).alias("what"), "n")
    total = lambda column, what: parsed.agg(F.coalesce(F.sum(column), F.lit(0)).cast("long").alias("n")).select(F.lit(what).alias("what"), "n")
    counters = count(parsed, "files").union(total(F.coalesce("parse_errors", F.lit(0)), "parse_errors")).union(total(F.coalesce(F.size("declarations"), F.lit(0)), "declarations")).union(count(built, "symbols")).union(count(modules, "modules")).union(count(nodes.filter("state = 'classified'"), "nodes"))
    counters = counters.union(nodes.groupBy("state").agg(F.count(F.lit(1)).cast("long").alias("n")).select(F.concat(F.lit("state:"), "state"), "n"))
    return Snapshot(parsed, file_modules, modules, whole, nodes, symbols.endpoints(whole), symbols.dependencies(whole, registrations), facts["registrations"], handlers, facts["sends"], facts["tables"], facts["sql_usages"], facts["sql_objects"], stored(counters, "scan-counters"))


def reachable_projects(modules: DataFrame) -> DataFrame:
    """(module, reached): the modules that each module's project refers to, itself included, however far."""
    of = modules.select(F.col("project_file").alias("target"), F.col("module").alias("dst"))
    direct = modules.select(F.col("module").alias("src"), F.explode("project_references").alias("target")).join(of, "target").select("src", "dst")
    pairs = graph.reach_pairs(direct, modules.select(F.col("module").alias("root")))
    return pairs.select(F.col("root").alias("module"), F.col("node").alias("reached"))


def _calls(external: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of an external index whose ends are named by (file, name) brought to our members' keys, where a name is the only one of its file."""
    m = nodes.filter("kind = 'member'").groupBy("file", "name").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    end = lambda x: m.select(F.col("file").alias(f"{x}_file"), F.col("name").alias(f"{x}_name"), F.col("key").alias(x))
    j = external.join(end("source"), ["source_file", "source_name"]).join(end("target"), ["target_file", "target_name"])
    return j.select(F.lit("calls").alias("kind"), "source", "target", F.lit("external").alias("via"), F.lit(1.0).alias("confidence")).distinct()


def build(snapshot: Snapshot, calls: DataFrame | None = None, composition_roots: Sequence[str] = (), reached: bool = True) -> tuple[questions.Index, DataFrame]:
    """(index, counts(stage, what, n)): the graph of a snapshot, stage by stage, with what each stage made and why it made no more.

    calls(source_file, source_name, target_file, target_name): calls that an external index knows. Registrations bind a type only to
    implementations in projects that theirs refers to (if reached and there are projects). HTTP endpoints are the entry points.
    """
    nodes, edges = symbols.symbol_graph(snapshot.symbols)
    nodes = stored(nodes, "build-nodes")
    counts = [edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("symbols").alias("stage"), F.lit("inherits").alias("what"), "n")]
    own = lambda df, stage: df.groupBy(F.lit(stage).alias("stage"), F.col("kind").alias("what")).agg(F.count(F.lit(1)).alias("n"))

    bound, why = binding.binds(snapshot.registrations, nodes)
    if reached and not snapshot.modules.isEmpty():
        of = nodes.filter("kind = 'type'").select("key", F.col("attributes")["module"].alias("module"))
        pairs = bound.join(of.select(F.col("key").alias("source"), F.col("module").alias("m1")), "source").join(of.select(F.col("key").alias("target"), F.col("module").alias("m2")), "target")
        where = snapshot.registrations.join(snapshot.file_modules.select(F.col("path").alias("file"), F.col("module").alias("at")), "file").select("at").distinct()
        near = reachable_projects(snapshot.modules).join(where.withColumnRenamed("at", "module"), "module").select(F.col("reached").alias("m2")).distinct()
        kept = pairs.join(near, "m2", "left_semi").select(*bound.columns)
        far = bound.join(kept.select("source", "target"), ["source", "target"], "left_anti")
        counts.append(far.agg(F.count(F.lit(1)).alias("n")).select(F.lit("binds").alias("stage"), F.lit("out_of_reach").alias("what"), "n"))
        bound = kept
    bound = stored(bound, "build-binds")
    counts.append(why.select(F.lit("binds").alias("stage"), F.col("reason").alias("what"), "n"))

    known = _calls(calls, nodes) if calls is not None else bound.limit(0)
    known = stored(known, "build-calls")
    completed = stored(binding.complete(nodes, known, bound), "build-completed")
    members = nodes.filter("kind = 'member'").select(F.col("file").alias("path"), F.col("name").alias("member"), F.col("key").alias("m"))
    sends = snapshot.sends.join(members, ["path", "member"]).select(F.col("m").alias("member"), "request")
    sent = stored(binding.dispatch(sends, snapshot.handlers, nodes), "build-dispatch")
    types = nodes.filter("kind = 'type'").select(F.col("key").alias("target"), F.col("attributes")["fqn"].alias("fqn"))
    ends = snapshot.endpoints.withColumn("entry", F.concat(F.lit("entry:"), F.col("http_method"), F.lit(" "), F.col("route")))
    entries = ends.select(
        F.col("entry").alias("key"), F.lit("entry_point").alias("kind"), F.substring("entry", 7, 1 << 16).alias("name"), F.lit("").alias("owner"), F.lit("").alias("file"), F.lit("csharp").alias("lang"), F.lit("endpoint").alias("source"),
        F.map_from_arrays(F.array(F.lit("entry_kind")), F.array(F.lit("http"))).alias("attributes"),
    ).dropDuplicates(["key"])
    started = ends.join(types, "fqn").select(F.lit("dispatches").alias("kind"), F.col("entry").alias("source"), "target", F.lit("endpoint").alias("via"), F.lit(1.0).alias("confidence")).distinct()
    for stage, df in (("binds", bound), ("calls", known), ("complete", completed), ("dispatch", sent), ("entries", started)):
        counts.append(own(df, stage))
    parts = [(nodes, edges), (entries, started)] + [(nodes.limit(0), e.select(*edges.columns)) for e in (bound, known, completed, sent)]
    kept, inner, totals = binding.assemble(parts)
    kept, inner = stored(kept, "index-nodes"), stored(inner, "index-edges")
    crossing = seams.service_seams(kept, inner).select(*inner.columns)
    inner = stored(inner.unionByName(crossing), "index-edges")
    pairs = graph.reach_pairs(graph.adjacency(kept, inner), kept.filter("kind = 'entry_point'").select(F.col("key").alias("root")))
    counts.append(totals.select(F.lit("assemble").alias("stage"), "what", "n"))
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return questions.Index(kept, inner, pairs, search.entries(kept), tuple(composition_roots)), stored(out, "build-counts")


@dataclass
class WebSnapshot:
    """parsed: a row for each file. symbols with module and fqn (file and name). nodes: decided symbols with routes and calls counted, promoted
    kinds, and who absorbs them. calls and unresolved by file; routes of components; uses(src, dst, method) between symbols."""

    parsed: DataFrame
    symbols: DataFrame
    nodes: DataFrame
    calls: DataFrame
    unresolved: DataFrame
    routes: DataFrame
    uses: DataFrame


def web_symbols(parsed: DataFrame, modules: DataFrame) -> DataFrame:
    """(fqn, name, module, path, start, end, ...) of the declarations of parsed files, by the module with the deepest source root; others go.

    modules(module, source_root).
    """
    rows = links.longest_prefix(parsed.select("path", "declarations"), "path", modules.select(F.regexp_replace("source_root", "/$", "").alias("source_root")), "source_root")
    placed = rows.join(modules.select(F.regexp_replace("source_root", "/$", "").alias("source_root"), "module"), "source_root").select("path", "module", F.explode("declarations").alias("d"))
    fqn = F.concat(F.regexp_replace("path", r"\.tsx?$", ""), F.lit("#"), F.col("d.name"))
    return placed.select(
        fqn.alias("fqn"), "module", "path", F.col("d.name").alias("name"), F.col("d.type_kind").alias("type_kind"), F.col("d.modifiers").alias("modifiers"), F.col("d.base_types").alias("base_types"), F.col("d.attributes").alias("decorators"),
        F.col("d.members").alias("members"), F.col("d.bindings").alias("bindings"), F.col("d.start").alias("start"), F.col("d.end").alias("end"), F.col("d.decl_hash").alias("impl_hash"),
    ).dropDuplicates(["fqn"])


def web_names(parsed: DataFrame, symbols_: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, local, fqn): what each name in a file stands for: its own declarations first, then what it imports, followed through re-exports."""
    imports = parsed.select("path", F.inline("imports"))
    files = parsed.select("path")
    found = stored(web.resolve_imports(imports.select("path", "source").distinct(), files, aliases).filter("file is not null"), "web-imports")
    passed = imports.filter("re_export and star").join(found, ["path", "source"]).select(F.col("path").alias("file"), F.col("file").alias("target"))
    exported = web.exported_names(symbols_.select(F.col("path").alias("file"), "name"), passed)
    named = imports.filter("not re_export").join(found, ["path", "source"]).select("path", "file", F.inline("names")).join(exported.select("file", F.col("name").alias("imported"), "declared_in"), ["file", "imported"])
    own = symbols_.select("path", F.col("name").alias("local"), "fqn", F.lit(0).alias("rank"))
    through = named.join(symbols_.select(F.col("path").alias("declared_in"), F.col("name").alias("imported"), "fqn"), ["declared_in", "imported"]).select("path", "local", "fqn", F.lit(1).alias("rank"))
    return own.union(through).groupBy("path", "local").agg(F.min_by("fqn", F.struct("rank", "fqn")).alias("fqn"))


def scan_web(
    files: DataFrame, modules: DataFrame, kinds: Sequence[rules.Rule], excludes: Sequence[rules.Rule] = (), aliases: DataFrame | None = None, rewrites: DataFrame | None = None, features: DataFrame | None = None, registry_routes: Sequence[str] = (),
) -> WebSnapshot:
    """TypeScript files(path, text, content_hash) to a WebSnapshot.

    modules(module, source_root), aliases(prefix, target), rewrites(module, strip_prefix, add_prefix), features(id, folder). A call belongs to
    the symbol whose lines hold it, not to the page that leads there. A route's component is the symbol of that name in its file's names.
    """
    spark = files.sparkSession
    empty = lambda ddl: spark.createDataFrame([], ddl)
    aliases = aliases if aliases is not None else empty("prefix string, target string")
    rewrites = rewrites if rewrites is not None else empty("module string, strip_prefix string, add_prefix string")
    features = features if features is not None else empty("id string, folder string")
    parsed = stored(typescript.parse_files(files.filter(F.col("path").rlike(r"\.tsx?$") & ~F.col("path").rlike(r"\.(d|spec)\.tsx?$"))), "web-parsed")
    s = stored(web_symbols(parsed, modules), "web-symbols")
    names = stored(web_names(parsed, s, aliases), "web-names")
    lines = s.select("path", "fqn", "start", "end")

    def placed(column: str) -> DataFrame:
        rows = parsed.select("path", F.posexplode(column).alias("at", "x")).select("path", "at", F.col("x.line").alias("line"), "x")
        owner = links.narrowest_interval(rows.select("path", "at", "line"), lines, ["path"], "line", "start", "end", "fqn", ["path", "at"])
        return rows.join(owner, ["path", "at"]).select("path", "fqn", "x.*")

    calls_in = placed("http_calls").join(s.select("fqn", "module"), "fqn").withColumn("file", F.col("fqn"))
    calls, unresolved = web.build_calls(calls_in.select("file", "module", "http_method", "url", "reason", "member", "line"), rewrites, list(registry_routes))
    calls = stored(calls.withColumnRenamed("file", "fqn"), "web-calls")
    bound = s.select("path", "fqn", F.explode("bindings").alias("b")).select("path", "fqn", F.col("b.name").alias("receiver"), F.regexp_extract("b.type", r"^\s*([\w$]+)", 1).alias("local")).join(names.withColumnRenamed("fqn", "target"), ["path", "local"])
    bases = s.select("path", "fqn", F.explode("base_types").alias("raw")).withColumn("local", F.regexp_extract("raw", r"^\s*([\w$]+)", 1)).join(names.withColumnRenamed("fqn", "base"), ["path", "local"]).select(F.col("fqn").alias("type"), "base")
    used = placed("usages").select(F.col("fqn").alias("type"), "receiver", "method", "member")
    uses = web.usage_edges(used, bound.select(F.col("fqn").alias("type"), F.col("receiver").alias("name"), "target"), bases).filter("type <> target")
    uses = stored(uses.select(F.col("type").alias("src"), F.col("target").alias("dst"), "method").distinct(), "web-uses")
    known = names.select(F.col("path").alias("file"), F.col("local").alias("component"), "fqn")
    table = parsed.select(F.col("path").alias("file"), F.explode("routes").alias("r")).select("file", "r.table", "r.path", "r.component", "r.spread")
    table = table.join(known, ["file", "component"], "left").select("table", "path", F.coalesce("fqn", "component").alias("component"), "spread")
    routes_ = stored(web.expand_routes(table), "web-routes")

    shaped = s.select(
        "fqn", "module", "name", "type_kind", F.regexp_replace("path", "/[^/]*$", "").alias("namespace"), "modifiers", F.transform("decorators", lambda a: a["name"]).alias("attributes"), "base_types", F.col("base_types").alias("base_type_closure"), F.array("path").alias("paths"),
        F.array().cast("array<string>").alias("member_attributes"), F.col("module").alias("domain"), "path", "impl_hash",
    )
    decided = rules.classify(shaped, excludes, kinds, rules.symbol_predicates()).filter("state = 'classified'")
    n_routes = routes_.filter("not unresolved").groupBy(F.col("component").alias("fqn")).agg(F.count_distinct("path").alias("n_routes"))
    n_calls = calls.groupBy("fqn").agg(F.count(F.lit(1)).alias("n_calls"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    counted = decided.join(n_routes, "fqn", "left").join(n_calls, "fqn", "left").withColumn("n_routes", zero("n_routes")).withColumn("n_calls", zero("n_calls"))
    promoted = web.promote(counted).select(F.col("fqn").alias("id"), "kind", "path", "impl_hash", "module", "name", "n_routes", "n_calls", "matched_rules")
    wings = features.select("id", F.lit("feature").alias("kind"), F.col("folder").alias("path"), F.lit("").alias("impl_hash"))
    every = stored(promoted.unionByName(wings, allowMissingColumns=True), "web-promoted")
    nodes = stored(web.absorb(every, uses.select("src", "dst"), features), "web-nodes")
    return WebSnapshot(parsed, s, nodes, calls, unresolved, routes_, uses)
