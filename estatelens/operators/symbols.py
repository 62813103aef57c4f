"""From parsed files to symbols, their resolved bases, endpoints, dependencies and documentation nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signatures, text
from ..plans.ship import ship
from ..functions.routes import combine_templates, normalize_route
from . import graph, links

#: Attributes that make a method an endpoint, with their HTTP methods.
VERBS = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH", "HttpHead": "HEAD"}


def declarations(parsed: DataFrame, file_modules: DataFrame) -> DataFrame:
    """One row for each declaration with its module, fqn, arity and symbol key; files without a module go."""
    rows = parsed.select("path", "usings", F.explode("declarations").alias("d")).join(file_modules.select("path", "module"), "path")
    fqn = F.concat_ws(".", F.nullif(F.col("d.namespace"), F.lit("")), F.nullif(F.col("d.containing_type"), F.lit("")), F.col("d.name"))
    arity = F.size("d.type_parameters")
    return rows.select("path", "module", "usings", "d", fqn.alias("fqn"), arity.alias("arity"), text.symbol_key(F.col("module"), fqn, arity).alias("key"))


def build_symbols(parsed: DataFrame, file_modules: DataFrame) -> DataFrame:
    """Partial declarations as one symbol: scalars of the first by (path, line), sets united, members in order.

    impl_hash covers the parts' hashes in order, signature_hash the shape without lines and paths.
    """
    d = declarations(parsed, file_modules)
    shared = parsed.join(file_modules.select("path", "module"), "path").groupBy("module").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("global_usings")))).alias("global_usings"))
    first = lambda c: F.min_by(c, F.struct("path", F.col("d.start")))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    members = F.sort_array(F.flatten(F.collect_list(F.transform("d.members", lambda m: F.struct(F.col("path").alias("path"), m["line"].alias("line"), m["name"].alias("name"), m["kind"].alias("kind"), m["signature"].alias("signature"), m["end_line"].alias("end_line"), m["modifiers"].alias("modifiers"), F.transform(m["attributes"], lambda a: F.struct(a["name"].alias("name"), a["args"].alias("args"))).alias("attributes"))))))
    grouped = d.groupBy("key", "module", "fqn", "arity").agg(
        first("d.name").alias("name"), first("d.type_kind").alias("type_kind"), first("d.namespace").alias("namespace"), united("d.modifiers").alias("modifiers"), first("d.type_parameters").alias("type_parameters"),
        united("d.base_types").alias("base_types_raw"), united("usings").alias("usings"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("d.attributes", lambda a: F.struct(a["name"].alias("name"), a["args"].alias("args"))))))).alias("attributes"),
        members.alias("members"), F.array_sort(F.collect_set(F.struct("path", F.col("d.start").alias("start"), F.col("d.end").alias("end")))).alias("sources"), first("d.xml_doc").alias("xml_doc"), F.array_sort(F.collect_list("d.decl_hash")).alias("hashes"),
    )
    shape = F.to_json(F.struct("arity", F.array_sort("attributes").alias("attributes"), "base_types_raw", "fqn", F.array_sort(F.transform("members", lambda m: F.struct(m["kind"].alias("kind"), m["modifiers"].alias("modifiers"), m["signature"].alias("signature")))).alias("members"), "modifiers", "type_kind"))
    out = grouped.join(shared, "module", "left").withColumn("usings", F.array_union("usings", F.coalesce("global_usings", F.array().cast("array<string>"))))
    return out.withColumn("impl_hash", text.content_hash(F.array_join("hashes", "\n"))).withColumn("signature_hash", text.content_hash(shape)).drop("hashes", "global_usings")


def resolve_bases(symbols: DataFrame) -> DataFrame:
    """(key, raw, resolved, ambiguous): exact name, then enclosing namespaces from the longest, then usings; else as written.

    Several usings that fit make it ambiguous; the smallest name is taken.
    """
    wanted = symbols.select("key", "fqn", "namespace", "usings", F.explode("base_types_raw").alias("raw")).withColumn("bare", text.strip_generics(F.col("raw")))
    spaces = text.namespace_prefixes(F.coalesce("namespace", F.lit("")))
    ranked = F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), F.col("bare").alias("name"))), F.transform(spaces, lambda p, i: F.struct((i + 1).alias("rank"), F.concat_ws(".", F.nullif(p, F.lit("")), F.col("bare")).alias("name"))),
        F.transform("usings", lambda u: F.struct(F.lit(1000).alias("rank"), F.concat_ws(".", u, F.col("bare")).alias("name"))),
    )
    found = links.ranked_resolution(wanted.withColumn("__c", ranked), ["key", "raw", "bare"], F.col("__c"), symbols, "fqn")
    return found.select("key", "raw", F.coalesce("resolved", "bare").alias("resolved"), (F.coalesce("ambiguous", F.lit(False)) & (F.col("rank") == 1000)).alias("ambiguous"))


def base_closures(symbols: DataFrame, bases: DataFrame) -> DataFrame:
    """(fqn, base_type_closure) of all symbols, sorted; empty for those without bases."""
    direct = bases.join(symbols.select("key", "fqn"), "key").select("fqn", F.col("resolved").alias("base"))
    pairs = graph.base_type_closure(direct).groupBy("fqn").agg(F.array_sort(F.collect_set("base")).alias("base_type_closure"))
    return symbols.select("fqn").distinct().join(pairs, "fqn", "left").select("fqn", F.coalesce("base_type_closure", F.array().cast("array<string>")).alias("base_type_closure"))


def endpoints(symbols: DataFrame) -> DataFrame:
    """(key, fqn, member, http_method, route, line) of methods with an HTTP attribute; routes are normalised."""
    argument = lambda attributes, name: F.get(F.transform(F.filter(attributes, lambda a: a["name"] == name), lambda a: F.coalesce(F.get(a["args"], F.lit(0)), F.lit(""))), F.lit(0))
    rows = symbols.select("key", "fqn", "name", argument(F.col("attributes"), "Route").alias("base"), F.explode("members").alias("m")).withColumn("own", argument(F.col("m.attributes"), "Route"))
    verbs = F.create_map(*(F.lit(x) for pair in VERBS.items() for x in pair))
    rows = rows.withColumn("a", F.explode(F.filter("m.attributes", lambda a: a["name"].isin(*VERBS))))
    template = F.coalesce(F.nullif(F.get(F.col("a.args"), F.lit(0)), F.lit("")), "own", F.lit(""))
    route = combine_templates(F.coalesce("base", F.lit("")), template, F.col("name"), F.col("m.name"))
    return rows.select("key", "fqn", F.col("m.name").alias("member"), F.try_element_at(verbs, F.col("a.name")).alias("http_method"), normalize_route(route).alias("route"), F.col("m.line").alias("line"))


def type_lookup(symbols: DataFrame) -> DataFrame:
    """(simple, fqn): the smallest full name that each simple name stands for."""
    return symbols.groupBy(F.col("name").alias("simple")).agg(F.min("fqn").alias("short_fqn"))


def dependencies(symbols: DataFrame, registrations: DataFrame) -> DataFrame:
    """(fqn, target, via, confidence): constructor parameters' types and registered services, distinct.

    A name is taken as a full name if there is one, else as the smallest that ends with it; else it is external, with low
    confidence. A type registered as itself is no dependency.
    """
    ctor = symbols.select("fqn", F.explode("members").alias("m")).filter("m.kind = 'constructor'")
    inside = F.regexp_extract("m.signature", r"\((.*)\)", 1)
    parts = F.split(text.strip_generics(inside), ",")
    wanted = ctor.select("fqn", F.explode(parts).alias("p")).select("fqn", F.regexp_extract("p", r"([\w.]+)\??(?:\[\])?\s+\w+(?:\s*=.*)?\s*$", 1).alias("raw"), F.lit("constructor").alias("via")).filter("raw <> ''")
    services = registrations.filter("impl_type is not null and impl_type <> service_type").select(text.strip_generics(F.col("impl_type")).alias("impl"), text.strip_generics(F.col("service_type")).alias("raw"))
    by_name = type_lookup(symbols)
    di = services.join(by_name, F.element_at(F.split("impl", r"\."), -1) == F.col("simple")).select(F.col("short_fqn").alias("fqn"), "raw", F.lit("di").alias("via"))
    known = symbols.select(F.col("fqn").alias("exact")).distinct()
    tried = wanted.union(di).distinct().join(known, F.col("raw") == F.col("exact"), "left").join(by_name, F.element_at(F.split("raw", r"\."), -1) == F.col("simple"), "left")
    target = F.coalesce("exact", "short_fqn", "raw")
    return tried.select("fqn", target.alias("target"), "via", F.when(F.coalesce("exact", "short_fqn").isNull(), "low").otherwise("high").alias("confidence")).filter("fqn <> target").distinct()


def doc_paths(nodes: DataFrame, root: str = "docs/modules") -> DataFrame:
    """nodes(id, module, kind, name) with doc_path; where paths collide, every one of them gets eight digits of its id's hash."""
    plain = F.concat_ws("/", F.lit(root), "kind", "module", text.slug(F.col("name")))
    crowded = F.count(F.lit(1)).over(Window.partitionBy("__p")) > 1
    return nodes.withColumn("__p", plain).withColumn("doc_path", F.concat("__p", F.when(crowded, F.concat(F.lit("-"), F.substring(F.sha2("id", 256), 1, 8))).otherwise(""), F.lit(".md"))).drop("__p")


def domains(modules: DataFrame, globs: Sequence[tuple[str, str]]) -> DataFrame:
    """modules(module) with domain: of the first glob that fits in the order of domain names; else the module's own name."""
    from ..functions.paths import glob_regex

    choice = F.lit(None).cast("string")
    for domain, glob in sorted(globs, reverse=True):
        choice = F.when(F.col("module").rlike(glob_regex(glob)), F.lit(domain)).otherwise(choice)
    return modules.withColumn("domain", F.coalesce(choice, F.col("module")))


def member_ranges(symbols: DataFrame) -> DataFrame:
    """(file, start, end, member) for links.narrowest_interval."""
    m = symbols.select("key", F.explode("members").alias("m"))
    return m.select(F.col("m.path").alias("file"), F.col("m.line").alias("start"), F.col("m.end_line").alias("end"), F.concat("key", F.lit("."), F.col("m.name")).alias("member"))


def symbol_graph(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph nodes of types and their members, and edges of inheritance by resolved name.

    A member's key has its name and a fingerprint of its kind and parameter types, so renaming a parameter keeps it.
    """
    ship(symbols.sparkSession)
    types = symbols.select(F.concat(F.lit("type:"), "key").alias("key"), F.lit("type").alias("kind"), "name", F.lit("").alias("owner"), F.get("sources", F.lit(0))["path"].alias("file"), F.lit("csharp").alias("lang"), F.lit("manifest").alias("source"), F.map_from_arrays(F.array(F.lit("fqn"), F.lit("module")), F.array("fqn", "module")).alias("attributes"))
    m = symbols.select("key", "module", F.explode("members").alias("m"))
    m = m.withColumn("types", signatures.parameter_types(F.col("m.signature")))  # names and defaults of parameters aren't identity
    members = m.select(F.concat(F.lit("member:"), "key", F.lit("."), F.col("m.name"), F.lit("~"), signatures.fingerprint(F.col("m.kind"), F.col("types"))).alias("key"), F.lit("member").alias("kind"), F.col("m.name").alias("name"), F.concat(F.lit("type:"), "key").alias("owner"), F.col("m.path").alias("file"), F.lit("csharp").alias("lang"), F.lit("manifest").alias("source"), F.map_from_arrays(F.array(F.lit("kind"), F.lit("module")), F.array("m.kind", "module")).alias("attributes"))
    bases = resolve_bases(symbols).join(symbols.select(F.col("fqn").alias("resolved"), F.col("key").alias("base_key")), "resolved")
    edges = bases.select(F.lit("inherits").alias("kind"), F.concat(F.lit("type:"), "key").alias("source"), F.concat(F.lit("type:"), "base_key").alias("target"), F.lit("base").alias("via"), F.lit(1.0).alias("confidence"))
    return types.unionByName(members).dropDuplicates(["key"]), edges.distinct()


def dispatch_handlers(symbols: DataFrame, interfaces: Sequence[str]) -> DataFrame:
    """(handler, request): symbols with a base type like Interface<Request, ...> of a configured interface."""
    bases = symbols.select(F.concat(F.lit("type:"), "key").alias("handler"), F.explode("base_types_raw").alias("raw"))
    name = F.element_at(F.split(F.split_part("raw", F.lit("<"), F.lit(1)), r"\."), -1)
    first = F.regexp_extract("raw", r"<\s*((?:[^<>,]|<(?:[^<>]|<[^<>]*>)*>)+)", 1)
    return bases.filter(name.isin(*interfaces) & (first != "")).select("handler", F.trim(first).alias("request")).distinct()


def dispatch_sends(parsed: DataFrame, handlers: DataFrame) -> DataFrame:
    """(path, member, request, line): constructions of types that have a handler."""
    made = parsed.select("path", F.inline("constructions")).withColumn("request", F.element_at(F.split(text.strip_generics(F.col("type_name")), r"\."), -1))
    known = handlers.select(F.element_at(F.split(text.strip_generics(F.col("request")), r"\."), -1).alias("request")).distinct()
    return made.join(known, "request", "left_semi").select("path", "member", "request", "line")


def table_literals(parsed: DataFrame, methods: Sequence[str] = ("ToTable", "ToView")) -> DataFrame:
    """(path, entity, name, line): tables named by configuration calls; a call without a plain name keeps an empty one."""
    calls = parsed.select("path", F.inline("literal_calls")).filter(F.col("method").isin(*methods))
    return calls.select("path", "entity", text.normalize_data_name(F.coalesce(F.get("arguments", F.lit(0)), F.lit(""))).alias("name"), "line")


def sql_usages(parsed: DataFrame, methods: Sequence[str]) -> DataFrame:
    """(path, member, line, reads, writes, calls, dynamic) of SQL texts in the named calls."""
    from ..sources.sqltext import sql_facts

    calls = parsed.select("path", F.inline("literal_calls")).filter(F.col("method").isin(*methods))
    facts = calls.withColumn("f", sql_facts(F.get("arguments", F.lit(0))))
    return facts.select("path", "member", "line", "f.reads", "f.writes", "f.calls", "f.dynamic").filter("dynamic or size(reads) + size(writes) + size(calls) > 0")


def relations(symbols: DataFrame) -> DataFrame:
    """(fqn, target, relation): each symbol with the known interfaces among all its bases. symbols has base_type_closure."""
    interfaces = symbols.filter("type_kind = 'interface'").select(F.col("fqn").alias("target")).distinct()
    pairs = symbols.select("fqn", F.explode("base_type_closure").alias("target")).distinct()
    return pairs.join(interfaces, "target").select("fqn", "target", F.lit("implements").alias("relation"))
