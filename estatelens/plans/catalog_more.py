"""Queries of the operators over names, references, documents, business anchors and services, on the synthetic tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, routes, signatures, text
from ..operators import binding, business, graph, links, plan, questions, recon, rules, search, seams, snapshots, symbols, web
from ..operators.rules import Rule
from ..sources import csharp, documents, registries, workspace
from .catalog import _ORDER_TESTS, _fk_edges, _regions, query
from .catalog_code import _csharp, _file, _fill, _symbols
from .ship import ship
from .tables import table


def _tag(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# --- scalar functions -------------------------------------------------------------------------------------------------


@query("""SELECT s_suppkey, 'App.Repo' AS bare, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS arity FROM supplier""")
def deep_generics(spark, d):
    nested = F.concat(F.repeat(F.lit("Box<"), (F.col("s_suppkey") % 15 + 1).cast("int")), F.lit("int"), F.repeat(F.lit(">"), (F.col("s_suppkey") % 15 + 1).cast("int")))
    raw = F.concat(F.lit("global::App.Repo<"), nested, F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(", (int, string)"), F.lit(">"))
    return table(spark, d, "supplier").select("s_suppkey", text.strip_generics(raw).alias("bare"), text.generic_arity(raw).alias("arity"))


@query(r"""WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS x FROM documents UNION SELECT unnest(['v1.2.3-rc.1', 'logo.PNG', 'application/json', 'GET', 'Localhost', '12345', 'ORDERS', 'a-b', 'x.cs', '.cs', 'averylongidentifier']))
SELECT x, lower(x) IN ('true','false','null','none','utf-8','utf8','application/json','text/plain','text/html','content-type','authorization','accept','get','post','put','delete','patch','http','https','localhost','0.0.0.0','127.0.0.1')
 OR regexp_matches(x, '^[vV]?[0-9]+(\.[0-9]+)*([-+][\w.]+)?$') OR (NOT regexp_matches(x, '[/.\-_:]') AND length(x) < 12 AND NOT (x = upper(x) AND x <> lower(x)))
 OR regexp_extract(lower(x), '[^/]\.([a-z0-9]+)$', 1) IN ('cs','ts','tsx','js','jsx','mjs','vue','py','java','kt','go','rs','rb','php','sql','html','css','scss','xml','json','yaml','yml','sh','ps1','md','sln','csproj','png','jpg','jpeg','gif','ico','svg','webp','bmp','tif','tiff','psd','otf','woff','woff2','ttf','eot','pdf','zip','gz','tar','7z','dll','jar','class','nupkg','xlsx','docx','pptx','exe','so','dylib','pdb','snk','mp4','mp3','wav','bin','dat','db','sqlite') AS noise FROM w""")
def literal_noise(spark, d):
    more = spark.createDataFrame([(x,) for x in ("v1.2.3-rc.1", "logo.PNG", "application/json", "GET", "Localhost", "12345", "ORDERS", "a-b", "x.cs", ".cs", "averylongidentifier")], "x string")
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("x")).union(more).distinct()
    return words.select("x", text.literal_is_noise(F.col("x")).alias("noise"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct([raw, trim(string_split(raw, '<')[1]), string_split(trim(string_split(raw, '<')[1]), '.')[-1]])), ';') AS names FROM (SELECT p_partkey, 'N' || p_size % 4 || '.' || p_brand || CASE WHEN p_size % 2 = 0 THEN '<T>' ELSE '' END AS raw FROM part)""")
def base_names(spark, d):
    raw = F.concat(F.lit("N"), (F.col("p_size") % 4).cast("string"), F.lit("."), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, "<T>").otherwise(""))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(text.base_type_candidates(raw)), ";").alias("names"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN '../' || c_mktsegment || '/c.md' WHEN c_nationkey % 3 = 1 THEN 'c.md' ELSE '../../top.md' END AS link, replace(c_name, '#', ' \\| ') AS cell FROM customer""")
def document_links(spark, d):
    target = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("docs/"), "c_mktsegment", F.lit("/c.md"))).when(F.col("c_nationkey") % 3 == 1, F.lit("docs/own/c.md")).otherwise(F.lit("top.md"))
    cell = text.markdown_cell(F.regexp_replace("c_name", "#", " \n|\n "))
    return table(spark, d, "customer").select("c_custkey", text.relative_path(F.lit("docs/own/x.md"), target).alias("link"), F.regexp_replace(cell, r"\s*\\\|\s*", r" \\| ").alias("cell"))


@query("""SELECT o_orderkey, 'sha256:' || sha256('{"a":"' || o_orderstatus || '","m":{"p":"' || o_orderpriority || '","x":"1"},"z":' || o_custkey || '}') AS hash FROM orders""")
def stable_hashes(spark, d):
    entries = text.sorted_map(F.create_map(F.lit("x"), F.lit("1"), F.lit("p"), F.col("o_orderpriority")))
    return table(spark, d, "orders").select("o_orderkey", text.stable_hash(z=F.col("o_custkey"), m=entries, a=F.col("o_orderstatus")).alias("hash"))


@query("""SELECT s_suppkey, sha256('method|Dictionary<string, int>|' || CASE WHEN s_suppkey % 2 = 0 THEN 'int' ELSE 'long' END)[1:8] AS fingerprint FROM supplier""")
def member_identity(spark, d):
    ship(spark)
    kind = F.when(F.col("s_suppkey") % 2 == 0, "int").otherwise("long")
    signature = F.concat(F.lit("(int, int) Go(ref Dictionary<string, int> "), _tag("m", "s_suppkey"), F.lit(", "), kind, F.lit(" "), _tag("x", "s_suppkey"), F.lit(" = "), F.col("s_suppkey").cast("string"), F.lit(")"))
    return table(spark, d, "supplier").select("s_suppkey", signatures.fingerprint(F.lit("method"), signatures.parameter_types(signature)).alias("fingerprint"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'a/x.md' WHEN 1 THEN '../x.md' WHEN 2 THEN 'b/c' ELSE 'x' END AS path FROM nation""")
def clean_paths(spark, d):
    k = F.col("n_nationkey")
    deep = F.concat(F.repeat(F.lit("d/"), k), F.repeat(F.lit("../"), k), F.lit("a/./x.md"))
    raw = F.when(k % 4 == 0, deep).when(k % 4 == 1, "a/../../x.md").when(k % 4 == 2, "./b//q/../c").otherwise("x/")
    return table(spark, d, "nation").select("n_nationkey", paths.clean(raw).alias("path"))


@query("""SELECT page_id, contains(p, '/about') AS below, starts_with(p, 'm.example') OR false AS kept FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages) WHERE NOT list_contains(string_split(p, '/'), 'docs')""")
def scoped_paths(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("p")).filter(~paths.has_segment(F.col("p"), ["docs"]))
    return p.select("page_id", F.col("p").contains("/about").alias("below"), (F.startswith(F.col("p"), F.lit("m.example")) | ~paths.in_scope(F.col("p"), [])).alias("kept"))


# --- resolving joins --------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT 'src/r' || n_regionkey || '/n' || n_nationkey || '/f' || s_suppkey || '.cs' AS path, n_regionkey AS r, n_nationkey AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT path, CASE WHEN n % 2 = 0 THEN 'nation' || n ELSE 'region' || r END AS owner FROM f WHERE n % 2 = 0 OR r < 3""")
def nearest_owner(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    region, nation = F.concat(F.lit("src/"), _tag("r", "n_regionkey")), F.concat(F.lit("src/"), _tag("r", "n_regionkey"), F.lit("/"), _tag("n", "n_nationkey"))
    files = s.join(n, s.s_nationkey == n.n_nationkey).select(F.concat(nation, F.lit("/"), _tag("f", "s_suppkey"), F.lit(".cs")).alias("path"))
    owners = n.filter("n_nationkey % 2 = 0").select(nation.alias("dir"), _tag("nation", "n_nationkey").alias("owner")).union(n.filter("n_regionkey < 3").select(region, _tag("region", "n_regionkey")).distinct())
    return links.nearest_ancestor(files, "path", owners, "dir", "owner")


@query("""SELECT lang, prefix, count(*) AS n FROM (SELECT lang, CASE WHEN n_chars % 3 = 0 THEN 'a/b' WHEN n_chars % 3 = 1 THEN 'a' END AS prefix FROM documents) GROUP BY 1, 2""")
def repeated_prefixes(spark, d):
    docs = table(spark, d, "documents").select("lang", F.create_map(F.lit("k"), F.lit("v")).alias("extra"), F.when(F.col("n_chars") % 3 == 0, "a/b/c").when(F.col("n_chars") % 3 == 1, "a/bc").alias("text"))
    known = spark.createDataFrame([("a",), ("a/b",), ("x",)], "prefix string")
    return links.longest_prefix(docs, "text", known, "prefix").groupBy("lang", "prefix").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE e AS (SELECT 'f' || s_suppkey AS file, 'f' || (s_suppkey + 1) AS target FROM supplier WHERE s_suppkey % 40 <> 0), n AS (SELECT 'f' || s_suppkey AS file, 'N' || s_suppkey AS name FROM supplier WHERE s_suppkey % 40 = 0 OR s_suppkey % 7 = 0),
p AS (SELECT file, name, file AS declared_in FROM n UNION SELECT e.file, p.name, p.declared_in FROM p JOIN e ON p.file = e.target) SELECT file, name, declared_in FROM p""")
def exported_names(spark, d):
    s = table(spark, d, "supplier")
    passed = s.filter("s_suppkey % 40 <> 0").select(_tag("f", "s_suppkey").alias("file"), F.concat(F.lit("f"), (F.col("s_suppkey") + 1).cast("string")).alias("target"))
    return web.exported_names(s.filter("s_suppkey % 40 = 0 or s_suppkey % 7 = 0").select(_tag("f", "s_suppkey").alias("file"), _tag("N", "s_suppkey").alias("name")), passed)


@query("""SELECT 'app/p' || n_nationkey || '.ts' AS path, CASE n_nationkey % 3 WHEN 0 THEN '../lib/r' || n_regionkey WHEN 1 THEN '@lib/r' || n_regionkey ELSE 'rxjs' END AS source, CASE WHEN n_nationkey % 3 = 2 THEN NULL WHEN n_regionkey < 2 THEN 'lib/r' || n_regionkey || '/index.ts' ELSE 'lib/r' || n_regionkey || '.ts' END AS file FROM nation""")
def resolved_imports(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    source = F.when(F.col("n_nationkey") % 3 == 0, _tag("../lib/r", "n_regionkey")).when(F.col("n_nationkey") % 3 == 1, _tag("@lib/r", "n_regionkey")).otherwise("rxjs")
    imports = n.select(F.concat(_tag("app/p", "n_nationkey"), F.lit(".ts")).alias("path"), source.alias("source"))
    files = r.select(F.concat(_tag("lib/r", "r_regionkey"), F.when(F.col("r_regionkey") < 2, "/index.ts").otherwise(".ts")).alias("path"))
    return web.resolve_imports(imports, files, spark.createDataFrame([("@lib/", "lib")], "prefix string, target string"))


@query("""SELECT DISTINCT 'T' || o_custkey % 50 AS type, 'm' || o_orderstatus AS member, CASE WHEN o_custkey % 50 < 30 THEN 'own' || o_custkey % 50 ELSE 'base' END AS target, 'go' || o_orderpriority[1] AS method FROM orders WHERE o_custkey % 50 < 40""")
def receiver_usages(spark, d):
    o = table(spark, d, "orders").withColumn("t", (F.col("o_custkey") % 50).cast("int"))
    uses = o.select(_tag("T", "t").alias("type"), F.lit("svc").alias("receiver"), F.concat(F.lit("go"), F.substring("o_orderpriority", 1, 1)).alias("method"), F.concat(F.lit("m"), "o_orderstatus").alias("member"))
    own = o.filter("t < 30").select(_tag("T", "t").alias("type"), F.lit("svc").alias("name"), _tag("own", "t").alias("target")).distinct()
    base = spark.createDataFrame([("B", "svc", "base")], "type string, name string, target string")
    return web.usage_edges(uses, own.union(base), o.filter("t < 40").select(_tag("T", "t").alias("type"), F.lit("B").alias("base")).distinct())


@query("""WITH c AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'pm/x' || page_id % 5 WHEN 1 THEN 'api/items' ELSE NULL END AS r FROM pages)
SELECT 'GET' AS http_method, CASE page_id % 3 WHEN 0 THEN CASE WHEN page_id % 2 = 0 THEN 'api/x' || page_id % 5 ELSE 'pm/x' || page_id % 5 END ELSE 'api/items' END AS route, CASE WHEN page_id % 3 = 1 THEN 'U' || page_id % 4 ELSE '' END AS discriminator, count(*) AS n FROM c WHERE r IS NOT NULL GROUP BY 1, 2, 3
UNION ALL SELECT 'none', 'parameter', '', count(*) FROM c WHERE r IS NULL""")
def built_calls(spark, d):
    k = F.col("page_id")
    url = F.when(k % 3 == 0, F.concat(F.lit("/pm//X"), (k % 5).cast("string"), F.lit("?a=1"))).when(k % 3 == 1, F.concat(F.lit("/api/items?z=1&listInnerName=U"), (k % 4).cast("string")))
    calls = table(spark, d, "pages").select(_tag("f", "page_id").alias("file"), F.when(k % 2 == 0, "even").otherwise("odd").alias("module"), F.lit("get").alias("http_method"), url.alias("url"), F.when(k % 3 == 2, "parameter").alias("reason"), F.lit("go").alias("member"), F.lit(1).alias("line"))
    keys, lost = web.build_calls(calls, spark.createDataFrame([("even", "/PM", "api")], "module string, strip_prefix string, add_prefix string"), ["api/items"])
    found = keys.groupBy("http_method", "route", "discriminator").agg(F.count(F.lit(1)).alias("n"))
    return found.union(lost.groupBy(F.lit("none"), "reason", F.lit("")).agg(F.count(F.lit(1))))


@query("""WITH f AS (SELECT 'p' || n_nationkey AS path, 'C' || n_nationkey % 10 AS component FROM nation), a AS (SELECT 'p' || n_nationkey AS path, 'C' || n_nationkey % 10 AS component FROM nation WHERE n_nationkey < 3 UNION SELECT 'new', 'N'), b AS (SELECT * FROM f UNION SELECT * FROM a),
r AS (SELECT 'p24' AS path, 'C4' AS component UNION SELECT 'new', 'N')
SELECT 'route' AS finding, path, component FROM b WHERE (path, component) NOT IN (SELECT (path, component) FROM r) AND component <> 'C99' UNION ALL SELECT 'redundant', path, component FROM f WHERE path IN ('p0', 'p1', 'p2') UNION ALL SELECT 'missing', 'zz', 'Z' UNION ALL SELECT 'ambiguous', NULL, 'C1' UNION ALL SELECT 'missing', NULL, 'gone'""")
def route_overrides(spark, d):
    n = table(spark, d, "nation").select(_tag("p", "n_nationkey").alias("path"), F.concat(F.lit("C"), (F.col("n_nationkey") % 10).cast("string")).alias("component"), "n_nationkey")
    added = n.filter("n_nationkey < 3").select("path", "component").union(spark.createDataFrame([("new", "N")], "path string, component string"))
    removed = spark.createDataFrame([("p24", "C4"), ("new", "N"), ("zz", "Z"), (None, "C1"), (None, "gone")], "path string, component string")
    kept, findings = web.apply_overrides(n.select("path", "component"), added, removed)
    return kept.select(F.lit("route").alias("finding"), "path", "component").union(findings)


@query("""WITH n AS (SELECT 's' || s_suppkey AS id, s_suppkey % 5 AS k, s_nationkey AS p FROM supplier) SELECT id, CASE WHEN k = 0 THEN 'F' WHEN k IN (1, 2) THEN 'page' || p END AS absorbed_by FROM n UNION ALL SELECT DISTINCT 'page' || p, NULL FROM n UNION ALL SELECT 'F', NULL""")
def absorbed_nodes(spark, d):
    s = table(spark, d, "supplier").withColumn("k", F.col("s_suppkey") % 5)
    path = F.when(F.col("k") == 0, F.concat(F.lit("feat/"), _tag("s", "s_suppkey"))).otherwise(_tag("s", "s_suppkey"))
    own = s.select(_tag("s", "s_suppkey").alias("id"), F.lit("service").alias("kind"), path.alias("path"), F.lit("h").alias("impl_hash"))
    pages = s.select(_tag("page", "s_nationkey").alias("id"), F.lit("page").alias("kind"), F.lit("p.ts").alias("path"), F.lit("h").alias("impl_hash")).distinct()
    nodes = own.union(pages).union(spark.createDataFrame([("F", "feature", "", "h")], "id string, kind string, path string, impl_hash string"))
    near = lambda p: s.filter(p).select(_tag("page", "s_nationkey").alias("src"), _tag("s", "s_suppkey").alias("dst"))
    other = s.filter("k = 3").select(F.concat(F.lit("page"), ((F.col("s_nationkey") + 1) % 25).cast("string")).alias("src"), _tag("s", "s_suppkey").alias("dst"))
    pages_known = pages.select(F.col("id").alias("src"))
    uses = near("k <> 4").union(other.join(pages_known, "src", "left_semi")).union(near("k = 3"))
    both = other.join(pages_known, "src", "left_semi").select("dst").distinct()
    kept = web.absorb(nodes, uses, spark.createDataFrame([("F", "feat")], "id string, folder string")).select("id", "absorbed_by")
    # those of k = 3 belong to no one where two pages reach them; where the other page isn't there, they are left out of the comparison
    single = s.filter("k = 3").select(_tag("s", "s_suppkey").alias("dst")).join(both, "dst", "left_anti")
    return kept.join(single, kept["id"] == single["dst"], "left").select("id", F.when(F.col("dst").isNull(), F.col("absorbed_by")).alias("absorbed_by"))


@query("""SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN 'page' ELSE 'component' END AS kind FROM customer UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_acctbal > 0 THEN 'api_service' ELSE 'service' END FROM supplier""")
def promoted_kinds(spark, d):
    c = table(spark, d, "customer").select(_tag("c", "c_custkey").alias("id"), F.lit("component").alias("kind"), (F.col("c_acctbal") > 5000).cast("int").alias("n_routes"), F.lit(1).alias("n_calls"))
    s = table(spark, d, "supplier").select(_tag("s", "s_suppkey").alias("id"), F.lit("service").alias("kind"), F.lit(1).alias("n_routes"), (F.col("s_acctbal") > 0).cast("int").alias("n_calls"))
    return web.promote(c.union(s)).select("id", "kind")


@query("""SELECT r_name AS page, 1 + (r_regionkey = 0)::BIGINT AS n_routes, count(n_nationkey) AS n_descendants, count(DISTINCT n_nationkey % 3) AS n_endpoints, false AS unreached FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1, 2 UNION ALL SELECT 'alone', 0, 0, 0, true""")
def page_report(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    both = n.join(r, n.n_regionkey == r.r_regionkey)
    routes_ = r.select(_tag("r", "r_regionkey").alias("path"), F.col("r_name").alias("component")).union(r.filter("r_regionkey = 0").select(F.lit("second"), "r_name")).union(both.select(F.concat(_tag("r", "r_regionkey"), _tag("/n", "n_nationkey")), F.lit("inner")))
    ends = both.select(F.col("r_name").alias("page"), (F.col("n_nationkey") % 3).cast("string").alias("endpoint"))
    pages = r.select(F.col("r_name").alias("page")).union(spark.createDataFrame([("alone",)], "page string"))
    return web.page_report(pages, routes_, ends)


# --- services ---------------------------------------------------------------------------------------------------------


def _service_nodes(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Interfaces I<n> of nations, implemented by suppliers S<k>, each with a member Run; callers are customers."""
    n, s, c = table(spark, d, "nation"), table(spark, d, "supplier"), table(spark, d, "customer")
    none = F.create_map().cast("map<string,string>")
    node = lambda df, key, kind, name, owner, attributes=none: df.select(key.alias("key"), F.lit(kind).alias("kind"), name.alias("name"), owner.alias("owner"), F.lit("").alias("file"), attributes.alias("attributes"))
    fqn = lambda p, k: F.create_map(F.lit("fqn"), F.concat(F.lit("N."), _tag(p, k)))
    nodes = node(n, _tag("I", "n_nationkey"), "type", _tag("I", "n_nationkey"), F.lit(""), fqn("I", "n_nationkey"))
    nodes = nodes.union(node(s, _tag("S", "s_suppkey"), "type", _tag("S", "s_suppkey"), F.lit(""), fqn("S", "s_suppkey")))
    nodes = nodes.union(node(n, F.concat(_tag("I", "n_nationkey"), F.lit(".Run")), "member", F.lit("Run"), _tag("I", "n_nationkey"))).union(node(s, F.concat(_tag("S", "s_suppkey"), F.lit(".Run")), "member", F.lit("Run"), _tag("S", "s_suppkey")))
    nodes = nodes.union(node(c, F.concat(_tag("C", "c_custkey"), F.lit(".Do")), "member", F.lit("Do"), _tag("C", "c_custkey")))
    calls = c.select(F.lit("calls").alias("kind"), F.concat(_tag("C", "c_custkey"), F.lit(".Do")).alias("source"), F.concat(_tag("I", "c_nationkey"), F.lit(".Run")).alias("target"), F.lit("").alias("via"), F.lit(1.0).alias("confidence"))
    bound = s.select(F.lit("binds").alias("kind"), _tag("I", "s_nationkey").alias("source"), _tag("S", "s_suppkey").alias("target"), F.lit("").alias("via"), F.lit(1.0).alias("confidence"))
    return nodes, calls, bound


_BY_NATION = "SELECT 'C' || c_custkey || '.Do' AS source, 'S' || s_suppkey || '.Run' AS target, round_even(1.0 / count(*) OVER (PARTITION BY c_custkey), 3)::DOUBLE AS confidence"


@query(f"{_BY_NATION} FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def completed_calls(spark, d):
    nodes, calls, bound = _service_nodes(spark, d)
    return binding.complete(nodes, calls, bound).select("source", "target", "confidence")


@query("""WITH s AS (SELECT c_custkey, s_suppkey, round_even(1.0 / n, 3)::DOUBLE AS confidence, c_nationkey FROM customer JOIN (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) ON c_nationkey = s_nationkey)
SELECT 'C' || c_custkey || '.Do' AS source, 'S' || s_suppkey || '.Run' AS target, 'I' || c_nationkey AS via, confidence FROM s""")
def service_seams(spark, d):
    nodes, calls, bound = _service_nodes(spark, d)
    services = table(spark, d, "nation").select(_tag("e", "n_nationkey").alias("key"), F.lit("entry_point").alias("kind"), _tag("I", "n_nationkey").alias("name"), F.lit("").alias("owner"), F.lit("").alias("file"), F.create_map(F.lit("entry_kind"), F.lit("grid_service")).alias("attributes"))
    sent = bound.select(F.lit("dispatches").alias("kind"), F.regexp_replace("source", "^I", "e").alias("source"), "target", "via", "confidence")
    return seams.service_seams(nodes.union(services), calls.union(sent)).select("source", "target", "via", "confidence")


@query("""SELECT 'e' || p_partkey AS entry, CASE p_partkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'simple' ELSE 'unlinked' END AS how, CASE WHEN p_partkey % 3 < 2 THEN 'I' || p_size % 25 END AS target, CASE WHEN p_partkey % 3 < 2 THEN 1.0 END::DOUBLE AS confidence FROM part""")
def linked_entries(spark, d):
    nodes, _, _ = _service_nodes(spark, d)
    k, name = F.col("p_partkey"), F.concat(F.lit("I"), (F.col("p_size") % 25).cast("string"))
    entries = table(spark, d, "part").select(_tag("e", "p_partkey").alias("entry"), F.when(k % 3 == 0, F.concat(F.lit("N."), name)).when(k % 3 == 1, F.concat(F.lit("Else."), name)).otherwise("Nobody").alias("impl"))
    return binding.link_entries(entries, nodes).select("entry", "how", "target", "confidence")


@query("""WITH r AS (SELECT 'r' || r_regionkey AS key, r_regionkey AS k FROM region), a AS (SELECT DISTINCT 'r' || n_regionkey AS key, 'n' || n_nationkey AS node FROM nation WHERE n_regionkey IN (0, 1)), c AS (SELECT DISTINCT 'r' || n_regionkey AS key, 'c' || n_nationkey % 4 AS node FROM nation WHERE n_regionkey IN (0, 2))
SELECT node AS source, key AS target, 0.9::DOUBLE AS confidence FROM c WHERE node <> 'c3' UNION ALL SELECT key, node, 0.9 FROM a UNION ALL SELECT key, CASE k WHEN 0 THEN 'both' WHEN 1 THEN 'answering_only' WHEN 2 THEN 'calling_only' ELSE 'dangling' END, NULL FROM r""")
def declared_seams(spark, d):
    n = table(spark, d, "nation")
    key = _tag("r", "n_regionkey").alias("key")
    answering = n.filter("n_regionkey in (0, 1)").select(key, _tag("n", "n_nationkey").alias("node"))
    calling = n.filter("n_regionkey in (0, 2)").select(key, F.concat(F.lit("c"), (F.col("n_nationkey") % 4).cast("string")).alias("node"))
    edges, sides = seams.declared_seams(table(spark, d, "region").select(_tag("r", "r_regionkey").alias("key")), answering, calling, n.select(key, F.lit("c3").alias("node")).distinct())
    return edges.select("source", "target", "confidence").union(sides.select("key", "status", F.lit(None).cast("double")))


@query("""SELECT 'o' || o_orderkey AS carrier, CASE WHEN o_orderkey % 3 = 0 THEN 'lit' WHEN o_orderkey % 3 = 1 THEN 'attr' ELSE 'conv' || o_custkey % 7 END AS "table", CASE o_orderkey % 3 WHEN 0 THEN 'literal' WHEN 1 THEN 'attribute' ELSE 'convention' END AS via, CASE WHEN o_orderkey % 3 = 2 THEN 0.6 ELSE 1.0 END::DOUBLE AS confidence FROM orders""")
def table_carriers(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    part = lambda p, name: o.filter(p).select(_tag("o", "o_orderkey").alias("carrier"), name.alias("table"))
    return seams.data_edges(part(k % 3 == 0, F.lit("lit")), part(k % 3 != 2, F.lit("attr")), part(F.lit(True), F.concat(F.lit("conv"), (F.col("o_custkey") % 7).cast("string"))))


@query("""SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'graph_only' WHEN s_suppkey % 5 = 1 THEN 'ambiguous' ELSE 'matched' END AS side, count(*) AS n FROM supplier GROUP BY 1 UNION ALL SELECT 'manifest_only', count(*) FROM nation""")
def manifest_match(spark, d):
    s = table(spark, d, "supplier")
    g = s.select(_tag("g", "s_suppkey").alias("key"), _tag("f", "s_nationkey").alias("file"), F.col("s_name").alias("name"))
    m = s.filter("s_suppkey % 5 <> 0").select(_tag("m", "s_suppkey").alias("member_key"), _tag("f", "s_nationkey").alias("file"), F.col("s_name").alias("name"))
    m = m.union(s.filter("s_suppkey % 5 = 1").select(_tag("x", "s_suppkey"), _tag("f", "s_nationkey"), "s_name")).union(table(spark, d, "nation").select(_tag("n", "n_nationkey"), F.lit("none"), "n_name"))
    return binding.match_manifest(g, m).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


# --- code -------------------------------------------------------------------------------------------------------------

_HANDLER = """namespace App; public class H§k§ : IRequestHandler<Q§k§<int>, bool> {
  public bool Handle(Q§k§<int> q) { db.Query("SELECT * FROM [dbo].[T§n§] JOIN #tmp t ON 1 = 1"); return true; } }
public class Q§k§<T> { }
public class Caller§k§ { void Go() { bus.Send(new Q§k§<int>(1)); new Other§k§(); } void Map(B b) { b.ToTable("Orders§n§", "dbo"); } }
"""


def _handlers(spark, d) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "supplier")
    files = s.select(*_file(F.concat(_tag("src/H", "s_suppkey"), F.lit(".cs")), _fill(_HANDLER, k=F.col("s_suppkey").cast("string"), n=F.col("s_nationkey").cast("string"))))
    parsed = csharp.parse_files(files)
    return parsed, symbols.build_symbols(parsed, files.select("path", F.lit("M").alias("module")))


@query("""SELECT 'type:M#App.H' || s_suppkey AS handler, 'Q' || s_suppkey || '<int>' AS request, 'src/H' || s_suppkey || '.cs' AS path, 'Go' AS member FROM supplier""")
def request_handlers(spark, d):
    parsed, s = _handlers(spark, d)
    handlers = symbols.dispatch_handlers(s, ["IRequestHandler"])
    sends = symbols.dispatch_sends(parsed, handlers).withColumn("bare", F.col("request")).select("bare", "path", "member")
    return handlers.withColumn("bare", text.strip_generics(F.col("request"))).join(sends, "bare").select("handler", "request", "path", "member")


@query("""SELECT 'Caller' || s_suppkey AS source, CASE WHEN s_suppkey % 2 = 0 THEN 'member:H' || s_suppkey || '.Handle' ELSE 'type:H' || s_suppkey END AS target, 'Q' || s_suppkey AS via FROM supplier""")
def dispatched_requests(spark, d):
    s = table(spark, d, "supplier")
    sends = s.select(_tag("Caller", "s_suppkey").alias("member"), F.concat(_tag("Q", "s_suppkey"), F.lit("<int>")).alias("request"))
    handlers = s.select(_tag("type:H", "s_suppkey").alias("handler"), _tag("Q", "s_suppkey").alias("request"))
    nodes = s.filter("s_suppkey % 2 = 0").select(F.concat(_tag("member:H", "s_suppkey"), F.lit(".Handle")).alias("key"), F.lit("member").alias("kind"), F.lit("Handle").alias("name"), _tag("type:H", "s_suppkey").alias("owner"))
    return binding.dispatch(sends, handlers, nodes).select("source", "target", "via")


@query("""SELECT 'src/H' || s_suppkey || '.cs' AS path, 'dbo.t' || s_nationkey AS reads, 'orders' || s_nationkey AS mapped FROM supplier""")
def sql_and_tables(spark, d):
    parsed, _ = _handlers(spark, d)
    used = symbols.sql_usages(parsed, ["Query"]).select("path", F.array_join("reads", ",").alias("reads"))
    return used.join(symbols.table_literals(parsed).select("path", F.col("name").alias("mapped")), "path")


@query("""SELECT 'src/H' || s_suppkey || '.cs' AS path, unnest(['Q' || s_suppkey || '<int>', 'Other' || s_suppkey]) AS type_name, 'Go' AS member FROM supplier""")
def constructions(spark, d):
    return _handlers(spark, d)[0].select("path", F.inline("constructions")).select("path", "type_name", "member")


@query("""SELECT 'src/Startup/R' || s_suppkey || '.cs' AS file, CASE i WHEN 0 THEN 'IS' || s_suppkey % 10 || '<string>' ELSE 'S' || s_suppkey END AS service, 'S' || s_suppkey AS impl, ['scoped', 'singleton'][i + 1] AS lifetime FROM supplier, (SELECT unnest(range(2)) AS i)""")
def registrations(spark, d):
    r = _csharp(spark, d)[0].select(F.col("path").alias("file"), F.inline("registrations"))
    return r.select("file", F.col("service_type").alias("service"), F.col("impl_type").alias("impl"), "lifetime")


@query("""SELECT 'P' || s_suppkey || '/P' || s_suppkey || '.csproj' AS path, 'net8.0;net9.0' AS frameworks, CASE WHEN s_suppkey % 2 = 0 THEN 'P1/P1.csproj' ELSE 'gone/X' || s_suppkey || '.csproj' END AS reference, CASE WHEN s_suppkey % 2 = 0 THEN 'P1/P1.csproj' END AS project, 'A,Z' AS packages FROM supplier""")
def project_files(spark, d):
    k = F.col("s_suppkey")
    target = F.when(k % 2 == 0, F.lit("..\\P1\\P1.csproj")).otherwise(F.concat(_tag("..\\gone\\sub\\..\\X", "s_suppkey"), F.lit(".csproj")))
    body = F.concat(F.lit("<Project><PropertyGroup><TargetFrameworks>net8.0;net9.0</TargetFrameworks></PropertyGroup><ItemGroup><PackageReference Include='Z'/><PackageReference Include='A'/><ProjectReference Include='"), target, F.lit("'/></ItemGroup></Project>"))
    found = registries.projects(table(spark, d, "supplier").select(*_file(F.concat(_tag("P", "s_suppkey"), _tag("/P", "s_suppkey"), F.lit(".csproj")), body)))
    refs = registries.resolve_references(found)
    return found.join(refs, "path").select("path", F.array_join("target_frameworks", ";").alias("frameworks"), "reference", "project", F.array_join("package_references", ",").alias("packages"))


@query("""SELECT 's' || n_regionkey || '.sln' AS path, 'src/N' || n_nationkey || '/N' || n_nationkey || '.csproj' AS project FROM nation UNION ALL SELECT 'x' || n_nationkey || '.slnx', 'lib/L' || n_nationkey || '.csproj' FROM nation""")
def solution_projects(spark, d):
    n = table(spark, d, "nation")
    line = F.concat(F.lit('Project("{9A}") = "N'), "n_name", F.lit('", "src\\N'), F.col("n_nationkey").cast("string"), F.lit("\\N"), F.col("n_nationkey").cast("string"), F.lit('.csproj", "{1}"\nEndProject\n'))
    classic = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("body")).select(*_file(F.concat(_tag("s", "n_regionkey"), F.lit(".sln")), F.col("body")))
    modern = n.select(*_file(F.concat(_tag("x", "n_nationkey"), F.lit(".slnx")), F.concat(F.lit('<Solution><Project Path="lib/L'), F.col("n_nationkey").cast("string"), F.lit('.csproj" /></Solution>'))))
    return registries.solution_projects(classic.union(modern))


@query("""SELECT 's' || s_suppkey || '.py' AS path, 'job' || s_suppkey AS key, 'mod.run' || s_suppkey % 3 AS impl, false AS failed FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT 's' || s_suppkey || '.py', 'call', 'g.h', false FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT 's' || s_suppkey || '.py', NULL, NULL, true FROM supplier WHERE s_suppkey % 4 = 0""")
def python_tables(spark, d):
    k = F.col("s_suppkey")
    body = F.when(k % 4 == 0, F.lit("def broken(:")).otherwise(F.concat(F.lit("T = {'"), _tag("job", "s_suppkey"), F.lit("': mod.run"), (k % 3).cast("string"), F.lit(", 'n': 1, 'q': x}\nreg('call', g.h)")))
    found = workspace.python_registrations(table(spark, d, "supplier").select(*_file(F.concat(_tag("s", "s_suppkey"), F.lit(".py")), body)), call="reg")
    return found.select("path", "key", "impl", F.col("scan_error").isNotNull().alias("failed"))


@query("""SELECT 'p' || page_id || '.ts' AS path, unnest(['one/' || page_id, 't-' || page_id % 5, 'xyz' || page_id]) AS literal FROM pages""")
def quoted_literals(spark, d):
    k = F.col("page_id").cast("string")
    body = F.concat(F.lit("a('one/"), k, F.lit("'); b(\"xyz"), k, F.lit('"); c(`t-'), (F.col("page_id") % 5).cast("string"), F.lit("`); d('no no'); e('ab'); f('...')"))
    return workspace.literals(table(spark, d, "pages").select(*_file(F.concat(_tag("p", "page_id"), F.lit(".ts")), body))).select("path", "literal")


@query("""SELECT 'i' || s_nationkey || '.xml' AS path, 'Item/@name' AS "group", s_name AS id FROM supplier WHERE NOT contains(s_name, ' ') UNION ALL SELECT 'j' || n_nationkey || '.json', 'rows[].code', n_name FROM nation WHERE NOT contains(n_name, ' ') AND length(n_name) >= 3""")
def identifier_values(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    items = s.groupBy("s_nationkey").agg(F.array_join(F.collect_list(F.concat(F.lit("<Item Name='"), "s_name", F.lit("' x='1'/>"))), "").alias("b"))
    xml = items.select(*_file(F.concat(_tag("i", "s_nationkey"), F.lit(".xml")), F.concat(F.lit("<R>"), "b", F.lit("</R>"))))
    json = n.select(*_file(F.concat(_tag("j", "n_nationkey"), F.lit(".json")), F.concat(F.lit('{"rows": [{"code": "'), "n_name", F.lit('"}]}'))))
    return workspace.identifiers(xml.union(json)).select("path", "group", "id")


@query("""SELECT 'job' || o_orderkey AS ref, o_custkey AS seconds, 'a' || CASE WHEN o_custkey % 2 = 0 THEN '@v' || o_custkey % 5 ELSE '' END AS key FROM orders WHERE o_orderstatus = 'P'""")
def schedules_and_keys(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    raw = F.concat(F.lit('<JobSchedule Kind="x" Interval="'), F.col("o_custkey").cast("string"), F.lit('" />'))
    version = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("v"), (F.col("o_custkey") % 5).cast("string")))
    return o.select(_tag("job", "o_orderkey").alias("ref"), workspace.schedule_seconds(raw).cast("long").alias("seconds"), registries.record_key(F.lit("a"), F.lit(None).cast("string"), version).alias("key"))


@query("""SELECT 'docs/modules/k/M' || s_nationkey % 3 || '/' || CASE WHEN n > 1 THEN 'n' || s_nationkey || '-' || sha256('id' || s_suppkey)[1:8] ELSE 'n' || s_nationkey END || '.md' AS doc_path FROM (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)""")
def crowded_doc_paths(spark, d):
    nodes = table(spark, d, "supplier").select(_tag("id", "s_suppkey").alias("id"), F.concat(F.lit("M"), (F.col("s_nationkey") % 3).cast("string")).alias("module"), F.lit("k").alias("kind"), _tag("n", "s_nationkey").alias("name"))
    return symbols.doc_paths(nodes).select("doc_path")


@query("""SELECT n_name AS module, CASE WHEN contains(n_name, 'A') THEN 'with_a' WHEN starts_with(n_name, 'N') THEN 'zone' ELSE n_name END AS domain FROM nation""")
def module_domains(spark, d):
    return symbols.domains(table(spark, d, "nation").select(F.col("n_name").alias("module")), [("zone", "N*"), ("with_a", "*A*")])


# --- snapshots, plans and documents -----------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 THEN 'missing' WHEN o_orderkey % 5 = 1 THEN 'undeclared' WHEN o_orderkey % 5 = 2 THEN 'relocated' ELSE 'current' END AS status FROM orders""")
def freshness_of_nulls(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    nodes = o.select(k.alias("id"), F.lit("k").alias("kind"), F.lit("s").alias("signature_hash"), F.lit("i").alias("impl_hash"))
    no, yes = F.lit(None).cast("boolean"), F.lit(True)
    docs = o.filter(k % 5 != 4).select(k.alias("id"), F.lit(None).cast("int").alias("empty_sections"), F.when(k % 5 == 1, no).otherwise(yes).alias("accepted"), F.lit("k").alias("accepted_kind"), F.lit("s").alias("accepted_signature"), F.lit("i").alias("accepted_impl"), no.alias("relocated"), F.when(k % 5 == 2, "moved").alias("review_reason"))
    return snapshots.freshness(nodes, docs).select("id", "status")


@query("""SELECT 'p' || p_partkey AS path, CASE p_partkey % 4 WHEN 0 THEN 'source_missing' WHEN 1 THEN 'no_hash' WHEN 2 THEN 'stale' ELSE 'current' END AS status FROM part""")
def source_states(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    was = p.select(_tag("p", "p_partkey").alias("path"), F.when(k % 4 == 1, "").when(k % 4 == 2, "old").otherwise(F.col("p_name")).alias("content_hash"))
    return snapshots.source_status(was, p.filter(k % 4 != 0).select(_tag("p", "p_partkey").alias("path"), F.col("p_name").alias("content_hash")))


@query("""SELECT 'hit' AS what, count(*) AS n FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'pending', count(*) FROM part WHERE p_partkey % 3 <> 0""")
def parse_cache(spark, d):
    p = table(spark, d, "part").select(_tag("p", "p_partkey").alias("path"), F.col("p_name").alias("content_hash"), (F.col("p_partkey") % 3).alias("k"))
    cache = p.select("path", F.when(F.col("k") == 1, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("k") == 2, "v0").otherwise("v1").alias("parser_version"))
    hits, pending = snapshots.cached_or_pending(p.select("path", "content_hash"), cache, "v1")
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return count(hits, "hit").union(count(pending, "pending"))


@query("""SELECT coalesce(a.k, b.k) AS key, coalesce(b.n, a.n) AS name, concat_ws('+', a.s, b.s) AS source, CASE WHEN b.k IS NULL THEN 'x=1' WHEN a.k IS NULL THEN 'y=3' ELSE 'x=2,y=3' END AS attributes
FROM (SELECT s_suppkey AS k, s_name AS n, 'code' AS s FROM supplier WHERE s_suppkey % 3 <> 0) a FULL JOIN (SELECT s_suppkey AS k, 'new' AS n, 'reg' AS s FROM supplier WHERE s_suppkey % 3 <> 1) b ON a.k = b.k""")
def overlaid_nodes(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    a = s.filter(k % 3 != 0).select(k.alias("key"), F.col("s_name").alias("name"), F.lit("code").alias("source"), F.create_map(F.lit("x"), F.lit("1")).alias("attributes"))
    more = F.when(k % 3 == 0, F.create_map(F.lit("y"), F.lit("3"))).otherwise(F.create_map(F.lit("x"), F.lit("2"), F.lit("y"), F.lit("3")))
    out = snapshots.overlay(a, s.filter(k % 3 != 1).select(k.alias("key"), F.lit("new").alias("name"), F.lit("reg").alias("source"), more.alias("attributes")))
    return out.select("key", "name", "source", F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("attributes"))


def _plan(spark, d) -> DataFrame:
    """Nodes of orders against documents: in place, moved by id, moved by equal hashes, damaged, missing, absorbed, and orphans."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    own = lambda n: F.concat(F.lit(n), k.cast("string"))
    nodes = o.select(own("n").alias("id"), F.concat(F.lit("d/"), k.cast("string")).alias("doc_path"), F.lit("k").alias("kind"), F.lit("s").alias("signature_hash"), own("i").alias("impl_hash"), own("f").alias("source_path"), F.when(k % 7 == 5, "n0").alias("absorbed_by"))
    at = F.when(k % 7 == 1, F.concat(F.lit("old/"), k.cast("string"))).when(k % 7 == 2, F.concat(F.lit("lost/"), k.cast("string"))).otherwise(F.concat(F.lit("d/"), k.cast("string")))
    docs = o.filter(k % 7 != 4).select(
        at.alias("path"), F.when(k % 7 == 2, F.lit("gone")).otherwise(own("n")).alias("node_id"), F.when(k % 7 == 3, "cut").alias("error"), F.lit(0).alias("empty_sections"), F.lit(True).alias("accepted"), F.lit("k").alias("accepted_kind"), F.lit("s").alias("accepted_signature"),
        F.when(k % 7 == 6, "old").otherwise(own("i")).alias("accepted_impl"), own("f").alias("source_path"), own("i").alias("impl_hash"),
    )
    return plan.build_plan(nodes, docs)


@query("""SELECT CASE o_orderkey % 7 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'relocate' WHEN 2 THEN 'relocate' WHEN 3 THEN 'refuse' WHEN 4 THEN 'create' WHEN 5 THEN 'keep' ELSE 'update' END AS file_action,
CASE o_orderkey % 7 WHEN 0 THEN 'current' WHEN 1 THEN 'relocated' WHEN 2 THEN 'relocated' WHEN 3 THEN 'broken' WHEN 4 THEN 'missing' WHEN 5 THEN 'orphan' ELSE 'drifted' END AS status, 'd/' || o_orderkey AS doc_path, CASE o_orderkey % 7 WHEN 1 THEN 'old/' || o_orderkey WHEN 2 THEN 'lost/' || o_orderkey END AS relocate_from FROM orders""")
def document_plan(spark, d):
    return _plan(spark, d).select("file_action", "status", "doc_path", "relocate_from")


@query("""SELECT 'd' AS directory, CASE o_orderkey % 7 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'relocate' WHEN 2 THEN 'relocate' WHEN 3 THEN 'refuse' WHEN 4 THEN 'create' WHEN 5 THEN 'keep' ELSE 'update' END AS file_action, count(*) AS n FROM orders GROUP BY 2""")
def plan_directories(spark, d):
    return plan.directory_counts(_plan(spark, d))


@query("""WITH t AS (SELECT 'c' || c_custkey AS id, 'M' || c_nationkey % 4 AS module, 'X' || c_nationkey % 6 AS target FROM customer), n AS (SELECT 's' || s_suppkey AS node, 'M' || s_suppkey % 4 AS m, 'X' || s_nationkey % 5 AS target FROM supplier),
j AS (SELECT t.id, t.target, n.node, CASE WHEN t.module = n.m THEN 0 WHEN t.module = 'M0' AND n.m = 'M1' THEN 1 ELSE 2 END AS r FROM t JOIN n USING (target)), b AS (SELECT *, min(r) OVER (PARTITION BY id, target) AS best FROM j)
SELECT id, target, node, 'direct' AS via FROM b WHERE r = best UNION ALL SELECT id, target, 'impl', 'implementation' FROM t WHERE target NOT IN (SELECT target FROM n)""")
def resolved_links(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    mod = lambda k: F.concat(F.lit("M"), (F.col(k) % 4).cast("string"))
    targets = c.select(_tag("c", "c_custkey").alias("id"), mod("c_nationkey").alias("module"), F.concat(F.lit("X"), (F.col("c_nationkey") % 6).cast("string")).alias("target"))
    nodes = s.select(_tag("s", "s_suppkey").alias("id"), mod("s_suppkey").alias("module"), F.concat(F.lit("X"), (F.col("s_nationkey") % 5).cast("string")).alias("fqn"))
    known = targets.select("target").join(nodes.select(F.col("fqn").alias("target")), "target", "left_anti").distinct().select("target", F.lit("impl").alias("node"))
    return plan.resolve_links(targets, nodes, spark.createDataFrame([("M0", "M1")], "module string, referenced string"), known)


@query("""SELECT 'd/c' || conv_id || '-' || turn || '.md' AS path, '../gone/x.md' AS target FROM conversations WHERE turn % 2 = 1""")
def broken_document_links(spark, d):
    c = table(spark, d, "conversations")
    link = F.when(F.col("turn") % 2 == 1, "[a](../gone/x.md) [b](y.md#top)").otherwise("[a](../d/./q/../y.md) [z](https://h/x)")
    body = F.concat(F.lit("<!-- managed:section:start notes -->\n"), link, F.lit("\n<!-- managed:section:end notes -->\n"))
    docs = c.select(*_file(F.concat(_tag("d/c", "conv_id"), _tag("-", "turn"), F.lit(".md")), body))
    return documents.broken_links(documents.parse_documents(docs), docs.select("path").union(spark.createDataFrame([("d/y.md",)], "path string")))


@query("""SELECT 'd' || conv_id || '.md' AS path, 'section' AS kind, CASE turn WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS name, CASE turn WHEN 0 THEN 'changed' WHEN 1 THEN 'removed' ELSE 'added' END AS change FROM conversations WHERE turn < 3""")
def changed_zones(spark, d):
    c = table(spark, d, "conversations").filter("turn < 3")
    zone = lambda n, b: F.concat(F.lit(f"<!-- managed:section:start {n} -->\n{b}\n<!-- managed:section:end {n} -->\n"))
    has = c.groupBy("conv_id").agg(F.collect_set("turn").alias("turns"))
    when = lambda t, x: F.when(F.array_contains("turns", t), x).otherwise("")
    made = lambda *z: documents.parse_documents(has.select(*_file(F.concat(_tag("d", "conv_id"), F.lit(".md")), F.concat(*z, zone("same", "1")))))
    return documents.zone_diff(made(when(0, zone("a", "1")), when(1, zone("b", "1"))), made(when(0, zone("a", "2")), when(2, zone("c", "1"))))


# --- business documents -----------------------------------------------------------------------------------------------


def _resolved(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    anchors = o.select(F.concat(F.lit("doc"), (F.col("o_custkey") % 40).cast("string")).alias("doc"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("ref"), F.lit(True).alias("verify")).distinct()
    known = o.filter("o_orderpriority <> '5-LOW'").select(F.lit("symbol").alias("rung"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("ref"), F.concat(F.lit("N."), "o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("target")).distinct()
    return business.resolve_anchors(anchors, known)


_ANCHORS = "WITH a AS (SELECT DISTINCT 'doc' || o_custkey % 40 AS doc, o_orderstatus AS kind, o_orderpriority AS ref, 'N.' || o_orderstatus || o_orderpriority[1] AS target FROM orders)"


@query(f"{_ANCHORS} SELECT target, count(DISTINCT doc) AS docs FROM a WHERE ref <> '5-LOW' GROUP BY 1")
def back_links(spark, d):
    return business.backlinks(_resolved(spark, d)).select("target", F.size("docs").cast("long").alias("docs"))


@query(f"""{_ANCHORS}, b AS (SELECT DISTINCT doc FROM a WHERE ref = '5-LOW') SELECT d.doc, CASE WHEN k % 10 = 0 THEN 'broken' WHEN k % 10 = 1 THEN 'empty' WHEN b.doc IS NOT NULL THEN 'broken' WHEN k % 10 = 2 THEN 'undeclared' ELSE 'drifted' END AS status
FROM (SELECT DISTINCT 'doc' || o_custkey % 40 AS doc, o_custkey % 40 AS k FROM orders) d LEFT JOIN b ON d.doc = b.doc""")
def business_states(spark, d):
    k = (F.col("o_custkey") % 40).alias("k")
    docs = table(spark, d, "orders").select(k).distinct().select(_tag("doc", "k").alias("doc"), (F.col("k") % 10 != 0).alias("readable"), (F.col("k") % 10 == 1).cast("int").alias("empty_sections"), F.when(F.col("k") % 10 != 2, "other").alias("accepted_hash"))
    return business.states(docs, _resolved(spark, d)).select("doc", "status")


@query(f"""{_ANCHORS} SELECT doc, kind, ref, CASE WHEN ref = '1-URGENT' THEN 'anchor_removed' WHEN ref = '2-HIGH' THEN 'targets_changed' END AS change, '' AS added FROM a WHERE ref = '1-URGENT' UNION ALL SELECT doc, kind, ref, 'targets_changed', 'other' FROM a WHERE ref = '2-HIGH' UNION ALL SELECT doc, 'Z', 'new', 'anchor_added', '' FROM (SELECT DISTINCT doc FROM a)""")
def changed_facts(spark, d):
    was = _resolved(spark, d)
    now = was.filter("ref <> '1-URGENT'").withColumn("targets", F.when(F.col("ref") == "2-HIGH", F.array(F.lit("other"))).otherwise(F.col("targets")))
    new = was.select("doc").distinct().select("doc", F.lit("Z").alias("kind"), F.lit("new").alias("ref"), F.lit(True).alias("verify"), F.lit(None).cast("string").alias("rung"), F.array().cast("array<string>").alias("targets"), F.lit("unresolved").alias("state"))
    return business.fact_changes(was, now.unionByName(new)).select("doc", "kind", "ref", "change", F.array_join("added", ",").alias("added"))


@query(f"""{_ANCHORS} SELECT 'unresolved' AS "check", doc || ':' || kind || ':' || ref AS subject FROM a WHERE ref = '5-LOW' UNION ALL SELECT 'uncovered_root', 'nowhere' UNION ALL SELECT 'no_anchor', 'loose' UNION ALL SELECT 'unreadable', 'loose' UNION ALL SELECT 'duplicate_id', 'twice' UNION ALL SELECT 'no_anchor', 'twice' UNION ALL SELECT 'no_anchor', 'twice'""")
def business_lint(spark, d):
    resolved = _resolved(spark, d)
    docs = resolved.select("doc", F.lit(True).alias("readable")).distinct().union(spark.createDataFrame([("loose", False), ("twice", True), ("twice", True)], "doc string, readable boolean"))
    roots = table(spark, d, "orders").filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("ref")).distinct().union(spark.createDataFrame([("nowhere",)], "ref string"))
    return business.lint(docs, resolved, roots).select("check", "subject")


@query(f"""{_ANCHORS}, q AS (SELECT 'N.F1' AS asked UNION ALL SELECT 'O2') SELECT asked, doc, kind, ref, (SELECT count(DISTINCT b.doc) - 1 FROM a b WHERE b.kind = a.kind AND b.ref = a.ref)::INTEGER AS siblings FROM a JOIN q ON asked = target OR 'N.' || asked = target WHERE ref <> '5-LOW'""")
def anchors_of_implementations(spark, d):
    found = business.find_by_implementation(_resolved(spark, d), spark.createDataFrame([("N.F1",), ("O2",)], "asked string"))
    return found.select("asked", "doc", "kind", "ref", F.size("siblings").alias("siblings"))


@query("""SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 3 = 0""")
def filtered_anchors(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("kind"), F.concat(F.lit("t"), (F.col("c_nationkey") % 3).cast("string")).alias("team"))
    return business.filter_anchors(rows, ["BUILDING", "MACHINERY"], ["t0"]).select("c_custkey")


# --- recon, rules and questions ---------------------------------------------------------------------------------------


@query("""WITH i AS (SELECT DISTINCT 'o' || o_custkey % 30 AS path, CASE o_orderkey % 3 WHEN 0 THEN 'o' || o_orderkey % 30 WHEN 1 THEN 'N' || o_orderkey % 4 ELSE 'System' END AS target FROM orders), n AS (SELECT DISTINCT 'N' || k % 4 AS target, 'o' || k AS dst FROM (SELECT unnest(range(30)) AS k) WHERE k % 4 <> 3 OR k < 8),
w AS (SELECT target, count(*) AS c FROM n GROUP BY 1), e AS (SELECT path, target AS dst FROM i WHERE target LIKE 'o%' UNION SELECT i.path, n.dst FROM i JOIN n USING (target) JOIN w USING (target) WHERE c <= 7)
SELECT path AS src, dst FROM e WHERE path <> dst""")
def import_edges(spark, d):
    o = table(spark, d, "orders")
    m = lambda c, n: (F.col(c) % n).cast("string")
    target = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("o"), m("o_orderkey", 30))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("N"), m("o_orderkey", 4))).otherwise("System")
    imports = o.select(F.concat(F.lit("o"), m("o_custkey", 30)).alias("path"), target.alias("target"))
    files = spark.range(30)
    spaces = files.filter("id % 4 <> 3 or id < 8").select(F.concat(F.lit("N"), m("id", 4)).alias("namespace"), _tag("o", "id").alias("path"))
    return recon.import_graph(imports, files.select(_tag("o", "id").alias("path")), spaces, most=7)[0]


@query("""WITH c AS (SELECT DISTINCT o_orderpriority AS change, o_orderstatus AS root FROM orders) SELECT change, count(*) AS obvious, count(*) FILTER (root <> 'P') AS found, 'P' AS missed FROM c GROUP BY 1""")
def checked_changes(spark, d):
    changes = table(spark, d, "orders").select(F.col("o_orderpriority").alias("change"), F.col("o_orderstatus").alias("root"))
    return recon.check_changes(changes, changes.filter("root <> 'P'")).select("change", "obvious", "found", F.array_join("missed", ",").alias("missed"))


@query("""SELECT CASE WHEN n_chars > 2000 THEN 'too_large' WHEN n_chars % 50 = 0 THEN 'binary' ELSE 'read' END AS reason, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1""")
def read_limits(spark, d):
    return recon.limits(table(spark, d, "documents").select(F.when(F.col("n_chars") > 2000, "too_large").when(F.col("n_chars") % 50 == 0, "binary").alias("skipped"), F.col("n_chars").alias("length")))


@query("""SELECT o_orderkey AS commit, o_orderpriority AS subject FROM orders WHERE o_custkey % 50 = 1 ORDER BY o_orderdate DESC, o_orderkey LIMIT 5""")
def newest_reasons(spark, d):
    commits = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("author"), F.col("o_orderpriority").alias("subject"), (F.col("o_custkey") % 50).cast("string").alias("file"))
    return recon.why(commits, "1").select("commit", "subject")


@query("""WITH t AS (SELECT c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' WHEN c_acctbal < 0 THEN 'd' END AS r FROM customer) SELECT 'dead_rule' AS "check", 'never' AS subject, 0 AS n UNION ALL SELECT 'idle_team', 'team-x', 0 UNION ALL SELECT 'orphans', c_mktsegment, count(*) FROM t WHERE r IS NULL GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'tie', 'b', count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0) WHERE n > 0""")
def owner_lint(spark, d):
    nodes = table(spark, d, "customer").withColumn("module", F.col("c_mktsegment"))
    own = (Rule("b", 5, {"segment": ["BUILDING"]}, "team-a"), Rule("d", 5, {"below": [0.0]}, "team-b"), Rule("never", 1, {"segment": ["NONE"]}, "team-c"))
    return rules.lint_owners(nodes, own, ("team-a", "team-b", "team-x"), _ORDER_TESTS)


@query("""WITH s AS (SELECT c_custkey, c_name AS fqn, c_mktsegment AS kind FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(c_name, '1')) SELECT fqn, (SELECT count(*) FROM s)::BIGINT AS total FROM s ORDER BY fqn LIMIT 20""")
def selected_decisions(spark, d):
    decided = table(spark, d, "customer").select(F.col("c_name").alias("fqn"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("module"), F.lit("classified").alias("state"))
    rows, total = rules.select(decided, state="classified", kind="BUILDING", module="*1*")
    return rows.select("fqn", F.lit(total).cast("long").alias("total"))


def _index(spark, d) -> questions.Index:
    """Regions as entry points over the keys' graph."""
    edges = _fk_edges(spark, d)
    pairs = graph.reach_pairs(edges, _regions(spark, d))
    kinds = F.create_map(*(F.lit(x) for p in {"r": "entry_point", "n": "nation", "c": "customer", "o": "order"}.items() for x in p))
    keys = edges.select(F.col("src").alias("key")).union(edges.select("dst")).distinct()
    nodes = keys.select("key", kinds[F.substring("key", 1, 1)].alias("kind"), F.col("key").alias("name"), F.lit("").alias("owner"), F.concat(F.lit("f/"), "key").alias("file"), F.create_map(F.lit("entry_kind"), F.lit("region")).alias("attributes"))
    links_ = edges.select(F.lit("calls").alias("kind"), F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("").alias("via"), F.lit(1.0).alias("confidence"))
    return questions.Index(nodes, links_, pairs, search.entries(nodes))


@query("""WITH c AS (SELECT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT 'affects' AS question, 'r' || n_regionkey AS row, 1 AS total FROM c WHERE c_custkey = 7
UNION ALL SELECT 'reaches', 'customer', count(*) FROM c WHERE n_regionkey = 1 UNION ALL SELECT 'reaches', 'nation', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT * FROM (SELECT 'reaches', 'order', count(*) AS n FROM orders JOIN c ON o_custkey = c_custkey WHERE n_regionkey = 1) WHERE n > 0
UNION ALL SELECT 'path', 'r' || n_regionkey || '>n' || n_nationkey || '>c7', 3 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7 UNION ALL SELECT 'card', 'c7', 1 UNION ALL SELECT 'unknown', 'zz', 0""")
def index_questions(spark, d):
    ix = _index(spark, d)
    hit = ix.affects(["f/c7", "zz"])
    rows = [("affects", r["root"], hit.total) for r in hit.rows] + [("reaches", r["kind"], r["total"]) for r in ix.reaches("r1").rows]
    steps = ix.path(hit.rows[0]["root"], "c7").rows
    rows += [("path", ">".join(r["node"] for r in steps), len(steps)), ("card", "c7", ix.card("c7").notes["fanout"])] + [("unknown", u, 0) for u in hit.notes["unknown"]]
    return spark.createDataFrame(rows, "question string, row string, total long")


_STORED: dict[tuple[str, str], str] = {}


@query("""WITH c AS (SELECT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT DISTINCT 'r' || n_regionkey AS root FROM c WHERE c_custkey IN (7, 8, 9)""")
def stored_index(spark, d):
    """Put to an index that is written once for each application and table folder."""
    from ..sources import store
    from .tables import temporary

    at = (spark.sparkContext.applicationId, d)
    if at not in _STORED:
        ix, folder = _index(spark, d), temporary(spark, "index")
        store.write_index(folder, ix.nodes, ix.edges, pairs=ix.pairs.repartition("node").sortWithinPartitions("node"))
        _STORED[at] = folder
    pairs = store.read_index(spark, _STORED[at], "pairs")
    return graph.affects(pairs.filter(F.col("node").isin("c7", "c8", "c9")), spark.createDataFrame([("c7",), ("c8",), ("c9",)], "node string"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT name AS node, 'name' AS field, lower(trim(name)) AS norm FROM n UNION ALL SELECT name, 'brand', lower((SELECT min(p_brand) FROM part WHERE p_name = name)) FROM n UNION ALL SELECT name, 'file', 'f' FROM n""")
def search_entries(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("b"))
    nodes = p.select(F.col("name").alias("key"), "name", F.lit("").alias("owner"), F.lit("F").alias("file"), F.create_map(F.lit("brand"), F.col("b")).alias("attributes"))
    return search.entries(nodes).select("node", "field", "norm")


@query("""SELECT user_id AS id, arg_max(event_type, (epoch_us(ts), event_id)) AS v FROM events GROUP BY 1""")
def latest_versions(spark, d):
    from ..streaming.manifest import merge_changes

    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), at.alias("version"), F.lit(False).alias("deleted"), F.col("event_type").alias("v"))
    return merge_changes(rows.filter("version % 3 = 0"), rows.filter("version % 3 <> 0")).select("id", "v")


@query("""WITH i AS (SELECT p_brand AS ref, p_type AS t, p_partkey AS k FROM part) SELECT ref, count(DISTINCT t) AS implementations, 'x' AS same FROM i GROUP BY 1""")
def merged_registrations(spark, d):
    items = table(spark, d, "part").select(F.lit("job").alias("kind"), F.col("p_brand").alias("ref"), F.create_map(F.lit("impl_fqn"), F.col("p_type"), F.lit("same"), F.lit("x"), F.lit("own"), F.col("p_partkey").cast("string")).alias("fields"), F.lit(None).cast("string").alias("error"))
    out = registries.merge_implementations(items)
    return out.select("ref", F.size("implementations").cast("long").alias("implementations"), F.array_join(F.transform(F.map_entries("fields"), lambda e: e["value"]), ",").alias("same"))


@query("""SELECT 'no entry_kind' AS finding, count(*) AS n FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'unknown kind', count(*) FROM supplier WHERE s_suppkey % 3 = 1 UNION ALL SELECT 'no key', 1 UNION ALL SELECT 'no literal', 1""")
def record_checks(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "entry_point").when(k % 3 == 1, "odd").otherwise("layer")
    rows = s.select(kind.alias("kind"), _tag("k", "s_suppkey").alias("key"), F.create_map(F.lit("role"), F.lit("r")).alias("fields")).union(spark.createDataFrame([("seam", "", {"seam_kind": "q"})], "kind string, key string, fields map<string,string>"))
    return registries.check_records(rows).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


# --- blocks of a report, whole runs ------------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT page_id AS file, CASE page_id % 3 WHEN 0 THEN 'csharp' WHEN 1 THEN 'typescript' ELSE 'html' END AS lang, unnest(['api/x' || page_id % 4, 'queue-' || page_id % 5, 'name', '@lib/core', 'OWN_' || page_id]) AS literal FROM pages),
g AS (SELECT literal, list_sort(list(DISTINCT lang)) AS languages, list_sort(list(DISTINCT CASE WHEN lang = 'csharp' THEN 'dotnet' ELSE 'web' END)) AS families, count(DISTINCT file) AS files FROM l WHERE literal NOT IN ('name', '@lib/core') GROUP BY 1)
SELECT literal, CASE WHEN literal LIKE 'api/%' THEN 'route' WHEN literal LIKE 'OWN%' THEN 'upper_name' ELSE 'dashed_name' END AS kind, array_to_string(languages, ',') AS languages, array_to_string(families, ',') AS families, files FROM g WHERE len(families) > 1 OR (literal LIKE 'api/%' AND files > 1)""")
def seam_candidates(spark, d):
    k = F.col("page_id")
    n = lambda m: (k % m).cast("string")
    literals = F.array(F.concat(F.lit("api/x"), n(4)), F.concat(F.lit("queue-"), n(5)), F.lit("name"), F.lit("@lib/core"), F.concat(F.lit("OWN_"), k.cast("string")))
    rows = table(spark, d, "pages").select(k.alias("file"), F.when(k % 3 == 0, "csharp").when(k % 3 == 1, "typescript").otherwise("html").alias("lang"), F.explode(literals).alias("literal"))
    found = recon.seams(rows, spark.createDataFrame([("@lib/core",)], "target string"))
    return found.select("literal", "kind", F.array_join("languages", ",").alias("languages"), F.array_join("families", ",").alias("families"), "files")


@query(r"""WITH h AS (SELECT o_orderkey, 'c' || o_custkey AS path, CASE WHEN o_orderstatus = 'P' THEN 'Fix a leak' WHEN o_orderstatus = 'F' THEN 'prefix only' ELSE 'add' END AS subject FROM orders)
SELECT 'c' || c_custkey AS path, count(o_orderkey) AS commits, count(*) FILTER (subject = 'Fix a leak') AS fix_commits, count(o_orderkey) * c_nationkey AS score FROM customer LEFT JOIN h ON path = 'c' || c_custkey GROUP BY 1, c_nationkey""")
def file_history(spark, d):
    subject = F.when(F.col("o_orderstatus") == "P", "Fix a leak").when(F.col("o_orderstatus") == "F", "prefix only").otherwise("add")
    history = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("at"), F.lit("a").alias("author"), subject.alias("subject"), _tag("c", "o_custkey").alias("path"))
    files = table(spark, d, "customer").select(_tag("c", "c_custkey").alias("path"), F.col("c_nationkey").alias("lines"))
    return recon.archaeology(history, files).select("path", "commits", "fix_commits", "score")


@query("""SELECT 'graph' AS longer, 'repo/App' AS prefix, count(*) AS files FROM supplier""")
def root_diagnosis(spark, d):
    s = table(spark, d, "supplier")
    file = F.concat(_tag("src/n", "s_nationkey"), _tag("/f", "s_suppkey"), F.lit(".cs"))
    return binding.diagnose_roots(s.select(F.concat(F.lit("repo/App/"), file).alias("file")), s.select(file.alias("file")))


@query("""SELECT 'App.M' || s_nationkey || '.S' || s_suppkey AS fqn, 'App.IRoot' AS target FROM supplier""")
def implemented_interfaces(spark, d):
    s = _symbols(spark, d).filter("module like 'M%'").select("fqn", "type_kind", F.array(F.lit("App.IRoot"), F.lit("Else.IGone")).alias("base_type_closure"))
    root = spark.createDataFrame([("App.IRoot", "interface", [])], "fqn string, type_kind string, base_type_closure array<string>")
    return symbols.relations(s.union(root)).select("fqn", "target")


@query("""SELECT s_suppkey AS id, 'sig' || s_nationkey AS accepted_signature, 'k' AS accepted_kind, CASE WHEN s_suppkey % 2 = 0 THEN 'A,B' ELSE 'A' END AS members FROM supplier""")
def accepted_states(spark, d):
    member = lambda n, public: F.struct(F.lit(n).alias("name"), F.array(F.lit("public") if public is True else F.when(public, "public").otherwise("private")).alias("modifiers"))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), _tag("sig", "s_nationkey").alias("signature_hash"), F.lit("i").alias("impl_hash"), F.lit("k").alias("kind"), F.array(member("B", F.col("s_suppkey") % 2 == 0), member("A", True), member("A", True)).alias("members"))
    return snapshots.accepted_state(rows).select("id", "accepted_signature", "accepted_kind", F.array_join("accepted_members", ",").alias("members"))


@query("""SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS content_hash FROM part WHERE p_partkey % 5 <> 0""")
def cache_upkeep(spark, d):
    p = table(spark, d, "part")
    old = p.select(_tag("p", "p_partkey").alias("path"), F.lit("old").alias("content_hash"))
    put = snapshots.cache_put(old, p.filter("p_partkey % 3 = 0").select(_tag("p", "p_partkey").alias("path"), F.lit("new").alias("content_hash")))
    return snapshots.cache_prune(put, p.filter("p_partkey % 5 <> 0").select(_tag("p", "p_partkey").alias("path")))


def _catalogue(spark, d) -> tuple[DataFrame, DataFrame]:
    """Anchors of orders' customers that ask for an assembly or a team, and who owns their targets."""
    o = table(spark, d, "orders").withColumn("k", F.col("o_custkey") % 30)
    anchors = o.select(
        _tag("d", "k").alias("doc"), F.lit("job").alias("kind"), F.concat(F.lit("r"), (F.col("k") % 6).cast("string")).alias("ref"), F.lit(True).alias("verify"), F.when(F.col("k") % 6 == 5, "unresolved").otherwise("resolved").alias("state"),
        F.when(F.col("k") % 6 == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("N.A"), F.lit("N.B"))).alias("targets"), F.when(F.col("k") % 3 == 0, "asm-a").alias("only_assembly"), F.when(F.col("k") % 3 == 1, "nobody").alias("only_team"),
    ).distinct()
    owners = spark.createDataFrame([("N.A", "asm-a", "t1"), ("N.B", "asm-b", "t2")], "target string, assembly string, team string")
    return business.selected(anchors, owners), owners


_CATALOGUE = "WITH k AS (SELECT DISTINCT o_custkey % 30 AS k FROM orders), a AS (SELECT k, 'd' || k AS doc, 'r' || k % 6 AS ref, CASE WHEN k % 6 = 5 THEN '' WHEN k % 3 = 0 THEN 'N.A' ELSE 'N.A,N.B' END AS targets, k % 3 = 1 AS missed FROM k)"


@query(f"{_CATALOGUE} SELECT doc, ref, targets, missed FROM a")
def selected_targets(spark, d):
    rows, _ = _catalogue(spark, d)
    return rows.select("doc", "ref", F.array_join("targets", ",").alias("targets"), F.col("selector_missed").alias("missed"))


@query(f"{_CATALOGUE} SELECT doc, ref, 'selector_missed' AS reason FROM a WHERE missed UNION ALL SELECT doc, ref, 'not_documented' FROM a WHERE targets = 'N.A'")
def missing_links(spark, d):
    rows, _ = _catalogue(spark, d)
    return business.link_warnings(rows, spark.createDataFrame([("N.B",)], "fqn string")).select("doc", "ref", "reason")


@query(f"""{_CATALOGUE} SELECT 'unresolved' AS "check", doc || ':job:' || ref AS subject FROM a WHERE targets = '' UNION ALL SELECT 'selector-empty', doc || ':job:' || ref FROM a WHERE missed UNION ALL SELECT 'no-entry', doc FROM a WHERE k % 10 = 3 UNION ALL SELECT 'unknown-capability', doc FROM a WHERE k % 10 = 4
UNION ALL SELECT 'unknown-team', doc || ':job:' || ref FROM a WHERE missed UNION ALL SELECT 'team-mismatch', 'job:r0' UNION ALL SELECT 'catalog', 'bad.md' UNION ALL SELECT 'registry-unlinked', 'job:r0:X.Gone' UNION ALL SELECT 'uncovered', 'job:far' UNION ALL SELECT 'pages-uncovered', 'home' UNION ALL SELECT 'features-uncovered', 'pay'""")
def catalogue_checks(spark, d):
    rows, owners = _catalogue(spark, d)
    k = F.regexp_extract("doc", "[0-9]+", 0).cast("int") % 10
    docs = rows.select("doc").distinct().select("doc", F.when(k == 3, "process").otherwise("entity").alias("kind"), F.lit(False).alias("has_entry"), F.when(k == 4, "lost").when(k == 5, "cap").alias("capability"))
    of = lambda ddl, *r: spark.createDataFrame(list(r), ddl)
    records = of("kind string, ref string, team string, target string, linked boolean", ("job", "r0", "t2", "N.A", True), ("job", "r0", None, "X.Gone", False), ("job", "far", "t1", "N.A", True))
    found = business.lint_catalog(docs, rows, of("id string", ("cap",)), of("id string", ("t1",), ("t2",)), records, owners, of("route string", ("home",)), of("name string", ("pay",)), of("doc string", ("bad.md",)))
    return found.select("check", "subject")


def _estate(spark, d) -> DataFrame:
    """Files of a small estate: a class for each supplier, a project for each nation and what they share."""
    from .catalog_code import _CLASS, _SHARED

    s = table(spark, d, "supplier")
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    digit = lambda n: (F.col("s_suppkey") % n).cast("string")
    body = _fill(_CLASS, n=nation, k=key, b=digit(3), i=digit(10), j=((F.col("s_suppkey") + 1) % 10).cast("string"))
    code = s.select(*_file(F.concat(F.lit("src/M"), nation, F.lit("/S"), key, F.lit(".cs")), body))
    project = s.select(nation.alias("n")).distinct().select(*_file(F.concat(F.lit("src/M"), "n", F.lit("/M"), "n", F.lit(".csproj")), F.lit("<Project><ItemGroup><ProjectReference Include='../Shared/Shared.csproj'/></ItemGroup></Project>")))
    shared = spark.createDataFrame([*_SHARED, ("src/Shared/Shared.csproj", "<Project></Project>")], "path string, text string").select(*_file(F.col("path"), F.col("text")))
    return code.union(project).union(shared)


def _scanned(spark, d):
    from ..operators import run

    kinds = [Rule("service", 5, {"name_regex": ["S[0-9]+"]}, "service")]
    return run.scan(_estate(spark, d), kinds, excludes=[Rule("roots", 0, {"name_suffix": ["Root"]}, "a root")])


@query("""SELECT 'files' AS what, count(*) + 3 AS n FROM supplier UNION ALL SELECT 'parse_errors', 0 UNION ALL SELECT 'declarations', count(*) + 15 FROM supplier UNION ALL SELECT 'symbols', count(*) + 14 FROM supplier UNION ALL SELECT 'modules', count(DISTINCT s_nationkey) + 1 FROM supplier
UNION ALL SELECT 'nodes', count(*) FROM supplier UNION ALL SELECT 'state:classified', count(*) FROM supplier UNION ALL SELECT 'state:excluded', 1 UNION ALL SELECT 'state:undecided', 13""")
def scan_counters(spark, d):
    return _scanned(spark, d).counters


@query("""SELECT 'entry:GET api/s' || s_suppkey || '/{}/get' AS root, 5 AS reached FROM supplier""")
def built_index(spark, d):
    from ..operators import run

    index, _ = run.build(_scanned(spark, d))
    return index.pairs.filter("node <> root").groupBy("root").agg(F.count(F.lit(1)).cast("int").alias("reached"))


@query("""SELECT 'Page' || page_id || 'Service' AS name, 'api_service' AS kind, 2 AS n_calls, 0 AS n_routes FROM pages""")
def web_run(spark, d):
    from ..operators import run
    from .catalog_code import _SERVICE

    k = F.col("page_id").cast("string")
    files = table(spark, d, "pages").select(*_file(F.concat(F.lit("src/app/p"), k, F.lit(".ts")), _fill(_SERVICE, k=k, w=F.concat(F.lit("w"), (F.col("page_id") % 7).cast("string")))))
    found = run.scan_web(files, spark.createDataFrame([("app", "src/app")], "module string, source_root string"), [Rule("s", 1, {"attribute": ["Injectable"]}, "service")])
    return found.nodes.select("name", "kind", "n_calls", "n_routes")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'docs/processes/' || o_custkey || '/x.md' WHEN o_orderstatus = 'O' THEN 'docs/capabilities/' || o_custkey || '/x.md' END AS path, o_custkey || ' ' || CASE WHEN o_custkey % 100 BETWEEN 11 AND 14 THEN 'rows' WHEN o_custkey % 10 = 1 THEN 'row' WHEN o_custkey % 10 BETWEEN 2 AND 4 THEN 'few rows' ELSE 'rows' END AS size,
CASE WHEN o_orderstatus = 'F' THEN 's' || o_custkey ELSE '' END AS state FROM orders""")
def small_texts(spark, d):
    key = F.col("o_custkey").cast("string")
    prefix = F.when(F.col("o_orderstatus") == "F", "bp").when(F.col("o_orderstatus") == "O", "cap").otherwise("odd")
    decorator = F.array(F.struct(F.when(F.col("o_orderstatus") == "F", "State").otherwise("Other").alias("name"), F.array(F.concat(F.lit("{ defaults: 1, name: 's"), key, F.lit("' }"))).alias("args")))
    return table(spark, d, "orders").select(
        "o_orderkey", text.business_path(F.concat(prefix, F.lit("."), key, F.lit(".x")), "docs").alias("path"), text.counted(F.col("o_custkey"), "row", "few rows", "rows").alias("size"), text.state_name(decorator).alias("state")
    )
