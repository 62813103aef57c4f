"""Queries of the scanners and of what is built on them, over source files written from the synthetic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import routes, text
from ..operators import binding, business, graph, search, symbols, web
from ..sources import csharp, documents, registries, typescript
from .catalog import query
from .tables import table


def _file(path: Column, body: Column) -> tuple[Column, Column, Column]:
    return path.alias("path"), body.alias("text"), F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("content_hash")


def _fill(template: str, **values: Column) -> Column:
    parts: list[Column] = []
    for i, piece in enumerate(template.split("§")):
        parts.append(values[piece] if i % 2 else F.lit(piece))
    return F.concat(*parts)


_CLASS = """using Lib.N§n§;
namespace App.M§n§;

/// <summary>Supplier §k§.</summary>
[Route("api/s§k§")]
public sealed class S§k§ : Base§b§, IS§i§<string>
{
    private readonly IPart _part; // a "comment" { with marks
    public S§k§(IPart part, IS§j§<string> other = null) { _part = part; var x = new Order(1); }
    [HttpGet("{id:int}/[action]")]
    public int GetAsync(int id) => id;
    public string Name { get; set; } = "}";
}
"""
_SHARED = (
    ("src/Shared/App.cs", "namespace App { public class Base0 : Root { } public abstract class Root { } public interface IPart { void Do(); } }"),
    ("src/Shared/Lib.cs", "namespace Lib.N5;\npublic partial class Base1 { }\npublic partial class Base1 : System.IDisposable { }"),
    ("src/Shared/Services.cs", "namespace App.Services;\n" + "\n".join(f"public interface IS{i}<T> {{ T Get(); }}" for i in range(10))),
)


def _csharp(spark, d) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "supplier")
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    digit = lambda n: (F.col("s_suppkey") % n).cast("string")
    body = _fill(_CLASS, n=nation, k=key, b=digit(3), i=digit(10), j=((F.col("s_suppkey") + 1) % 10).cast("string"))
    files = s.select(*_file(F.concat(F.lit("src/M"), nation, F.lit("/S"), key, F.lit(".cs")), body))
    shared = spark.createDataFrame(list(_SHARED), "path string, text string").select(*_file(F.col("path"), F.col("text")))
    register = s.select(*_file(F.concat(F.lit("src/Startup/R"), key, F.lit(".cs")), _fill("class R§k§ { void Add(IServiceCollection s) { s.AddScoped<IS§i§<string>, S§k§>(); s.AddSingleton<S§k§>(); s.AddTransient<IOther>(p => new Other()); } }", k=key, i=digit(10))))
    parsed = csharp.parse_files(files.union(shared).union(register))
    return parsed, parsed.select("path", F.split_part("path", F.lit("/"), F.lit(2)).alias("module"))


def _symbols(spark, d) -> DataFrame:
    return symbols.build_symbols(*_csharp(spark, d))


@query("""SELECT 'M' || s_nationkey || '#App.M' || s_nationkey || '.S' || s_suppkey AS key, 'Base' || s_suppkey % 3 || ';IS' || s_suppkey % 10 || '<string>' AS bases, '_part,S' || s_suppkey || ',GetAsync,Name' AS members, 'Supplier ' || s_suppkey || '.' AS doc, 5 AS first_line, 13 AS last_line FROM supplier""")
def csharp_symbols(spark, d):
    s = _symbols(spark, d).filter("module like 'M%'")
    return s.select("key", F.array_join("base_types_raw", ";").alias("bases"), F.array_join(F.transform("members", lambda m: m["name"]), ",").alias("members"), F.col("xml_doc").alias("doc"), F.get("sources", F.lit(0))["start"].alias("first_line"), F.get("sources", F.lit(0))["end"].alias("last_line"))


@query("SELECT 'App.M' || s_nationkey || '.S' || s_suppkey AS fqn, 'GET' AS http_method, 'api/s' || s_suppkey || '/{}/get' AS route FROM supplier")
def csharp_endpoints(spark, d):
    return symbols.endpoints(_symbols(spark, d)).select("fqn", "http_method", "route")


@query("""SELECT 'App.M' || s_nationkey || '.S' || s_suppkey AS fqn, CASE WHEN s_suppkey % 3 = 0 THEN 'App.Base0' WHEN s_suppkey % 3 = 1 AND s_nationkey = 5 THEN 'Lib.N5.Base1' ELSE 'Base' || s_suppkey % 3 END AS resolved FROM supplier""")
def csharp_bases(spark, d):
    s = _symbols(spark, d)
    return symbols.resolve_bases(s).filter("raw like 'Base%'").join(s.select("key", "fqn"), "key").select("fqn", "resolved")


@query("""SELECT 'App.M' || s_nationkey || '.S' || s_suppkey AS fqn, array_to_string(list_sort(CASE WHEN s_suppkey % 3 = 0 THEN ['App.Base0', 'Root', 'IS' || s_suppkey % 10] WHEN s_suppkey % 3 = 1 AND s_nationkey = 5 THEN ['Lib.N5.Base1', 'System.IDisposable', 'IS' || s_suppkey % 10] ELSE ['Base' || s_suppkey % 3, 'IS' || s_suppkey % 10] END), ',') AS closure FROM supplier""")
def csharp_closures(spark, d):
    s = _symbols(spark, d)
    done = symbols.base_closures(s, symbols.resolve_bases(s)).filter("fqn like 'App.M%'")
    return done.select("fqn", F.array_join(F.array_sort(F.transform("base_type_closure", lambda b: F.when(b == "App.Root", "Root").otherwise(b))), ",").alias("closure"))


@query("""SELECT 'App.M' || s_nationkey || '.S' || s_suppkey AS fqn, t.target, t.via, t.confidence FROM supplier, LATERAL (SELECT unnest(['App.IPart', 'App.Services.IS' || (s_suppkey + 1) % 10, 'App.Services.IS' || s_suppkey % 10]) AS target, unnest(['constructor', 'constructor', 'di']) AS via, 'high' AS confidence) t""")
def csharp_dependencies(spark, d):
    parsed, modules = _csharp(spark, d)
    registrations = parsed.select("path", F.inline("registrations"))
    return symbols.dependencies(symbols.build_symbols(parsed, modules), registrations)


@query("SELECT 'App.Services.IS' || s_suppkey % 10 AS service, count(*) AS implementations, 1.0::DOUBLE AS confidence FROM supplier GROUP BY 1")
def csharp_binds(spark, d):
    parsed, modules = _csharp(spark, d)
    nodes, _ = symbols.symbol_graph(symbols.build_symbols(parsed, modules))
    edges, _ = binding.binds(parsed.select(F.col("path").alias("file"), F.inline("registrations")), nodes)
    named = nodes.select(F.col("key").alias("source"), F.col("attributes")["fqn"].alias("service"))
    return edges.join(named, "source").groupBy("service").agg(F.count(F.lit(1)).alias("implementations"), F.max("confidence").alias("confidence"))


@query("SELECT 'bound' AS reason, count(*) AS n FROM supplier UNION ALL SELECT 'self', count(*) FROM supplier")
def csharp_bind_reasons(spark, d):
    parsed, modules = _csharp(spark, d)
    nodes, _ = symbols.symbol_graph(symbols.build_symbols(parsed, modules))
    return binding.binds(parsed.select(F.col("path").alias("file"), F.inline("registrations")), nodes)[1]


_SERVICE = """import { HttpClient } from '@angular/common/http';
@Injectable({ providedIn: 'root' })
export class Page§k§Service {
  private readonly base = '/api/§w§';
  constructor(private http: HttpClient) {}
  one(id: string) { return this.http.get<Page>(`${this.base}/${id}/x?y=1`); } // this.http.get('never')
  save(id: string) { return this.http.post('api/§w§/' + id, {}); }
  any(url: string) { return this.http.delete(url); }
}
"""


@query("""WITH w AS (SELECT page_id, 'w' || page_id % 7 AS w FROM pages) SELECT page_id, 'GET' AS http_method, 'api/' || w || '/{}/x' AS route, NULL AS reason, 'one' AS member FROM w UNION ALL SELECT page_id, 'POST', 'api/' || w || '/{}', NULL, 'save' FROM w UNION ALL SELECT page_id, 'DELETE', NULL, 'parameter', 'any' FROM w""")
def typescript_calls(spark, d):
    k = F.col("page_id").cast("string")
    files = table(spark, d, "pages").select(*_file(F.concat(F.lit("src/app/p"), k, F.lit(".ts")), _fill(_SERVICE, k=k, w=F.concat(F.lit("w"), (F.col("page_id") % 7).cast("string")))))
    calls = typescript.parse_files(files).select(F.regexp_extract("path", "p([0-9]+)", 1).cast("long").alias("page_id"), F.inline("http_calls"))
    return calls.select("page_id", "http_method", routes.normalize_route(F.col("url")).alias("route"), "reason", "member")


_ITEM = registries.Spec("suppliers", "service", ("conf/*.xml",), "./Items/Item", {"ref": "@Name", "impl_fqn": "@Class", "nation": "Nation", "tag": "#tag"}, children=registries.Spec("suppliers", "part", (), "Part", {"ref": "@Id"}))


@query("""SELECT 'service' AS kind, s_name AS ref, '' AS parent_ref, 'App.S' || s_suppkey AS impl FROM supplier UNION ALL SELECT 'part', 'P' || s_suppkey, s_name, NULL FROM supplier""")
def registry_items(spark, d):
    s = table(spark, d, "supplier")
    item = F.concat(F.lit("<Item Name='"), "s_name", F.lit("' Class='App.S"), F.col("s_suppkey").cast("string"), F.lit("'><Nation>N"), F.col("s_nationkey").cast("string"), F.lit("</Nation><Part Id='P"), F.col("s_suppkey").cast("string"), F.lit("'/></Item>"))
    body = F.concat(F.lit("<Root><Items>"), F.array_join(F.array_sort(F.collect_list(item)), ""), F.lit("</Items></Root>"))
    files = s.groupBy("s_nationkey").agg(body.alias("body")).select(*_file(F.concat(F.lit("conf/n"), F.col("s_nationkey").cast("string"), F.lit(".xml")), F.col("body")))
    return registries.read_registry(files, _ITEM).select("kind", "ref", "parent_ref", F.try_element_at("fields", F.lit("impl_fqn")).alias("impl"))


@query("""SELECT DISTINCT 'root/' || lower(r_name) || '/n' || n_nationkey AS path, 'Nation' || n_nationkey AS component, false AS unresolved FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 4 UNION ALL SELECT 'root/' || lower(r_name), 'missing', true FROM region WHERE r_regionkey = 4""")
def route_expansion(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    none, name = F.lit(None).cast("string"), F.lower("r_name")
    root = r.select(F.lit("app").alias("table"), F.concat(F.lit("root/"), name).alias("path"), none.alias("component"), F.when(F.col("r_regionkey") == 4, "missing").otherwise(F.concat(F.lit("t"), F.col("r_regionkey").cast("string"))).alias("spread"))
    leaf = n.filter("n_regionkey <> 4").select(F.concat(F.lit("t"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("Nation"), F.col("n_nationkey").cast("string")), none)
    return web.expand_routes(root.union(leaf))


@query("""SELECT conv_id, turn, role AS name, len(trim(regexp_replace(text, '\\s+', ' ', 'g'))) = 0 AS empty, true AS restored FROM conversations""")
def document_zones(spark, d):
    c = table(spark, d, "conversations")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    body = F.concat(F.lit("---\nid: "), key, F.lit("\n---\n# Title\n<!-- managed:generated:start -->\nx\n<!-- managed:generated:end -->\n<!-- managed:section:start "), "role", F.lit(" -->\n"), "text", F.lit("\n<!-- managed:section:end "), "role", F.lit(" -->\nend"))
    files = c.select(*_file(F.concat(F.lit("docs/"), key, F.lit(".md")), body))
    parsed = documents.parse_documents(files).join(files.select("path", "text"), "path")
    parts = parsed.select("path", (documents.assemble(F.col("front_matter"), F.col("segments")) == F.col("text")).alias("restored"), F.explode("segments").alias("s")).filter("s.kind = 'section'")
    ids = F.split(F.regexp_extract("path", "docs/(.*)[.]md", 1), "-")
    return parts.select(ids[0].cast("long").alias("conv_id"), ids[1].cast("long").alias("turn"), F.col("s.name").alias("name"), documents.is_empty(F.col("s.body")).alias("empty"), "restored")


@query("""WITH a AS (SELECT 'doc' || o_orderkey % 50 AS doc, o_orderpriority AS ref, o_orderstatus AS kind FROM orders GROUP BY 1, 2, 3), k AS (SELECT kind, ref, count(DISTINCT t) AS n FROM (SELECT 'O' AS kind, o_orderpriority AS ref, 't' || o_custkey % 2 AS t FROM orders WHERE o_orderpriority < '3' UNION SELECT 'F', o_orderpriority, 'u' FROM orders) GROUP BY 1, 2),
r AS (SELECT a.doc, a.kind, a.ref, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS state FROM a LEFT JOIN k ON a.kind = k.kind AND a.ref = k.ref) SELECT doc, state, count(*) AS n FROM r GROUP BY 1, 2""")
def anchor_ladder(spark, d):
    o = table(spark, d, "orders")
    anchors = o.select(F.concat(F.lit("doc"), (F.col("o_orderkey") % 50).cast("string")).alias("doc"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("ref"), F.lit(True).alias("verify")).distinct()
    low = o.filter("o_orderpriority < '3'").select(F.lit("registry").alias("rung"), F.lit("O").alias("kind"), F.col("o_orderpriority").alias("ref"), F.concat(F.lit("t"), (F.col("o_custkey") % 2).cast("string")).alias("target"))
    known = low.union(o.select(F.lit("symbol"), F.lit("F"), "o_orderpriority", F.lit("u"))).union(low.select(F.lit("literal"), "kind", "ref", F.lit("later"))).distinct()
    return business.resolve_anchors(anchors, known).groupBy("doc", "state").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders), x AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b, l_returnflag AS action FROM lineitem), f AS (SELECT a, b, min(action) AS action FROM x GROUP BY 1, 2)
SELECT e.a AS page, f.b AS type, 2 AS level, min(f.action) AS action FROM e JOIN f ON e.b = f.a GROUP BY 1, 2""")
def called_chain(spark, d):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o = table(spark, d, "orders").select(tag("c", "o_custkey").alias("type"), F.lit("m").alias("member"), tag("o", "o_orderkey").alias("to_type"), F.lit("m").alias("to_member"), F.lit("").alias("action"))
    lines = table(spark, d, "lineitem").select(tag("o", "l_orderkey"), F.lit("m"), tag("p", "l_partkey"), F.lit("m"), F.col("l_returnflag"))
    start = o.select(F.col("type").alias("page"), "type", "member")
    return web.called_from(start, o.union(lines)).filter("level = 2").select("page", "type", "level", "action")


@query()
def fuzzy_close(spark, d):
    names = table(spark, d, "supplier").select(F.col("s_name").alias("name")).union(table(spark, d, "part").select("p_name"))
    return search.similar_names(names, spark.createDataFrame([("red wigdet",), ("Suplier#000000007",)], "name string"))


@query("""WITH n AS (SELECT 'type:' || s_suppkey AS key FROM supplier) SELECT 'member' AS kind, count(*) * 4 AS n FROM n UNION ALL SELECT 'type', count(*) FROM n""")
def graph_assembly(spark, d):
    s = _symbols(spark, d).filter("module like 'M%'")
    nodes, edges = symbols.symbol_graph(s)
    kept, _, _ = binding.assemble([(nodes, edges), (nodes, edges)])
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT root, count(*) AS reached FROM (SELECT 'type:M' || s_nationkey || '#App.M' || s_nationkey || '.S' || s_suppkey AS root, unnest(range(0, 5)) AS i FROM supplier) GROUP BY 1""")
def graph_reach(spark, d):
    nodes, _ = symbols.symbol_graph(_symbols(spark, d).filter("module like 'M%'"))
    types = nodes.filter("kind = 'type'")
    entries = types.select(F.concat(F.lit("entry:"), "key").alias("key"), F.lit("entry_point").alias("kind"), F.lit("").alias("owner"))
    edges = types.select(F.lit("dispatches").alias("kind"), F.concat(F.lit("entry:"), "key").alias("source"), F.col("key").alias("target"))
    pairs = graph.reach_pairs(graph.adjacency(nodes.select("key", "kind", "owner").union(entries), edges), entries.select(F.col("key").alias("root")))
    return pairs.filter("node <> root").groupBy(F.substring("root", 7, 1000).alias("root")).agg(F.count(F.lit(1)).alias("reached"))


@query(r"""WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS x FROM documents) SELECT x, CASE WHEN contains(x, '/') THEN 'route' WHEN regexp_matches(x, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$') THEN 'upper_name' WHEN regexp_matches(x, '^[A-Za-z_]\w*(\.\w+)+$') THEN 'dotted_name' WHEN regexp_matches(x, '^[a-z0-9]+([-.][a-z0-9]+)+$') THEN 'dashed_name' ELSE 'identifier' END AS kind FROM w""")
def seam_kinds(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("x")).distinct()
    return words.select("x", text.seam_kind(F.col("x")).alias("kind"))
