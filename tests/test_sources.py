"""Scanners against hand-written expectations, and file discovery on a small tree."""

import pytest
from pyspark.sql import functions as F

from estatelens.functions import paths, routes, signatures, text
from estatelens.sources import csharp, documents, files, registries, sqltext, store, typescript, workspace

SAMPLE = """using System;
global using Lib;
namespace A.B
{
    /// <summary>Makes <c>things</c>.</summary>
    [Route("api/[controller]"), Obsolete("no", error = true)]
    public sealed partial class Maker<T, K> : Base<Dictionary<string, int>>, IMaker where T : class
    {
        private readonly Dictionary<string, int> _map = new() { ["}"] = 1 };
        public Maker(IOptions o, [FromServices] ILog log = null) : base(o) { }
        public (int, int) Pair<Q>(int x, Func<int, int> f) => (x, f(1));
        public string Name { get; private set; } = "a";
        public event EventHandler Done;
        public int this[int i] => i;
        [HttpGet("x/{id}")] async Task<T> GetAsync(int id) { var s = $@"{{ ""q"" }}"; Run("sql text", 1); return new Thing<T>(id); }
        class Inner { int y; }
    }
    public record struct Point(int X, int Y);
    public enum Kind { One, Two = 2 }
}
"""


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, text string").withColumn("content_hash", F.sha2("text", 256))


def test_csharp_declarations():
    got = csharp.parse("a.cs", SAMPLE)
    assert got["parse_errors"] == 0 and got["usings"] == ["System"] and got["global_usings"] == ["Lib"]
    maker, inner, point, kind = got["declarations"]
    assert (maker["name"], maker["namespace"], maker["type_parameters"], maker["base_types"]) == ("Maker", "A.B", ["T", "K"], ["Base<Dictionary<string, int>>", "IMaker"])
    assert maker["modifiers"] == ["public", "sealed", "partial"] and maker["xml_doc"] == "Makes things ." and (maker["start"], maker["end"]) == (6, 17)
    assert [(a["name"], a["args"], a["named_args"]) for a in maker["attributes"]] == [("Route", ["api/[controller]"], []), ("Obsolete", ["no"], [("error", "true")])]
    assert [(m["name"], m["kind"]) for m in maker["members"]] == [("_map", "field"), ("Maker", "constructor"), ("Pair", "method"), ("Name", "property"), ("Done", "event"), ("this", "indexer"), ("GetAsync", "method")]
    assert inner["containing_type"] == "Maker" and (point["type_kind"], point["members"][0]["kind"]) == ("record", "constructor") and [m["name"] for m in kind["members"]] == ["One", "Two"]
    assert [(c["type_name"], c["member"]) for c in got["constructions"]] == [("Thing<T>", "GetAsync")] and [(c["method"], c["arguments"]) for c in got["literal_calls"]] == [("Run", ["sql text"])]


def test_csharp_registrations_and_damage():
    body = "class P { void C(IServiceCollection s) { s.AddScoped<IA, A>(); s.AddSingleton<B>(); s.AddTransient(typeof(IC<>), typeof(C<>)); s.AddScoped(typeof(ID), impl); s.AddScoped<IE>(p => new E()); } }"
    got = [(r["service_type"], r["impl_type"], r["lifetime"], r["confidence"]) for r in csharp.parse("p.cs", body)["registrations"]]
    assert got == [("IA", "A", "scoped", "high"), ("B", "B", "singleton", "high"), ("IC<>", "C<>", "transient", "high"), ("ID", None, "scoped", "medium")]
    assert csharp.parse("x.cs", "class A { void B( { }")["parse_errors"] > 0 and csharp.parse("e.cs", "")["declarations"] == []


def test_typescript():
    source = """import Def, { A as B } from './a'; // import { X } from 'y'
export * from './c';
@Component({ selector: 'x' })
export class P extends Q<R> implements S, T {
  private readonly base = '/api/p';
  audit = inject(Audit);
  constructor(private readonly svc: Svc, plain: number) { super(); }
  load(id: string): Observable<{ a: string }> { return this.http.get<P>(`${this.base}/${id}`); }
  save() { this.store.dispatch(new Save(1)); return this.svc.go('(x'); }
}
const r: Routes = [{ path: 'a', component: P, children: [...more, { path: ':id', component: Q }] }, { path: '**', redirectTo: 'a' }];
"""
    got = typescript.parse("p.ts", source)
    assert [(i["source"], [(n["local"], n["imported"]) for n in i["names"]], i["star"], i["re_export"]) for i in got["imports"]] == [("./a", [("B", "A"), ("Def", "default")], False, False), ("./c", [], True, True)]
    p = got["declarations"][0]
    assert (p["name"], p["base_types"], [b["name"] for b in p["bindings"]]) == ("P", ["Q<R>", "S", "T"], ["svc", "audit"])
    assert [m["name"] for m in p["members"]] == ["base", "audit", "constructor", "load", "save"]
    assert [(c["http_method"], c["url"], c["member"]) for c in got["http_calls"]] == [("GET", "/api/p/{}", "load")]
    assert [(r["path"], r["component"], r["spread"]) for r in got["routes"]] == [("a", "P", None), ("a", None, "more"), ("a/:id", "Q", None)]
    assert [(d["action"], d["member"]) for d in got["dispatches"]] == [("Save", "save")] and got["parse_errors"] == 0


def test_registries(spark):
    xml = "<R><L N='J'><I K='a' C='X.A, Asm'><S Id='1'/></I><I C='lost'/></L><L N='Z'><I K='z'/></L></R>"
    spec = registries.Spec("jobs", "job", ("d/*.xml",), "./L[@N='J']/I", {"ref": "@K", "impl": "@C", "tag": "#tag", "step": "S/@Id"}, children=registries.Spec("jobs", "step", (), "S", {"ref": "@Id"}))
    rows = registries.read_registry(frame(spark, [("d/a.xml", xml), ("d/b.xml", "<broken"), ("e/c.xml", xml)]), spec).collect()
    assert sorted((r.kind, r.ref, r.parent_ref, r.depth) for r in rows if r.error is None) == [("job", "a", "", 0), ("step", "1", "a", 1)]
    assert dict(next(r.fields for r in rows if r.ref == "a")) == {"impl": "X.A, Asm", "tag": "I", "step": "1"}
    assert sorted(r.error.split(":")[0] for r in rows if r.error) == ["item 1 has no ref", "unreadable"]
    flow = registries.Spec("flow", "flow", ("*.json",), "", {"ref": "Id", "v": "Version"}, "json", registries.Spec("flow", "step", (), "Steps", {"ref": "Id", "next": "Next.Id"}, "json"))
    rows = registries.read_registry(frame(spark, [("f.json", '{"Id": "F", "Version": 2, /* c */ "Steps": [{"Id": "s", "Next": {"Id": "t"}},]}')]), flow).collect()
    assert sorted((r.kind, r.ref, r.parent_ref, tuple(sorted(r.fields.items()))) for r in rows) == [("flow", "F", "", (("v", "2"),)), ("step", "s", "F", (("next", "t"),))]
    names = spark.createDataFrame([("Foo`2[[System.String, mscorlib],[System.Int32, mscorlib]], Asm, Version=1",), ("A.B, C",), ("Plain",)], "x string")
    assert [tuple(r.t) for r in names.select(registries.type_name(F.col("x")).alias("t")).collect()][1:] == [("A.B", "C"), ("Plain", "")]


def test_merged_implementations(spark):
    items = spark.createDataFrame([("k", "a", {"impl_fqn": "X", "team": "t", "env": "1"}, None), ("k", "a", {"impl_fqn": "Y", "team": "t", "env": "2"}, None), ("k", "b", {"impl_fqn": "Z"}, None)], "kind string, ref string, fields map<string,string>, error string")
    got = {r.ref: (r.implementations, r.fields) for r in registries.merge_implementations(items).collect()}
    assert got == {"a": (["X", "Y"], {"team": "t"}), "b": (["Z"], {})}


def test_projects_and_solutions(spark):
    proj = "<Project><PropertyGroup><TargetFrameworks>net8.0;net9.0</TargetFrameworks></PropertyGroup><ItemGroup><ProjectReference Include='..\\Core\\Core.csproj'/><PackageReference Include='Z'/><PackageReference Include='A'/></ItemGroup></Project>"
    sln = 'Project("{9A}") = "A", "src\\A\\A.csproj", "{1}"\nEndProject\n'
    f = frame(spark, [("src/A/A.csproj", proj), ("x.sln", sln), ("y.slnx", '<Solution><Project Path="src/B/B.csproj" /></Solution>')])
    r = registries.projects(f).first()
    assert (r.target_frameworks, r.project_references, r.package_references) == (["net8.0", "net9.0"], ["src/Core/Core.csproj"], ["A", "Z"])
    assert sorted(tuple(x) for x in registries.solution_projects(f).collect()) == [("x.sln", "src/A/A.csproj"), ("y.slnx", "src/B/B.csproj")]


@pytest.mark.parametrize("body", ["plain\r\ntext", "---\na: 1\n---\n# T\n<!-- managed:section:start notes -->\n<!-- hint -->\n<!-- managed:section:end notes -->\nend", "    <!-- managed:generated:start -->\n", ""])
def test_documents_restore(body):
    got = documents.parse_document(body)
    assert got["front_matter"] + "".join(s["text"] for s in got["segments"]) == body


def test_damaged_documents(spark):
    bad = ["---\nopen", "<!-- managed:generated:start -->", "<!-- managed:generated:end -->", "<!-- managed:section:start a -->\n<!-- managed:section:end b -->", "<!-- managed:section:start a -->\n<!-- managed:section:end a -->\n<!-- managed:section:start a -->\n<!-- managed:section:end a -->"]
    assert all(documents.parse_document(b).get("error") for b in bad)
    text_ = "<!-- managed:section:start a -->\n[x](../b.md) [y](c.md#top) [z](https://q)\n<!-- managed:section:end a -->\n"
    docs = documents.parse_documents(frame(spark, [("d/e/a.md", text_)]))
    assert [tuple(r) for r in documents.broken_links(docs, frame(spark, [("d/b.md", "")])).collect()] == [("d/e/a.md", "c.md")]


def test_sql_facts(spark):
    sql = "CREATE OR ALTER PROCEDURE dbo.P AS SELECT * FROM [A].[B] JOIN #t ON 1=1 -- FROM no\n/* FROM never */ INSERT INTO @x EXEC Q; UPDATE b SET c = 1; EXEC (@s)"
    r = spark.createDataFrame([(sql,), (None,)], "t string").select(sqltext.sql_facts(F.col("t")).alias("f")).collect()
    f = r[0].f
    assert ([tuple(d) for d in f.defines], f.reads, f.writes, f.calls, f.dynamic, f.temporary) == ([("dbo.p", "procedure")], ["a.b"], ["b"], ["q"], True, 2)
    assert (r[1].f.reads, r[1].f.dynamic, r[1].f.temporary) == ([], False, 0)


def test_discover(spark, tmp_path):
    for name, body in {"src/a.cs": "class A {}", "src/obj/b.cs": "x", "lib/c.ts": "let a;", "lib/bin.ts": "a\0b", "README.md": "#"}.items():
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    rows = {r.path: (r.lang, r.skipped) for r in files.discover(spark, str(tmp_path / "root"), excludes=["*.md"]).collect()}
    assert rows == {"src/a.cs": ("csharp", None), "lib/c.ts": ("typescript", None), "lib/bin.ts": ("typescript", "binary")}
    assert [r.path for r in files.discover(spark, str(tmp_path / "root"), scope=["src"]).collect()] == ["src/a.cs"]
    parsed = csharp.parse_files(files.with_text(files.discover(spark, str(tmp_path / "root"), scope=["src"])))
    assert [d.name for d in parsed.first().declarations] == ["A"]


def test_workspace_and_code_facts(spark):
    angular = '{ /* c */ "projects": { "app": { "root": "", "sourceRoot": "src", "architect": { "build": { "options": { "tsConfig": "tsconfig.app.json" } } } } } }'
    f = frame(spark, [("w/angular.json", angular), ("w/tsconfig.json", '{"extends": "./base.json", "compilerOptions": {"baseUrl": ".", "paths": {"@s/*": ["src/s/*"]}}}'), ("a.py", "T = {'job': mod.run, 'x': 1}\nL: list = [('two', f)]\nreg('call', g.h)"), ("bad.py", "def ("), ("i.xml", "<a><b Name='one'/><b Name='has space'/></a>")])
    assert [(r.module, r.root, r.source_root, r.tsconfig) for r in workspace.workspace_modules(f).collect()] == [("app", "w", "w/src", "w/tsconfig.app.json")]
    assert [(r.prefix, r.target) for r in workspace.import_aliases(f).collect()] == [("@s/", "w/src/s")]
    rows = workspace.python_registrations(f, call="reg").collect()
    assert sorted((r.key, r.impl) for r in rows if r.scan_error is None) == [("call", "g.h"), ("job", "mod.run"), ("two", "f")] and sum(r.scan_error is not None for r in rows) == 1
    assert [(r.group, r.id) for r in workspace.identifiers(f).filter("path = 'i.xml'").collect()] == [("b/@name", "one")]
    assert sorted(r.literal for r in workspace.literals(frame(spark, [("q.ts", "a('one/two'); b(\"xyz\"); c(`t-1`); d('no no'); e('ab')")])).collect()) == ["one/two", "t-1", "xyz"]
    s = spark.createDataFrame([('<JobSchedule Interval="60" />',), ("x",), (None,)], "s string")
    assert [r[0] for r in s.select(workspace.schedule_seconds(F.col("s"))).collect()] == [60, None, None]


def test_index_store(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "type", "A", "", "f"), ("b", "type", "B", "", "f")], "key string, kind string, name string, owner string, file string")
    edges = spark.createDataFrame([("calls", "a", "b", "x")], "kind string, source string, target string, via string")
    folder = str(tmp_path / "index")
    with pytest.raises(store.IndexError_):
        store.read_index(spark, folder, "nodes")
    store.write_index(folder, nodes, edges)
    store.write_index(folder, nodes.limit(1), edges)
    assert store.read_index(spark, folder, "nodes").count() == 1
    assert store.generation(nodes, edges).first() == store.generation(nodes.orderBy(F.desc("key")), edges).first() != store.generation(nodes.limit(1), edges).first()


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    for raw, want in (("https://h/API/x/{id?}?q=1#z", "api/x/{}"), ("/a//b/:id/${this.x}/", "a/b/{}/{}"), ("{id?}/b", "{}/b"), ("http://h", "")):
        assert value(routes.normalize_route(F.lit(raw))) == want
    assert value(routes.normalize_route(F.lit("/pm/Load/x"), routes.Rewrite("/PM", "api"))) == "api/load/x"
    assert value(routes.normalize_route(F.lit("/pmload/x"), routes.Rewrite("/pm"))) == "pmload/x"
    a, b = (routes.route_key(F.lit("get"), F.lit(r)) for r in ("x/{id}", "x"))
    assert value(routes.almost_equal(a, b)) and not value(routes.almost_equal(a, a))
    assert value(text.slug(F.lit("PricingHTTPServer<T>"))) == "pricing-http-server" and value(text.slug(F.lit("<T>"))) == "unnamed"
    assert value(text.generic_arity(F.lit("A<B<C, D>, (int, int)>"))) == 2 and value(text.strip_generics(F.lit("global::A<B<C>>.D<E>"))) == "A.D"
    assert value(text.namespace_prefixes(F.lit("A.B"))) == ["A.B", "A", ""]
    assert value(text.relative_path(F.lit("a/b/c.md"), F.lit("a/d/e.md"))) == "../d/e.md" and value(text.relative_path(F.lit("c.md"), F.lit("d.md"))) == "d.md"
    assert value(text.normalize_text(F.lit("  Ёлка  Straße "))) == "елка strasse"
    assert [value(F.lit(p).rlike(paths.glob_regex(g))) for p, g in (("obj/x.cs", "**/obj/**"), ("a/obj/x.cs", "**/obj/**"), ("a/b.cs", "*.cs"), ("a.csx", "*.cs"))] == [True, True, True, False]
    assert [value(paths.in_scope(F.lit(p), ["src/a"])) for p in ("src/a", "src/a/b", "src/ab")] == [True, True, False]
    s = spark.createDataFrame([("public (int, int) Pair(ref Dictionary<string, int> map, int x = 1)",), ("public C([FromServices] IA a, IB b) : base(a)",)], "s string")
    assert [r.t for r in s.select(signatures.injected_parameter_types("s").alias("t")).collect()][1] == ["IA", "IB"]
    assert signatures.identity_types("(int, int) P(out Dictionary<string, int> m, int x = 1)") == ["Dictionary<string, int>", "int"]


def test_references_followed_files_and_checks(spark):
    p = spark.createDataFrame([("a/A.csproj", ["b/B.csproj", "x/C.csproj", "gone/D.csproj"]), ("b/B.csproj", []), ("c/C.csproj", [])], "path string, project_references array<string>")
    assert {r.reference: r.project for r in registries.resolve_references(p).collect()} == {"b/B.csproj": "b/B.csproj", "x/C.csproj": "c/C.csproj", "gone/D.csproj": None}
    f = frame(spark, [("i.xml", "<R><I K='w' P='F\\one.json'/><I K='v' P='no.json'/></R>"), ("base/F/one.json", '{"Id": "step"}')])
    items = registries.read_registry(f, registries.Spec("r", "flow", ("i.xml",), "./I", {"ref": "@K", "p": "@P"}))
    got = registries.follow(items, f, "p", "base", registries.Spec("r", "def", (), "", {"ref": "Id"}, "json")).collect()
    assert sorted((r.via_ref, r.ref, r.error) for r in got) == [("v", None, "no file base/no.json"), ("w", "step", None)]
    recs = spark.createDataFrame([("seam", "s", {"seam_kind": "q"}), ("odd", "o", {}), ("data", "d", {"data_kind": "t"}), ("data", "d", {"data_kind": "t"})], "kind string, key string, fields map<string,string>")
    assert sorted((r.finding, r.key) for r in registries.check_records(recs).collect()) == [("no literal", "s"), ("repeated key", "d"), ("unknown kind", "o")]


def test_handlers_sends_tables_and_templates(spark):
    from estatelens.operators import symbols

    code = "namespace N; class H : IRequestHandler<Q<int>, R> { void X() { bus.Send(new Q<int>(1)); new Other(); b.ToTable(\"Orders\", \"dbo\"); db.Query(\"SELECT 1 FROM T\"); } } class Q<T> { }"
    parsed = csharp.parse_files(frame(spark, [("a.cs", code)]))
    s = symbols.build_symbols(parsed, spark.createDataFrame([("a.cs", "M")], "path string, module string"))
    handlers = symbols.dispatch_handlers(s, ["IRequestHandler"])
    assert [(r.handler, r.request) for r in handlers.collect()] == [("type:M#N.H", "Q<int>")]
    assert [(r.member, r.request) for r in symbols.dispatch_sends(parsed, handlers).collect()] == [("X", "Q")]
    assert [(r.entity, r.name) for r in symbols.table_literals(parsed).collect()] == [("H", "orders")] and [r.reads for r in symbols.sql_usages(parsed, ["Query"]).collect()] == [["t"]]
    t = spark.createDataFrame([("x.html", "C", "<p *ngIf=\"ok\">{{ name | upper }}</p><a (click)=\"go(item.id)\" [x]=\"'no'\">{{other}}</a>")], "path string, type string, text string")
    m = spark.createDataFrame([("C", n) for n in ("ok", "name", "go", "no", "id")], "type string, member string")
    assert sorted(r.member for r in documents.template_accesses(t, m).collect()) == ["go", "name", "ok"]


def test_zone_changes(spark):
    zone = lambda n, b: f"<!-- managed:section:start {n} -->\n{b}\n<!-- managed:section:end {n} -->\n"
    a, b = (documents.parse_documents(frame(spark, [("d.md", t)])) for t in (zone("x", "1") + zone("y", "1"), zone("x", "2") + zone("z", "1")))
    assert sorted((r.name, r.change) for r in documents.zone_diff(a, b).collect()) == [("x", "changed"), ("y", "removed"), ("z", "added")]
    d = documents.unified_diff(spark.createDataFrame([("a\nb\n", "a\nc\n"), ("s", "s")], "before string, after string")).collect()
    assert "-b\n+c\n" in d[0]["diff"] and d[1]["diff"] == ""


def test_a_failing_scanner_harms_its_own_file_alone(spark):
    from pyspark.sql.types import StructType

    def scanner(path, _):
        if path == "b":
            raise RuntimeError("no")
        return {"n": path}

    rows = files.scan(frame(spark, [("a", "x"), ("b", "x"), ("c", "x")]), StructType().add("n", "string"), scanner).collect()
    assert sorted((r.path, r.n, r.scan_error) for r in rows) == [("a", "a", None), ("b", None, "RuntimeError: no"), ("c", "c", None)]


def test_discover_by_uri(spark, tmp_path):
    for name in ("src/b.cs", "src/a/src/b.cs"):
        p = tmp_path / "dx" / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("class A {}")
    for root in (f"file://{tmp_path}/dx/src", f"{tmp_path}/dx/src/", f"file:{tmp_path}/dx/src"):
        assert sorted(r.path for r in files.discover(spark, root).collect()) == ["src/a/src/b.cs", "src/b.cs"]


def test_limits_of_a_file_are_counted(spark):
    body = " ".join(f'"lit{i}"' for i in range(3100))
    f = frame(spark, [("a.cs", body)])
    cut = workspace.literals(f).select("cut").distinct().collect()
    assert [r.cut for r in cut] == [100] and workspace.literals(f).count() == 3000 and workspace.literals(f, most=None).count() == 3100
    x = frame(spark, [("a.xml", "<r>" + "".join(f"<i id='id{i}'/>" for i in range(5010)) + "</r>")])
    assert workspace.identifiers(x).first().cut == 10 and workspace.identifiers(x, most=None).count() == 5010


def test_index_survives_a_failed_write(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "type", "A", "", "f")], "key string, kind string, name string, owner string, file string")
    edges = spark.createDataFrame([], "kind string, source string, target string, via string")
    folder = str(tmp_path / "index")
    store.write_index(folder, nodes, edges)
    (tmp_path / "index" / "pointer=2").mkdir()  # begun, never finished
    assert store.read_index(spark, folder, "nodes").count() == 1
