"""Operators on hand-made graphs, rule sets and snapshots."""

import pytest
from pyspark.sql import functions as F

from estatelens.operators import binding, business, graph, links, plan, questions, recon, rules, search, seams, snapshots, web
from estatelens.operators.rules import Rule
from estatelens.streaming import manifest

EDGE = "src string, dst string"


def edges(spark, text):
    return spark.createDataFrame([tuple(e.split(">")) for e in text.split()], EDGE)


def pairs(df):
    return sorted((r.root, r.node) for r in df.collect())


def roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


def test_reach_cycle_diamond_and_unknown_root(spark):
    got = graph.reach_pairs(edges(spark, "a>b b>c c>a a>d d>e b>e x>y"), roots(spark, "a", "zz"))
    assert pairs(got) == [("a", n) for n in "abcde"] + [("zz", "zz")]
    assert {r.node: r.depth for r in got.filter("root = 'a'").collect()} == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2}
    both = graph.reach_pairs(edges(spark, "p>q q>p q>r"), roots(spark, "p", "q"))
    assert pairs(both) == [("p", "p"), ("p", "q"), ("p", "r"), ("q", "p"), ("q", "q"), ("q", "r")]
    assert {r.node: r.fanout for r in graph.fanout(both).collect()} == {"p": 2, "q": 2, "r": 2}
    assert [r.node for r in graph.shared_nodes(both, 1).collect()] == ["p", "q", "r"]


def test_adjacency(spark):
    nodes = spark.createDataFrame([("e", "entry_point", ""), ("T", "type", ""), ("T.m", "member", "T"), ("U", "type", ""), ("U.n", "member", "U"), ("I", "type", "")], "key string, kind string, owner string")
    es = spark.createDataFrame([("dispatches", "e", "T"), ("calls", "T.m", "U.n"), ("binds", "I", "T"), ("inherits", "T", "I"), ("calls", "U.n", "gone")], "kind string, source string, target string")
    assert sorted((r.src, r.dst) for r in graph.adjacency(nodes, es).collect()) == [("T", "T.m"), ("T.m", "T"), ("T.m", "U.n"), ("U.n", "U"), ("e", "T")]


def test_paths(spark):
    e = edges(spark, "a>b a>c b>d c>d d>e " + " ".join(f"n{i:02}>n{i + 1:02}" for i in range(14)))
    path = lambda *a: [r.node for r in graph.shortest_path(e, *a).orderBy("step").collect()]
    assert path("a", "e") == ["a", "b", "d", "e"] and path("a", "a") == ["a"] and path("e", "a") == [] and path("n00", "n13") == [] and len(path("n00", "n12")) == 13


def test_strong_components(spark):
    got = {r.node: r.component for r in graph.strongly_connected(edges(spark, "a>b b>a b>c c>d d>e e>c f>a g>g")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "f": "f", "g": "g"}


def test_pagerank_sums_to_one(spark):
    e = edges(spark, "a>b b>c c>a a>c d>c")
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "node string")
    got = {r.node: r["rank"] for r in graph.pagerank(nodes, e).collect()}
    want = {n: 0.2 for n in "abcde"}
    out = {"a": "bc", "b": "c", "c": "a", "d": "c", "e": ""}
    for _ in range(20):
        lost = sum(want[n] for n in out if not out[n])
        want = {n: 0.15 / 5 + 0.85 * (sum(want[m] / len(out[m]) for m in out if n in out[m]) + lost / 5) for n in out}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1)


def test_affects_and_ownership(spark):
    p = graph.reach_pairs(edges(spark, "r1>a r2>a r3>a r1>b r2>c"), roots(spark, "r1", "r2", "r3"))
    changed = spark.createDataFrame([("a",), ("b",)], "node string")
    assert [r.root for r in graph.affects(p, changed, threshold=2).collect()] == ["r1"]
    assert sorted((r.node, r.root) for r in graph.owned_by_one(p).collect()) == [("b", "r1"), ("c", "r2")]
    closed = graph.base_type_closure(spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "ext")], "fqn string, base string"))
    assert sorted((r.fqn, r.base) for r in closed.collect()) == [("A", "B"), ("A", "ext"), ("B", "A"), ("B", "ext")]


PREDICATES = rules.symbol_predicates()


def symbols(spark):
    schema = "name string, type_kind string, namespace string, fqn string, modifiers array<string>, attributes array<string>, base_types array<string>, base_type_closure array<string>, paths array<string>, member_attributes array<string>, kind string, domain string, module string"
    row = lambda n, kind, ns, mods, bases, path: (n, kind, ns, f"{ns}.{n}", mods, [], bases, bases, [path], [], "", "d", "M")
    return spark.createDataFrame([row("PayController", "class", "App.Web", ["public"], ["Base<int>"], "src/Web/P.cs"), row("PayDto", "record", "App.WebX", ["public"], [], "src/D.cs"), row("Hidden", "class", "App", ["internal"], [], "obj/h.cs")], schema)


def test_rules(spark):
    df = symbols(spark)
    own = [Rule("b", 5, {"name_suffix": ["Controller"]}, "controller", "t"), Rule("a", 5, {"all": [{"base_type": ["Base"]}, {"type_kind": ["class"]}]}, "other"), Rule("ns", 1, {"namespace_prefix": ["App.Web"]}, "web")]
    gone = [Rule("g", 0, {"path_glob": ["**/obj/**"]}, "generated"), Rule("dto", 0, {"name_regex": [".*Dto"]}, "plain", unless={"namespace_prefix": ["App.WebX"]})]
    got = {r.name: r for r in rules.classify(df, gone, own, PREDICATES).collect()}
    assert (got["PayController"].state, got["PayController"].rule_id, got["PayController"].matched_rules) == ("classified", "a", ["a", "b", "ns"])
    assert (got["PayDto"].state, got["Hidden"].state, got["Hidden"].reason) == ("undecided", "excluded", "generated")
    assert rules.dead_rules(rules.winner(df, own, PREDICATES), own) == ["b", "ns"]
    ties = {r.name: (r.owner, r.tie) for r in rules.owners(df, own, PREDICATES).collect()}
    assert ties == {"PayController": ("other", True), "PayDto": (None, False), "Hidden": (None, False)}
    for bad in ([Rule("x", 1, {"nope": [1]})], [Rule("x", 1, {"name_regex": ["("]})], [Rule("x", 1, {})], [Rule("x", 1, {"kind": ["a"]}), Rule("x", 2, {"kind": ["b"]})]):
        with pytest.raises(rules.RuleError):
            rules.winner(df, bad, PREDICATES)


def test_resolution_and_links(spark):
    known = spark.createDataFrame([("A",), ("U1.B",), ("U2.B",)], "n string")
    wanted = spark.createDataFrame([(1, [(0, "A"), (1, "U1.B")]), (2, [(9, "U2.B"), (9, "U1.B")]), (3, [(0, "no")]), (4, [])], "id int, c array<struct<rank:int,name:string>>")
    got = {r.id: (r.resolved, r["rank"], r.ambiguous) for r in links.ranked_resolution(wanted, ["id"], F.col("c"), known, "n").collect()}
    assert (got[1], got[2], got[3][0], got[4][0]) == (("A", 0, False), ("U1.B", 9, True), None, None)
    owners = spark.createDataFrame([("", "root"), ("a/b", "deep")], "dir string, p string")
    files = spark.createDataFrame([("a/b/c/x.cs",), ("a/y.cs",)], "path string")
    assert {r.path: r.p for r in links.nearest_ancestor(files, "path", owners, "dir", "p").collect()} == {"a/b/c/x.cs": "deep", "a/y.cs": "root"}
    two = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, "z"), (4, "w")], "a int, b string")
    assert [tuple(r) for r in links.unique_both_ways(two, "a", "b").collect()] == [(4, "w")]


def test_unique_matches_by_several_keys(spark):
    import random

    rng, schema = random.Random(4), "{} string, f string, g string"
    for _ in range(4):
        a, b = ([(f"{n}{i}", rng.choice(["", *"pqrstu"]), rng.choice(["", *"vwxyzk"])) for i in range(7)] for n in "ab")
        found = {(x[0], y[0]) for x in a for y in b if x[1] and x[1] == y[1] or x[2] and x[2] == y[2]}
        want = {p for p in found if sum(q[0] == p[0] for q in found) == 1 == sum(q[1] == p[1] for q in found)}
        got = links.unique_matches(spark.createDataFrame(a, schema.format("a")), spark.createDataFrame(b, schema.format("b")), ["f", "g"], "a", "b")
        assert {tuple(r) for r in got.collect()} == want


def test_snapshots(spark):
    schema = "id int, kind string, doc_path string, signature_hash string"
    old = spark.createDataFrame([(1, "a", "p", "s"), (2, "a", "p", "s"), (3, "a", "p", "s"), (4, "a", "p", "s"), (5, "a", "p", "s")], schema)
    new = spark.createDataFrame([(1, "a", "p", "s"), (2, "b", "q", "t"), (3, "a", "q", "t"), (4, "a", "p", "t"), (6, "a", "p", "s")], schema)
    assert {r.id: r.change for r in snapshots.diff(old, new).collect()} == {2: "reclassified", 3: "moved", 4: "signature_changed", 5: "removed", 6: "added"}
    nodes = spark.createDataFrame([("x", "n1", "s", {"a": "1", "b": "1"})], "key string, name string, source string, attributes map<string,string>")
    more = spark.createDataFrame([("x", "n2", "r", {"b": "2"}), ("y", "n3", "r", None)], nodes.schema)
    assert {r.key: (r.name, r.source, r.attributes) for r in snapshots.overlay(nodes, more).collect()} == {"x": ("n2", "s+r", {"a": "1", "b": "2"}), "y": ("n3", "r", {})}
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_hash string")
    cache = spark.createDataFrame([("a", "1", "v1"), ("b", "1", "v1"), ("c", "3", "v1")], "path string, content_hash string, parser_version string")
    hit, pending = snapshots.cached_or_pending(files, cache, "v1")
    assert [r.path for r in hit.collect()] == ["a"] and [r.path for r in pending.collect()] == ["b"] and snapshots.cached_or_pending(files, cache, "v2")[1].count() == 2
    was = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "1"), ("d", "")], "path string, content_hash string")
    assert {r.path: r.status for r in snapshots.source_status(was, files.union(spark.createDataFrame([("d", "9")], files.schema))).collect()} == {"a": "current", "b": "stale", "c": "source_missing", "d": "no_hash"}


def test_plan(spark):
    nodes = spark.createDataFrame([("n1", "d/1", "k", "s", "i1", "f1", None), ("n2", "d/2", "k", "s", "i2", "f2", None), ("n3", "d/3", "k", "s", "i3", "f3", None), ("n4", "d/4", "k", "s", "i4", "f4", "n1"), ("n5", "d/5", "k", "s", "i5", "f5", None)], "id string, doc_path string, kind string, signature_hash string, impl_hash string, source_path string, absorbed_by string")
    docs = spark.createDataFrame(
        [("d/1", "n1", None, 0, True, "k", "s", "i1", "f1", "i1"), ("old/2", "n2", None, 0, True, "k", "s", "i2", "f2", "i2"), ("old/3", "gone", None, 0, True, "k", "s", "i3", "f3", "i3"), ("d/5", "n5", "cut", 0, True, "k", "s", "i5", "f5", "i5"), ("old/9", "n9", None, 0, True, "k", "s", "z", "z", "z")],
        "path string, node_id string, error string, empty_sections int, accepted boolean, accepted_kind string, accepted_signature string, accepted_impl string, source_path string, impl_hash string",
    )
    got = {r.doc_path: (r.file_action, r.status, r.relocate_from) for r in plan.build_plan(nodes, docs).collect()}
    assert got == {"d/1": ("unchanged", "current", None), "d/2": ("relocate", "relocated", "old/2"), "d/3": ("relocate", "relocated", "old/3"), "d/5": ("refuse", "broken", None), "old/9": ("keep", "orphan", None)}


def test_plan_links(spark):
    nodes = spark.createDataFrame([("a1", "A", "X"), ("a2", "B", "X"), ("i", "C", "Impl"), ("me", "A", "Me")], "id string, module string, fqn string")
    targets = spark.createDataFrame([("me", "A", "X"), ("i", "C", "X"), ("me", "A", "IFace")], "id string, module string, target string")
    refs = spark.createDataFrame([("C", "B")], "module string, referenced string")
    impl = spark.createDataFrame([("IFace", "i"), ("IFace", "me")], "target string, node string")
    assert sorted(tuple(r) for r in plan.resolve_links(targets, nodes, refs, impl).collect()) == [("i", "X", "a2", "direct"), ("me", "IFace", "i", "implementation"), ("me", "X", "a1", "direct")]


NODE = "key string, kind string, name string, owner string, file string, attributes map<string,string>"
LINK = "kind string, source string, target string, via string, confidence double"


def node_rows(spark):
    return spark.createDataFrame(
        [("svc", "entry_point", "Calc", "", "reg.xml", {"entry_kind": "grid_service"}), ("IC", "type", "ICalc", "", "a.cs", {"fqn": "N.ICalc"}), ("C", "type", "CalcImpl", "", "b.cs", {"fqn": "N.CalcImpl"}), ("IC.run", "member", "Run", "IC", "a.cs", {}), ("C.run", "member", "Run", "C", "b.cs", {}), ("U", "type", "User", "", "c.cs", {"fqn": "N.User"}), ("U.go", "member", "Go", "U", "c.cs", {})],
        NODE,
    )


def test_binding_and_seams(spark):
    nodes = node_rows(spark)
    es = spark.createDataFrame([("calls", "U.go", "IC.run", "", 1.0), ("inherits", "C", "IC", "", 1.0), ("dispatches", "svc", "C", "", 1.0)], LINK)
    reg = spark.createDataFrame([("p.cs", 1, "ICalc", "N.CalcImpl"), ("p.cs", 2, "User", "User"), ("p.cs", 3, "IGone", "CalcImpl"), ("p.cs", 4, "ICalc", None)], "file string, line int, service_type string, impl_type string")
    made, why = binding.binds(reg, nodes)
    assert [(r.source, r.target, r.confidence) for r in made.collect()] == [("IC", "C", 1.0)]
    assert {r.reason: r.n for r in why.collect()} == {"bound": 1, "self": 1, "unknown_service": 1, "no_implementation": 1}
    assert [(r.source, r.target, r.confidence) for r in binding.complete(nodes, es, made).collect()] == [("U.go", "C.run", 1.0)]
    assert [(r.source, r.target, r.via, r.confidence) for r in seams.service_seams(nodes, es).collect()] == [("U.go", "C.run", "Calc", 1.0)]
    entries = spark.createDataFrame([("e1", "N.CalcImpl"), ("e2", "X.User"), ("e3", "Nobody")], "entry string, impl string")
    assert {r.entry: (r.target, r.how) for r in binding.link_entries(entries, nodes).collect()} == {"e1": ("C", "full"), "e2": ("U", "simple"), "e3": (None, "unlinked")}
    recs = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "key string")
    kn = lambda *rows: spark.createDataFrame(list(rows), "key string, node string")
    made, sides = seams.declared_seams(recs, kn(("s1", "a"), ("s2", "b")), kn(("s1", "c"), ("s1", "a"), ("s2", "b")), kn(("s1", "z")))
    assert sorted((r.source, r.target) for r in made.collect()) == [("c", "s1"), ("s1", "a"), ("s2", "b")] and {r.key: r.status for r in sides.collect()} == {"s1": "both", "s2": "answering_only", "s3": "dangling"}


def test_questions(spark):
    nodes = node_rows(spark)
    es = spark.createDataFrame([("dispatches", "svc", "C", "", 1.0), ("calls", "C.run", "U.go", "", 1.0)], LINK)
    p = graph.reach_pairs(graph.adjacency(nodes, es), nodes.filter("kind = 'entry_point'").select(F.col("key").alias("root")))
    ix = questions.Index(nodes, es, p, search.entries(nodes), ("Program.cs",))
    a = ix.affects(["c.cs", "gone.cs"])
    assert [r["root"] for r in a.rows] == ["svc"] and a.notes["unknown"] == ["gone.cs"]
    assert ix.affects(["Program.cs"]).notes["why_empty"].startswith("composition root") and ix.affects(["IC"]).notes["why_empty"] == "nothing reaches these nodes"
    assert ix.affects(["U"], threshold=0).notes["shared"] == [{"node": "U", "fanout": 1}]
    assert {r["kind"]: r["total"] for r in ix.reaches("svc").rows} == {"member": 2, "type": 2} and ix.path("svc", "U").rows[-1]["node"] == "U" and ix.path("x", "U").notes == {"unresolved": ["x"]}
    assert ix.card("C").notes["fanout"] == 1 and ix.resolve("calcimpl").rows[0]["how"] == "exact" and ix.resolve("calcimpk").rows[0]["how"] == "trigram"


def test_web(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/lib/index.ts",), ("src/s/x.ts",)], "path string")
    imports = spark.createDataFrame([("src/a.ts", "./lib"), ("src/lib/index.ts", "../a"), ("src/a.ts", "@s/x"), ("src/a.ts", "rxjs")], "path string, source string")
    aliases = spark.createDataFrame([("@s/", "src/s")], "prefix string, target string")
    assert {(r.path, r.source): r.file for r in web.resolve_imports(imports, files, aliases).collect()} == {("src/a.ts", "./lib"): "src/lib/index.ts", ("src/lib/index.ts", "../a"): "src/a.ts", ("src/a.ts", "@s/x"): "src/s/x.ts", ("src/a.ts", "rxjs"): None}
    names = spark.createDataFrame([("f", "A"), ("g", "B")], "file string, name string")
    again = spark.createDataFrame([("i", "f"), ("i", "j"), ("j", "i"), ("j", "g")], "file string, target string")
    assert sorted((r.file, r.name, r.declared_in) for r in web.exported_names(names, again).collect()) == [("f", "A", "f"), ("g", "B", "g"), ("i", "A", "f"), ("i", "B", "g"), ("j", "A", "f"), ("j", "B", "g")]
    u = spark.createDataFrame([("T", "svc", "go", "m"), ("T", "log", "w", "m"), ("T", "no", "x", "m")], "type string, receiver string, method string, member string")
    b = spark.createDataFrame([("T", "svc", "S"), ("B1", "svc", "Z"), ("B1", "log", "L")], "type string, name string, target string")
    assert sorted((r.target, r.method) for r in web.usage_edges(u, b, spark.createDataFrame([("T", "B1")], "type string, base string")).collect()) == [("L", "w"), ("S", "go")]


def test_business(spark):
    anchors = spark.createDataFrame([("d1", "job", "a", True), ("d1", "page", "b", True), ("d2", "job", "c", False), ("d3", "job", "none", True)], "doc string, kind string, ref string, verify boolean")
    known = spark.createDataFrame([("registry", "job", "a", "t1"), ("symbol", "job", "a", "t9"), ("page", "page", "b", "p1"), ("page", "page", "b", "p2")], "rung string, kind string, ref string, target string")
    got = business.resolve_anchors(anchors, known)
    assert {(r.doc, r.ref): (r.state, r.targets) for r in got.collect()} == {("d1", "a"): ("resolved", ["t1"]), ("d1", "b"): ("ambiguous", ["p1", "p2"]), ("d2", "c"): ("unverified", []), ("d3", "none"): ("unresolved", [])}
    docs = spark.createDataFrame([("d1", True, 0, None), ("d2", True, 0, ""), ("d3", True, 1, None), ("d4", False, 0, None)], "doc string, readable boolean, empty_sections int, accepted_hash string")
    assert {r.doc: r.status for r in business.states(docs, got).collect()} == {"d1": "broken", "d2": "current", "d3": "empty", "d4": "broken"}
    assert [(r.target, r.docs) for r in business.backlinks(got).collect()] == [("t1", ["d1"])]
    assert [(r.check, r.subject) for r in business.lint(docs, got, spark.createDataFrame([("zz",)], "ref string")).collect()] == [("no_anchor", "d4"), ("unresolved", "d3:job:none"), ("ambiguous", "d1:page:b"), ("uncovered_root", "zz"), ("unreadable", "d4")]
    later = got.filter("doc <> 'd3'").withColumn("targets", F.when(F.col("ref") == "a", F.array(F.lit("t2"))).otherwise(F.col("targets")))
    assert sorted((r.doc, r.ref, r.change) for r in business.fact_changes(got, later).collect()) == [("d1", "a", "targets_changed"), ("d3", "none", "anchor_removed")]


def test_recon(spark):
    sets = spark.createDataFrame([("big", list("abcdefghij")), ("in", list("abcd")), ("own", list("abxyz"))], "g string, ids array<string>")
    assert sorted(r.g for r in recon.drop_overlapping(sets, "g", "ids").collect()) == ["big", "own"]
    h = spark.createDataFrame([("2024-01-01",), ("2024-06-01",), ("2024-06-20",)], "d string").withColumn("at", F.to_timestamp("d"))
    assert recon.recent(h, "at", 1).count() == 2


def test_streamed_snapshots(spark, tmp_path):
    schema = "id int, version int, deleted boolean, v string"
    for i, rows in enumerate(([(1, 1, False, "a"), (2, 1, False, "b")], [(1, 3, False, "c"), (2, 2, True, "b")], [(1, 2, False, "late")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        manifest.follow(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = manifest.current(spark, str(tmp_path / "out"), stream.schema)
    assert sorted(map(tuple, got.collect())) == [(1, 3, False, "c"), (2, 2, True, "b")]


def test_web_calls_overrides_and_absorption(spark):
    calls = spark.createDataFrame([("f", "m", "get", "/pm/x/{id}?a=1", None, "go", 1), ("f", "n", "post", "items?listInnerName=Users", None, "go", 2), ("f", "m", "get", None, "parameter", "go", 3)], "file string, module string, http_method string, url string, reason string, member string, line int")
    rewrites = spark.createDataFrame([("m", "/PM", "/api"), ("n", None, "api")], "module string, strip_prefix string, add_prefix string")
    keys, lost = web.build_calls(calls, rewrites, ["api/items"])
    assert sorted((r.http_method, r.route, r.discriminator) for r in keys.collect()) == [("GET", "api/x/{}", ""), ("POST", "api/items", "Users")] and [r.reason for r in lost.collect()] == ["parameter"]
    rt = lambda *rows: spark.createDataFrame(list(rows), "path string, component string")
    kept, findings = web.apply_overrides(rt(("a", "A"), ("b", "B"), ("b2", "B")), rt(("a", "A"), ("c", "C")), rt(("c", "C"), (None, "A"), (None, "B"), ("z", "Z")))
    assert sorted(map(tuple, kept.collect())) == [("b", "B"), ("b2", "B")] and sorted((r.finding, r.component) for r in findings.collect()) == [("ambiguous", "B"), ("missing", "Z"), ("redundant", "A")]
    nodes = spark.createDataFrame([("p", "page", "p.ts", "0"), ("q", "page", "q.ts", "0"), ("s", "service", "s.ts", "1"), ("t", "service", "t.ts", "2"), ("u", "service", "feat/u.ts", "3"), ("F", "feature", "", "0")], "id string, kind string, path string, impl_hash string")
    feats = spark.createDataFrame([("F", "feat")], "id string, folder string")
    got = {r.id: r.absorbed_by for r in web.absorb(nodes, edges(spark, "p>s s>t q>t p>u"), feats).collect()}
    assert got == {"p": None, "q": None, "s": "p", "t": None, "u": "F", "F": None}
    pages = spark.createDataFrame([("A",), ("X",)], "page string")
    ends = spark.createDataFrame([("A", "GET a"), ("A", "GET b")], "page string, endpoint string")
    assert {r.page: tuple(r)[1:] for r in web.page_report(pages, rt(("a", "A"), ("a/b", "B"), ("ab", "B")), ends).collect()} == {"A": (1, 1, 2, False), "X": (0, 0, 0, True)}


def test_more_recon_and_rules(spark):
    files = spark.createDataFrame([("a.cs",), ("b.cs",), ("c.cs",)], "path string")
    imports = spark.createDataFrame([("a.cs", "N"), ("a.cs", "System"), ("b.cs", "b.cs"), ("c.cs", "a.cs")], "path string, target string")
    spaces = spark.createDataFrame([("N", "b.cs"), ("N", "c.cs")], "namespace string, path string")
    made, counts = recon.import_graph(imports, files, spaces)
    assert sorted((r.src, r.dst) for r in made.collect()) == [("a.cs", "b.cs"), ("a.cs", "c.cs"), ("c.cs", "a.cs")] and {r.what: r.n for r in counts.collect()} == {"edges": 3, "external": 1, "too_wide": 0, "self": 1}
    assert recon.import_graph(imports, files, spaces, most=1)[1].filter("what = 'too_wide'").first().n == 1
    ch, pr = (spark.createDataFrame(x, "change string, root string") for x in ([("1", "a"), ("1", "b"), ("2", "c")], [("1", "a"), ("1", "z")]))
    assert {r.change: (r.obvious, r.found, r.missed) for r in recon.check_changes(ch, pr).collect()} == {"1": (2, 1, ["b"]), "2": (1, 0, ["c"])}
    found = {(r.check, r.subject): r.n for r in rules.lint_owners(symbols(spark), [Rule("r", 1, {"name_suffix": ["Dto"]}, "t1"), Rule("dead", 0, {"kind": ["x"]}, "t2")], ["t1", "t3"], PREDICATES).collect()}
    assert found == {("dead_rule", "dead"): 0, ("idle_team", "t3"): 0, ("orphans", "M"): 2}


def test_applied_plans(spark, tmp_path):
    (tmp_path / "old.md").write_text("x")
    p = spark.createDataFrame([("d/a.md", "create", "A", None), ("d/b.md", "relocate", "B", "old.md"), ("d/c.md", "unchanged", None, None)], "doc_path string, file_action string, content string, relocate_from string")
    assert plan.apply_plan(p, str(tmp_path)) == {"create": 1, "relocate": 1} and not (tmp_path / "d").exists()
    plan.apply_plan(p, str(tmp_path), dry_run=False)
    assert (tmp_path / "d/a.md").read_text() == "A" and (tmp_path / "d/b.md").read_text() == "B" and not (tmp_path / "old.md").exists()


def test_similar_names_compares_full_and_short_forms(spark):
    from estatelens.operators.search import similar_names

    names = spark.createDataFrame([("App.Services.Order",), ("zbcxdexfgxhi",), ("App.Other",), (None,)], "name string")
    wanted = spark.createDataFrame([("App.Services.Ordr",), ("bcdefghi",), ("Othr",)], "name string")
    got = {tuple(r) for r in similar_names(names, wanted).collect()}
    assert got == {("App.Services.Ordr", "App.Services.Order", 0.971), ("bcdefghi", "zbcxdexfgxhi", 0.8), ("Othr", "Other", 0.889)}
    whole = spark.createDataFrame([("Order",)], "name string")
    assert {tuple(r) for r in similar_names(names, whole, least=0.4).collect()} >= {("Order", "App.Services.Order", 0.435)}
    assert "Order" not in {r.name for r in similar_names(names, whole, least=0.4).collect()}


def test_chains_are_followed_to_their_end(spark):
    names = spark.createDataFrame([("f30", "N")], "file string, name string")
    chain = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(30)] + [("f5", "f0")], "file string, target string")
    assert web.exported_names(names, chain).count() == 31
    rows = [(f"t{i}", f"p{i}", None, f"t{i + 1}") for i in range(30)] + [("t30", "end", "C", None)]
    got = web.expand_routes(spark.createDataFrame(rows, "table string, path string, component string, spread string")).collect()
    assert [tuple(r) for r in got] == [("/".join([f"p{i}" for i in range(30)] + ["end"]), "C", False)]
    deep = spark.createDataFrame([("d/" * 20 + "a.ts", "../" * 20 + "lib/x")], "path string, source string")
    lib = spark.createDataFrame([("lib/x.ts",)], "path string")
    assert web.resolve_imports(deep, lib, spark.createDataFrame([], "prefix string, target string")).first().file == "lib/x.ts"


def test_long_chains_of_components(spark):
    e = edges(spark, " ".join(f"n{i:02}>n{i + 1:02}" for i in range(25)) + " x1>x2 x2>x3 x3>x1 x3>n00")
    got = {r.node: r.component for r in graph.strongly_connected(e).collect()}
    assert got == {f"n{i:02}": f"n{i:02}" for i in range(26)} | {f"x{i}": "x1" for i in (1, 2, 3)}


def test_streams_are_compacted(spark, tmp_path):
    schema = "id int, version int, deleted boolean, v string"
    for i in range(5):
        spark.createDataFrame([(i % 2, i, False, f"v{i}")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        manifest.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "mark"), compact=2).awaitTermination()
        got = manifest.current(spark, str(tmp_path / "out"), spark.read.parquet(str(tmp_path / "in")).schema)
        assert {r.id: r.version for r in got.collect()} == {k % 2: k for k in range(i + 1)}
    left = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert left == ["base=1", "base=3", "batch=2", "batch=3", "batch=4"]


def test_members_keep_their_keys_when_parameters_are_renamed(spark):
    from estatelens.operators import symbols as sym
    from estatelens.sources import csharp

    def keys(parameters):
        f = spark.createDataFrame([("a.cs", f"class C {{ void Go({parameters}) {{ }} }}", "h")], "path string, text string, content_hash string")
        nodes, _ = sym.symbol_graph(sym.build_symbols(csharp.parse_files(f), f.select("path", F.lit("M").alias("module"))))
        return [r.key for r in nodes.filter("kind = 'member'").collect()]

    assert keys("int a, string b = null") == keys("int x, string other") != keys("long a, string b")


API = """using App.Core; namespace App.Web;
[Route("api/orders")] public class OrdersController : ControllerBase { public OrdersController(IStore s) { }
  [HttpGet("{id}")] public int Get(int id) => 1; void Ask() { bus.Send(new Ping()); } }
class Startup { void Add(IServiceCollection s) { s.AddScoped<IStore, Store>(); s.AddScoped<IStore, FarStore>(); s.AddScoped<INone, Store>(); } }
public class PingHandler : IRequestHandler<Ping> { public void Handle(Ping p) { } }
public class Ping { }
"""
CORE = 'namespace App.Core; public interface IStore { void Load(); } public class Store : IStore { public void Load() { db.Query("SELECT * FROM Orders"); } }'
PROJECT = "<Project><ItemGroup>{}</ItemGroup></Project>"


def estate(spark, **changed):
    files_ = {
        "web/Web.csproj": PROJECT.format("<ProjectReference Include='..\\core\\Core.csproj'/>"), "core/Core.csproj": PROJECT.format(""), "far/Far.csproj": PROJECT.format(""),
        "web/Api.cs": API, "core/Store.cs": CORE, "far/Far.cs": "namespace App.Far; public class FarStore : App.Core.IStore { public void Load() { } }", "db/p.sql": "CREATE PROCEDURE P AS SELECT 1 FROM T",
    }
    rows = [(p, t) for p, t in (files_ | {k.replace("__", "/") + ".cs": v for k, v in changed.items()}).items()]
    return spark.createDataFrame(rows, "path string, text string").withColumn("content_hash", F.sha2("text", 256))


KINDS = [Rule("c", 5, {"name_suffix": ["Controller"]}, "controller"), Rule("s", 1, {"inherits": ["App.Core.IStore"]}, "store")]


def test_scan_and_build(spark):
    from estatelens.operators import run

    settings = {"kinds": KINDS, "excludes": [Rule("far", 0, {"path_glob": ["far/**"]}, "far")], "interfaces": ["IRequestHandler"], "sql_methods": ["Query"], "domains": [("shop", "W*")]}
    s = run.scan(estate(spark), **settings)
    assert {r.what: r.n for r in s.counters.collect()} == {"files": 3, "parse_errors": 0, "declarations": 7, "symbols": 7, "modules": 3, "nodes": 2, "state:classified": 2, "state:excluded": 1, "state:undecided": 4}
    nodes = {r.fqn: (r.state, r.kind, r.doc_path, r.domain) for r in s.nodes.collect()}
    assert nodes["App.Web.OrdersController"] == ("classified", "controller", "docs/modules/controller/Web/orders-controller.md", "shop") and nodes["App.Core.Store"][:2] == ("classified", "store") and nodes["App.Far.FarStore"][0] == "excluded"
    assert [(r.http_method, r.route) for r in s.endpoints.collect()] == [("GET", "api/orders/{}")] and [r.reads for r in s.sql_usages.collect()] == [["orders"]] and [r.name for r in s.sql_objects.collect()] == ["p"]
    ask = spark.createDataFrame([("web/Api.cs", "Get", "core/Store.cs", "Gone"), ("web/Api.cs", "Get", "web/Api.cs", "Ask")], "source_file string, source_name string, target_file string, target_name string")
    index, counts = run.build(s, ask)
    n = {(r.stage, r.what): r.n for r in counts.collect()}
    assert n["binds", "out_of_reach"] == 1 and n["binds", "unknown_service"] == 1 and n["binds", "bound"] == 2 and n["binds", "binds"] == 1 and n["calls", "calls"] == 1 and n["dispatch", "dispatches"] == 1 and n["entries", "dispatches"] == 1
    assert [r["root"] for r in index.affects(["web/Api.cs"]).rows] == ["entry:GET api/orders/{}"]
    assert {r["kind"]: r["total"] for r in index.reaches("entry:GET api/orders/{}").rows}["type"] == 2  # the controller, and the handler it sends to


def test_scoped_scan(spark):
    from estatelens.operators import run

    settings = {"kinds": KINDS, "sql_methods": ["Query"]}
    first = run.scan(estate(spark), **settings)
    changed = CORE.replace("Orders", "Lines").replace("class Store ", "class NewStore ")
    again = run.scan(estate(spark, core__Store=changed), scope=["core"], previous=first, cache=first.parsed, **settings)
    assert {r.fqn for r in again.nodes.collect()} == {r.fqn for r in first.nodes.collect()} - {"App.Core.Store"} | {"App.Core.NewStore"}
    assert [r.reads for r in again.sql_usages.collect()] == [["lines"]] and again.registrations.count() == first.registrations.count() == 3
    hit = run.scan(estate(spark), cache=first.parsed, **settings)
    assert sorted(hit.nodes.select("key", "impl_hash").collect()) == sorted(first.nodes.select("key", "impl_hash").collect())


WEB = {
    "app/src/shared/index.ts": "export * from './api.service';\n",
    "app/src/shared/api.service.ts": "import { HttpClient } from 'x';\n@Injectable()\nexport class ApiService {\n  constructor(private http: HttpClient) {}\n  load(id: string) { return this.http.get(`/pm/orders/${id}`); }\n  any(u: string) { return this.http.post(u); }\n}\n",
    "app/src/pages/orders.component.ts": "import { ApiService } from '@shared';\n@Component({ selector: 'o' })\nexport class OrdersComponent {\n  constructor(private readonly api: ApiService) {}\n  open() { return this.api.load('1'); }\n}\n",
    "app/src/routes.ts": "import { OrdersComponent } from './pages/orders.component';\nexport const routes: Routes = [{ path: 'orders', component: OrdersComponent }, { path: 'gone', component: Missing }];\n",
    "app/src/pages/orders.component.spec.ts": "export class Spec {}\n",
}


def test_scanned_web(spark):
    from estatelens.operators import run

    files_ = spark.createDataFrame(list(WEB.items()), "path string, text string").withColumn("content_hash", F.sha2("text", 256))
    one = lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)
    kinds = [Rule("c", 5, {"attribute": ["Component"]}, "component"), Rule("s", 5, {"attribute": ["Injectable"]}, "service")]
    w = run.scan_web(files_, one("module string, source_root string", ("app", "app/src")), kinds, aliases=one("prefix string, target string", ("@shared", "app/src/shared")), rewrites=one("module string, strip_prefix string, add_prefix string", ("app", "/pm", "api")))
    nodes = {r.name: (r.kind, r.n_routes, r.n_calls, r.absorbed_by) for r in w.nodes.collect()}
    page = "app/src/pages/orders.component#OrdersComponent"
    assert nodes == {"OrdersComponent": ("page", 1, 0, None), "ApiService": ("api_service", 0, 1, page)}
    assert [(r.fqn, r.http_method, r.route) for r in w.calls.collect()] == [("app/src/shared/api.service#ApiService", "GET", "api/orders/{}")] and w.unresolved.count() == 1
    assert [(r.src, r.dst, r.method) for r in w.uses.collect()] == [(page, "app/src/shared/api.service#ApiService", "load")]
    assert sorted((r.path, r.component, r.unresolved) for r in w.routes.collect()) == [("gone", "Missing", False), ("orders", page, False)]
