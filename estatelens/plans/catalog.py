"""The driver's queries: each operator applied to the synthetic tables, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, routes, text
from ..operators import graph, links, recon, rules, search, snapshots
from ..operators.rules import Rule
from ..sources.sqltext import sql_facts
from .tables import bounded_broadcast, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- scalar functions -------------------------------------------------------------------------------------------------

_ROUTE = r"""lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 CASE WHEN contains(trim(url), '://') THEN regexp_replace(trim(url), '^.*?://[^/]*', '') ELSE trim(url) END,
 '[?#].*$', ''), '\$?\{[^{}]*\}', '{}', 'g'), '(^|/):[^/]+', '\1{}', 'g'), '/{2,}', '/', 'g'), '^/|/$', '', 'g'))"""
_HOLED = f"regexp_replace({_ROUTE}, '[0-9]+', '{{}}', 'g')"
_FIXED = "array_to_string(list_filter(string_split({x}, '/'), lambda p: p <> '' AND p <> '{{}}'), '/')"


@query(f"SELECT {_ROUTE} AS route, count(*) AS n FROM pages GROUP BY 1")
def route_keys(spark, d):
    return table(spark, d, "pages").groupBy(routes.normalize_route(F.col("url")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS (SELECT DISTINCT regexp_replace({_ROUTE}, '(^|/)[0-9]+(/|$)', CASE WHEN page_id % 4 = 0 THEN '' ELSE '\\1{{}}\\2' END) AS route FROM pages),
k AS (SELECT route, {_FIXED.format(x='route')} AS fixed FROM r)
SELECT a.route AS a, b.route AS b FROM k a JOIN k b ON a.fixed = b.fixed WHERE a.route < b.route""")
def route_almost_pairs(spark, d):
    digits, route = r"(^|/)[0-9]+(/|$)", routes.normalize_route(F.col("url"))
    holed = F.when(F.col("page_id") % 4 == 0, F.regexp_replace(route, digits, "")).otherwise(F.regexp_replace(route, digits, r"$1\{}$2"))
    keys = table(spark, d, "pages").select(holed.alias("route")).distinct().withColumn("fixed", routes.fixed_segments(F.col("route")))
    return keys.select(F.col("route").alias("a"), "fixed").join(keys.select(F.col("route").alias("b"), "fixed"), "fixed").filter("a < b").select("a", "b")


@query("""SELECT doc_id, replace(lower(trim(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g'))), 'ß', 'ss') AS norm FROM documents""")
def text_norm(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query("SELECT 'sha256:' || sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_fingerprint(spark, d):
    hashed = table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


_NAMES = ("[dbo].[USER_TASKS]", '"Sales"."Orders"', "`a`. `B c`", "USER_TASKS", "x..y", "  [Weiß].[T]  ")


@query("""WITH v(raw) AS (VALUES ('[dbo].[USER_TASKS]'), ('"Sales"."Orders"'), ('`a`. `B c`'), ('USER_TASKS'), ('x..y'), ('  [Weiß].[T]  '))
SELECT raw, array_to_string(list_filter(list_transform(string_split(regexp_replace(raw, '[\\[\\]"`'']', '', 'g'), '.'), lambda p: replace(lower(trim(p)), 'ß', 'ss')), lambda p: p <> ''), '.') AS name FROM v""")
def data_name_norm(spark, d):
    return spark.createDataFrame([(n,) for n in _NAMES], "raw string").select("raw", text.normalize_data_name(F.col("raw")).alias("name"))


def _slug_sql(x: str) -> str:
    humps = f"regexp_replace(regexp_replace(regexp_replace({x}, '<.*$', ''), '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g'), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')"
    return f"coalesce(nullif(lower(regexp_replace(regexp_replace({humps}, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'unnamed')"


@query(f"""WITH v(name) AS (SELECT p_name FROM part UNION SELECT s_name FROM supplier UNION VALUES ('PricingHTTPServer'), ('Repository<T>'), ('<x>'))
SELECT name, {_slug_sql('name')} AS slug FROM v""")
def slug(spark, d):
    made = spark.createDataFrame([("PricingHTTPServer",), ("Repository<T>",), ("<x>",)], "name string")
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).union(table(spark, d, "supplier").select("s_name")).union(made).distinct()
    return names.select("name", text.slug(F.col("name")).alias("slug"))


@query("""SELECT turn, array_to_string(list_transform(string_split('Hello {{ role }}, turn {{turn}}; {{ other }}', '#'), lambda t: replace(replace(t, '{{ role }}', role), '{{turn}}', CAST(turn AS VARCHAR))), '') AS filled, count(*) AS n
FROM conversations GROUP BY 1, 2""")
def template_subst(spark, d):
    filled = text.substitute(F.lit("Hello {{ role }}, turn {{turn}}; {{ other }}"), {"role": F.col("role"), "turn": F.col("turn").cast("string")})
    return table(spark, d, "conversations").groupBy("turn", filled.alias("filled")).agg(F.count(F.lit(1)).alias("n"))


_SQL_TEXTS = (
    "SELECT * FROM dbo.Orders o JOIN [dbo].[Lines] l ON o.id = l.id",
    "INSERT INTO #tmp SELECT a FROM T1 -- FROM hidden\nUPDATE T2 SET a = 1",
    "/* EXEC old */ EXEC dbo.Refresh; DELETE FROM Log",
    "EXEC (@sql); MERGE INTO Target USING Src ON 1 = 1",
)
_NAME = r"[\[\]\w.\"`#@]+"


def _sql_names(keyword: str) -> str:
    found = f"list_transform(regexp_extract_all(body, '(?i)\\b(?:{keyword})\\s+({_NAME})', 1), lambda n: lower(regexp_replace(n, '[\\[\\]\"`'']', '', 'g')))"
    return f"list_sort(list_distinct(list_filter({found}, lambda n: NOT starts_with(n, '#') AND NOT starts_with(n, '@') AND n NOT IN ('select','values','set','where','as','on'))))"


@query(
    "WITH v(raw) AS (VALUES " + ", ".join("('" + t.replace("'", "''") + "')" for t in _SQL_TEXTS) + r"), s AS (SELECT raw, regexp_replace(regexp_replace(raw, '/\*(?s:.*?)\*/', ' ', 'g'), '--[^\n]*', ' ', 'g') AS body FROM v) "
    f"SELECT raw, array_to_string({_sql_names('FROM|JOIN|APPLY')}, ',') AS reads, array_to_string({_sql_names('INSERT' + chr(92) + 's+INTO|UPDATE|DELETE' + chr(92) + 's+FROM|MERGE' + chr(92) + 's+INTO|TRUNCATE' + chr(92) + 's+TABLE')}, ',') AS writes, "
    f"array_to_string({_sql_names('EXEC|EXECUTE|CALL')}, ',') AS calls, regexp_matches(body, '(?i)\\b(?:EXEC|EXECUTE)\\s*\\(|\\bsp_executesql\\b') AS dynamic FROM s"
)
def sql_facts_rows(spark, d):
    facts = spark.createDataFrame([(t,) for t in _SQL_TEXTS], "raw string").withColumn("f", sql_facts(F.col("raw")))
    return facts.select("raw", *(F.array_join(f"f.{c}", ",").alias(c) for c in ("reads", "writes", "calls")), F.col("f.dynamic").alias("dynamic"))


# --- rules ------------------------------------------------------------------------------------------------------------

_ORDER_TESTS = {
    "status": lambda v: F.col("o_orderstatus").isin(*v), "priority": lambda v: F.col("o_orderpriority").isin(*v), "over": lambda v: F.col("o_totalprice") > v[0],
    "segment": lambda v: F.col("c_mktsegment").isin(*v), "below": lambda v: F.col("c_acctbal") < v[0], "brand": lambda v: F.col("p_brand").isin(*v), "type": lambda v: F.col("p_type").isin(*v), "size_over": lambda v: F.col("p_size") > v[0],
}
_ORDER_RULES = (
    Rule("big", 10, {"over": [300000.0]}, "big"), Rule("urgent", 20, {"all": [{"priority": ["1-URGENT"]}, {"status": ["O", "P"]}]}, "urgent"),
    Rule("done", 5, {"status": ["F"]}, "done"), Rule("a_big", 10, {"over": [400000.0]}, "huge"),
)
_WINNER = """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus IN ('O','P') THEN 'urgent' WHEN o_totalprice > 400000 THEN 'a_big' WHEN o_totalprice > 300000 THEN 'big' WHEN o_orderstatus = 'F' THEN 'done' END AS rule_id,
concat_ws(',', CASE WHEN o_totalprice > 400000 THEN 'a_big' END, CASE WHEN o_totalprice > 300000 THEN 'big' END, CASE WHEN o_orderstatus = 'F' THEN 'done' END, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus IN ('O','P') THEN 'urgent' END) AS matched FROM orders"""


@query(_WINNER)
def rule_winner(spark, d):
    return rules.winner(table(spark, d, "orders"), _ORDER_RULES, _ORDER_TESTS).select("o_orderkey", "rule_id", F.array_join("matched_rules", ",").alias("matched"))


@query(f"SELECT coalesce(rule_id, 'undecided') AS decision, count(*) AS n FROM ({_WINNER}) GROUP BY 1")
def decision_stats(spark, d):
    decided = rules.winner(table(spark, d, "orders"), _ORDER_RULES, _ORDER_TESTS).withColumn("decision", F.coalesce("rule_id", F.lit("undecided")))
    return rules.decision_stats(decided, ["decision"])


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 AND NOT c_mktsegment = 'MACHINERY' THEN 'excluded' WHEN c_mktsegment = 'FURNITURE' THEN 'excluded' WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'classified' ELSE 'undecided' END AS state,
CASE WHEN c_acctbal < 0 AND NOT c_mktsegment = 'MACHINERY' THEN 'debt' WHEN c_mktsegment = 'FURNITURE' THEN 'closed line' END AS reason FROM customer""")
def rule_exclusion(spark, d):
    gone = (Rule("debt", 5, {"below": [0.0]}, "debt", unless={"segment": ["MACHINERY"]}), Rule("line", 1, {"segment": ["FURNITURE"]}, "closed line"))
    kept = (Rule("core", 1, {"segment": ["BUILDING", "MACHINERY"]}, "core"),)
    return rules.classify(table(spark, d, "customer"), gone, kept, _ORDER_TESTS).select("c_custkey", "state", "reason")


@query("""WITH m AS (SELECT p_partkey, p_brand = 'Brand#2' AS a, p_type = 'ECONOMY' AS b, p_size > 40 AS c FROM part)
SELECT p_partkey, CASE WHEN a THEN 'team-a' WHEN b THEN 'team-b' WHEN c THEN 'team-c' END AS owner, CASE WHEN a AND b THEN true WHEN a OR b OR c THEN false ELSE false END AS tie FROM m""")
def owner_ties(spark, d):
    own = (Rule("r1", 9, {"brand": ["Brand#2"]}, "team-a"), Rule("r2", 9, {"type": ["ECONOMY"]}, "team-b"), Rule("r3", 1, {"size_over": [40]}, "team-c"))
    return rules.owners(table(spark, d, "part"), own, _ORDER_TESTS).select("p_partkey", "owner", "tie")


@query("""(SELECT 'type' AS slice, p_type AS value, count(*) AS n FROM part GROUP BY 2 ORDER BY n DESC, value LIMIT 15) UNION ALL (SELECT 'brand', p_brand, count(*) AS n FROM part GROUP BY 2 ORDER BY n DESC, p_brand LIMIT 15)""")
def breakdown_top(spark, d):
    part = table(spark, d, "part")
    return rules.top_values(part, "p_type").select(F.lit("type").alias("slice"), "value", "n").union(rules.top_values(part, "p_brand").select(F.lit("brand"), "value", "n"))


# --- snapshots, freshness and the queue -------------------------------------------------------------------------------

_STATE = """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 13 = 0 THEN 'empty' WHEN o_orderkey % 7 <> 0 AND o_totalprice > 400000 THEN 'stale' WHEN o_orderkey % 7 = 0 THEN 'undeclared' WHEN o_orderkey % 17 = 0 THEN 'relocated'
WHEN o_orderstatus = 'P' THEN 'drifted' WHEN o_orderpriority = '5-LOW' THEN 'drifted' ELSE 'current' END AS status FROM orders"""


def _freshness(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    nodes = o.select(k.alias("id"), F.col("o_orderstatus").alias("kind"), F.sha2(F.col("o_totalprice").cast("string"), 256).alias("signature_hash"), F.md5("o_orderpriority").alias("impl_hash"))
    docs = o.filter(k % 11 != 0).select(
        k.alias("id"), (k % 13 == 0).cast("int").alias("empty_sections"), (k % 7 != 0).alias("accepted"), F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")).alias("accepted_kind"),
        F.when(F.col("o_totalprice") > 400000, "old").otherwise(F.sha2(F.col("o_totalprice").cast("string"), 256)).alias("accepted_signature"), F.when(F.col("o_orderpriority") == "5-LOW", "old").otherwise(F.md5("o_orderpriority")).alias("accepted_impl"),
        (k % 17 == 0).alias("relocated"),
    )
    return snapshots.freshness(nodes, docs)


@query(f"SELECT o_orderkey AS id, status, CASE WHEN status IN ('missing','empty','stale') THEN 'write' WHEN status = 'current' THEN 'skip' ELSE 'review' END AS agent_action FROM ({_STATE})")
def decide_state(spark, d):
    return _freshness(spark, d)


@query(f"""WITH p AS ({_STATE}), r AS (SELECT 'docs/' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS doc_path, status FROM p WHERE status <> 'current')
SELECT doc_path, status, true AS truncated FROM r ORDER BY list_position(['broken','missing','stale','drifted','undeclared','empty','relocated','orphan','current'], status), doc_path LIMIT 100""")
def worklist_topk(spark, d):
    plan = _freshness(spark, d).withColumn("doc_path", F.concat(F.lit("docs/"), F.lpad(F.col("id").cast("string"), 9, "0")))
    queue, cut = snapshots.worklist(plan, limit=100)
    return queue.select("doc_path", "status", F.lit(cut).alias("truncated"))


def _order_snapshots(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    old = o.filter(k % 10 != 3).select(k.alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("doc_path"), F.col("o_totalprice").alias("signature_hash"))
    new = o.filter(k % 10 != 4).select(
        k.alias("id"), F.when(k % 6 == 0, "P").otherwise(F.col("o_orderstatus")).alias("kind"), F.when(k % 8 == 0, "3-MEDIUM").otherwise(F.col("o_orderpriority")).alias("doc_path"), F.when(k % 9 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("signature_hash")
    )
    return old, new


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS k, o_orderpriority AS p, o_totalprice AS s FROM orders WHERE o_orderkey % 10 <> 3),
b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'P' ELSE o_orderstatus END AS k, CASE WHEN o_orderkey % 8 = 0 THEN '3-MEDIUM' ELSE o_orderpriority END AS p, CASE WHEN o_orderkey % 9 = 0 THEN 0.0 ELSE o_totalprice END AS s FROM orders WHERE o_orderkey % 10 <> 4),
j AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.k <> b.k THEN 'reclassified' WHEN a.p <> b.p THEN 'moved' WHEN a.s <> b.s THEN 'signature_changed' END AS change, a.k AS ak, b.k AS bk, a.p AS ap, b.p AS bp FROM a FULL JOIN b ON a.id = b.id)
SELECT id, change, CASE change WHEN 'reclassified' THEN ak WHEN 'moved' THEN ap END AS was, CASE change WHEN 'reclassified' THEN bk WHEN 'moved' THEN bp END AS now FROM j WHERE change IS NOT NULL""")
def snapshot_diff(spark, d):
    return snapshots.diff(*_order_snapshots(spark, d))


@query("""WITH p AS (SELECT o_orderkey AS id, o_orderpriority AS area, o_totalprice AS v FROM orders), n AS (SELECT o_orderkey AS id, o_orderpriority AS area, o_totalprice + 1 AS v FROM orders WHERE starts_with(o_orderpriority, '1-') AND o_orderkey % 2 = 0)
SELECT id, area, round(v, 2) AS v FROM n UNION ALL SELECT id, area, round(v, 2) FROM p WHERE NOT starts_with(area, '1-') AND id NOT IN (SELECT id FROM n)""")
def scoped_merge(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("area"), F.col("o_totalprice").alias("v"))
    part = old.filter(F.col("area").startswith("1-") & (F.col("id") % 2 == 0)).withColumn("v", F.col("v") + 1)
    return snapshots.merge_scoped(old, part, F.col("area").startswith("1-")).withColumn("v", F.round("v", 2))


@query("""SELECT event_type, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT event_type, value AS v FROM events WHERE user_id >= 50 UNION ALL SELECT event_type, value * 2 FROM events WHERE user_id < 50) GROUP BY 1""")
def fact_merge_scope(spark, d):
    old = table(spark, d, "events").select("event_type", "user_id", "value")
    merged = snapshots.merge_facts(old, old.withColumn("value", F.col("value") * 2), F.col("user_id") < 50)
    return merged.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH u AS (SELECT 0 AS r, c_custkey % 500 AS k, c_custkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 1, c_custkey % 500, c_custkey FROM customer),
v AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r, c_custkey) AS n, min(r) OVER (PARTITION BY k) AS f FROM u)
SELECT k, c_custkey, r AS source_rank, CASE WHEN n = 1 THEN 'kept' WHEN r > f THEN 'shadowed' ELSE 'duplicate' END AS verdict FROM v""")
def upsert_first_wins(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") % 500).alias("k"), "c_custkey")
    return snapshots.first_wins([c.filter("c_custkey % 3 = 0"), c], ["k"], ["c_custkey"])


@query("""WITH a AS (SELECT doc_id AS a, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS b, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1),
p AS (SELECT DISTINCT a, b FROM a JOIN b USING (h)), c AS (SELECT a, b, count(*) OVER (PARTITION BY a) AS x, count(*) OVER (PARTITION BY b) AS y FROM p) SELECT a, b FROM c WHERE x = 1 AND y = 1""")
def relocation_match(spark, d):
    h = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    sides = (h.filter(F.col("doc_id") % 2 == i).withColumnRenamed("doc_id", n) for i, n in enumerate("ab"))
    return links.unique_matches(*sides, ["h"], "a", "b")


# --- resolving joins --------------------------------------------------------------------------------------------------


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 AND n_regionkey < 3 THEN r_name END AS resolved, CASE WHEN n_nationkey % 3 = 0 THEN 0 WHEN n_nationkey % 3 = 1 AND n_regionkey < 3 THEN 1 END AS rank, false AS ambiguous
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def ranked_resolution(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    known = nation.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("name")).union(region.filter("r_regionkey < 3").select("r_name"))
    third = F.when(F.col("n_nationkey") % 3 == 2, "unknown").otherwise(F.col("r_name"))
    wanted = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("id"), F.array(F.struct(F.lit(0).alias("rank"), F.col("n_name").alias("name")), F.struct(F.lit(1).alias("rank"), third.alias("name"))).alias("c"))
    out = links.ranked_resolution(wanted, ["id"], F.col("c"), known, "name")
    return out.withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


@query("""SELECT p_partkey, p_name, s_suppkey, round_even(1.0 / count(*) OVER (PARTITION BY p_partkey), 3) AS weight FROM part JOIN supplier ON p_size = s_nationkey""")
def weighted_link(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").alias("k"))
    return links.weighted_links(part, table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")), ["k"], ["p_partkey"]).drop("k")


@query("""WITH r AS (SELECT user_id AS g, event_type AS name, min(ts) AS s, max(ts) AS e FROM events GROUP BY 1, 2), j AS (SELECT event_id, name, epoch_us(e) - epoch_us(s) AS w FROM events JOIN r ON user_id = g AND ts BETWEEN s AND e)
SELECT event_id, arg_min(name, (w, name)) AS name FROM (SELECT event_id, name, w FROM j) GROUP BY 1""")
def interval_owner(spark, d):
    e = table(spark, d, "events")
    ranges = e.groupBy("user_id", F.col("event_type").alias("name")).agg(F.min("ts").alias("s"), F.max("ts").alias("e"))
    return links.narrowest_interval(e.select("event_id", "user_id", "ts"), ranges, ["user_id"], "ts", "s", "e", "name", ["event_id"])


@query(f"""WITH x AS (SELECT page_id, url, {_ROUTE} AS route FROM pages), p AS (SELECT DISTINCT string_split(route, '/')[1] AS prefix FROM x UNION SELECT route FROM x WHERE starts_with(url, 'https'))
SELECT page_id, arg_max(prefix, length(prefix)) AS prefix FROM x JOIN p ON route = prefix OR starts_with(route, prefix || '/') GROUP BY 1""")
def longest_prefix(spark, d):
    x = table(spark, d, "pages").select("page_id", "url", routes.normalize_route(F.col("url")).alias("route"))
    prefixes = x.select(F.split_part("route", F.lit("/"), F.lit(1)).alias("prefix")).union(x.filter("url like 'https%'").select("route")).distinct()
    return links.longest_prefix(x, "route", prefixes, "prefix").select("page_id", "prefix")


_LINK = f"""WITH x AS (SELECT page_id, {_ROUTE} AS r0 FROM pages), y AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(r0, '[0-9]+', '{{}}', 'g') ELSE r0 END AS route FROM x),
z AS (SELECT page_id, route, array_to_string(list_filter(string_split(regexp_replace(route, '[0-9]+', '{{}}', 'g'), '/'), lambda p: p <> '' AND p <> '{{}}'), '/') AS fixed FROM y),
c AS (SELECT * FROM z WHERE page_id % 2 = 0), e AS (SELECT * FROM z WHERE page_id % 2 = 1)"""


def _link_sides(spark, d):
    route = routes.normalize_route(F.col("url"))
    x = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.regexp_replace(route, "[0-9]+", r"\{}")).otherwise(route).alias("route"))
    x = x.withColumn("fixed", routes.fixed_segments(F.regexp_replace("route", "[0-9]+", r"\{}")))
    return x.filter("page_id % 2 = 0"), x.filter("page_id % 2 = 1")


@query(f"""{_LINK}, a AS (SELECT route, min(page_id) AS m FROM e GROUP BY 1), b AS (SELECT fixed, min(page_id) AS m FROM e GROUP BY 1)
SELECT c.page_id AS call, CASE WHEN a.m IS NOT NULL THEN 'exact' WHEN b.m IS NOT NULL THEN 'almost' ELSE 'orphan' END AS status, coalesce(a.m, b.m) AS endpoint FROM c LEFT JOIN a USING (route) LEFT JOIN b ON c.fixed = b.fixed""")
def link_exact_almost(spark, d):
    calls, ends = _link_sides(spark, d)
    return links.exact_almost_links(calls.withColumnRenamed("page_id", "call"), ends.withColumnRenamed("page_id", "endpoint"), ["route"], ["fixed"], "call", "endpoint")


@query(f"""{_LINK} SELECT 'orphan call' AS finding, route, count(*) AS n FROM c WHERE route NOT IN (SELECT route FROM e) GROUP BY 2 UNION ALL SELECT 'uncalled endpoint', route, count(*) FROM e WHERE route NOT IN (SELECT route FROM c) GROUP BY 2
UNION ALL SELECT 'duplicate key', route, count(*) FROM e GROUP BY 2 HAVING count(*) > 1""")
def link_orphans(spark, d):
    calls, ends = _link_sides(spark, d)
    count = lambda df, what: df.groupBy("route").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("finding"), "route", "n")
    return count(calls.join(ends, "route", "left_anti"), "orphan call").union(count(ends.join(calls, "route", "left_anti"), "uncalled endpoint")).union(links.duplicate_keys(ends, ["route"]).select(F.lit("duplicate key"), "route", "n"))


@query("""SELECT lang, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS uncovered FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1""")
def coverage_join(spark, d):
    return links.coverage(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"], "lang")


@query("SELECT source, lang, n_chars % 100 AS k, count(*) AS n FROM documents GROUP BY 1, 2, 3 HAVING count(*) > 1")
def validate_dups(spark, d):
    return links.duplicate_keys(table(spark, d, "documents").select("source", "lang", (F.col("n_chars") % 100).alias("k")), ["source", "lang", "k"])


# --- graph ------------------------------------------------------------------------------------------------------------


def _fk_edges(spark, d):
    t = lambda n: table(spark, d, n)
    e = lambda a, x, b, y: (F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    return t("nation").select(*e("r", "n_regionkey", "n", "n_nationkey")).union(t("customer").select(*e("n", "c_nationkey", "c", "c_custkey"))).union(t("orders").select(*e("c", "o_custkey", "o", "o_orderkey")))


def _regions(spark, d):
    return table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))


_FK = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
p AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT p.root, e.dst, p.depth + 1 FROM p JOIN e ON p.node = e.src)"""


@query(f"WITH RECURSIVE {_FK} SELECT root, depth, count(*) AS nodes FROM p GROUP BY 1, 2")
def reach_pairs(spark, d):
    return graph.reach_pairs(_fk_edges(spark, d), _regions(spark, d)).groupBy("root", "depth").agg(F.count(F.lit(1)).alias("nodes"))


@query("""WITH RECURSIVE s AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, user_id FROM events), e AS (SELECT DISTINCT src, dst FROM s WHERE dst IS NOT NULL),
p AS (SELECT src AS root, src AS node FROM e UNION SELECT p.root, e.dst FROM p JOIN e ON p.node = e.src) SELECT DISTINCT root, node FROM p""")
def reach_cyclic(spark, d):
    edges = _transitions(spark, d).select("src", "dst").distinct()
    return graph.reach_pairs(edges, edges.select(F.col("src").alias("root")).distinct()).select("root", "node")


def _transitions(spark, d):
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.col("event_type").alias("src"), after.alias("dst")).filter("dst is not null")


@query("SELECT l_partkey AS node, count(DISTINCT l_suppkey) AS fanout FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 25")
def fanout_shared(spark, d):
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.col("l_partkey").cast("string").alias("dst")).distinct()
    pairs = graph.reach_pairs(edges, edges.select(F.col("src").alias("root")).distinct(), max_depth=1).filter("depth > 0")
    return graph.shared_nodes(pairs, 25).select(F.col("node").cast("long").alias("node"), "fanout")


@query(f"WITH RECURSIVE {_FK} SELECT DISTINCT root FROM p WHERE node IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders))")
def affects(spark, d):
    o = table(spark, d, "orders")
    changed = o.filter(F.col("o_orderdate") == o.agg(F.max("o_orderdate").alias("m")).scalar()).select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.affects(graph.reach_pairs(_fk_edges(spark, d), _regions(spark, d)), changed)


@query("""WITH RECURSIVE u AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), e AS (SELECT a AS src, b AS dst FROM u UNION SELECT b, a FROM u),
s AS (SELECT min(src) AS source, max(src) AS target FROM e), p AS (SELECT source AS node, 0 AS level FROM s UNION SELECT e.dst, p.level + 1 FROM p JOIN e ON p.node = e.src WHERE p.level < 12)
SELECT coalesce(min(level), -1) AS steps FROM p JOIN s ON p.node = s.target""")
def shortest_path(spark, d):
    u = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    edges = u.union(u.select("dst", "src")).distinct()
    ends = edges.agg(F.min("src").alias("a"), F.max("src").alias("b")).first()
    return graph.shortest_path(edges, ends.a, ends.b).agg(F.coalesce(F.max("step"), F.lit(-1)).alias("steps"))


@query("""WITH RECURSIVE s AS (SELECT event_type || '-' || user_id % 20 AS src, lead(event_type || '-' || user_id % 20) OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS dst FROM events),
e AS (SELECT src, dst FROM s WHERE dst IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 5), p AS (SELECT src AS root, src AS node FROM e UNION SELECT dst, dst FROM e UNION SELECT p.root, e.dst FROM p JOIN e ON p.node = e.src),
m AS (SELECT a.root AS node, min(a.node) AS component FROM p a JOIN p b ON a.root = b.node AND a.node = b.root GROUP BY 1) SELECT component, count(*) AS size FROM m GROUP BY 1""")
def scc_size(spark, d):
    name = F.concat_ws("-", "event_type", (F.col("user_id") % 20).cast("string"))
    after = F.lead(name).over(Window.partitionBy(F.col("user_id") % 40).orderBy("ts", "event_id"))
    edges = table(spark, d, "events").select(name.alias("src"), after.alias("dst")).filter("dst is not null").groupBy("src", "dst").count().filter("count > 5")
    return graph.strongly_connected(edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


_RANK_EDGES = "SELECT DISTINCT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst FROM supplier UNION SELECT DISTINCT 's' || l_suppkey, 'n' || (l_partkey % 25) FROM lineitem UNION SELECT 's' || s_suppkey, 'x' || (s_suppkey % 7) FROM supplier WHERE s_suppkey % 3 = 0"


def _rank_sql(rounds: int) -> str:
    parts = [f"WITH e AS MATERIALIZED ({_RANK_EDGES})", "v AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e)", "g AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY 1)", "l AS MATERIALIZED (SELECT e.src, e.dst, g.k FROM e JOIN g USING (src))", "c AS (SELECT count(*) AS n FROM v)", "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS rank FROM v, c)"]
    for i in range(rounds):
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT v.node, 0.15 / c.n + 0.85 * (coalesce(x.got, 0) + d.lost / c.n) AS rank FROM v CROSS JOIN c CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT src FROM g)) d "
            f"LEFT JOIN (SELECT l.dst, sum(r.rank / l.k) AS got FROM l JOIN r{i} r ON r.node = l.src GROUP BY 1) x ON x.dst = v.node)"
        )
    return ", ".join(parts) + f" SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@query(_rank_sql(20))
def pagerank20(spark, d):
    s = table(spark, d, "supplier")
    tag = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    edges = s.select(tag("n", F.col("s_nationkey")).alias("src"), tag("s", F.col("s_suppkey")).alias("dst"))
    edges = edges.union(table(spark, d, "lineitem").select(tag("s", F.col("l_suppkey")), tag("n", F.col("l_partkey") % 25)))
    edges = edges.union(s.filter("s_suppkey % 3 = 0").select(tag("s", F.col("s_suppkey")), tag("x", F.col("s_suppkey") % 7))).distinct()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return graph.pagerank(nodes, edges).select("node", F.round("rank", 6).alias("rank"))


@query("""SELECT o_orderkey AS node, c_mktsegment AS root FROM customer JOIN orders ON c_custkey = o_custkey UNION ALL SELECT -c_custkey - 1, c_mktsegment FROM customer""")
def absorb_unique(spark, d):
    c, tag = table(spark, d, "customer"), lambda n: n.cast("string")
    edges = c.select(F.concat(F.lit("seg:"), "c_mktsegment").alias("src"), tag(-F.col("c_custkey") - 1).alias("dst")).union(table(spark, d, "orders").select(tag(-F.col("o_custkey") - 1), tag(F.col("o_orderkey"))))
    pairs = graph.reach_pairs(edges, c.select(F.concat(F.lit("seg:"), "c_mktsegment").alias("root")))
    return graph.owned_by_one(pairs).select(F.col("node").cast("long").alias("node"), F.substring("root", 5, 100).alias("root"))


@query("""WITH RECURSIVE e AS (SELECT n_name AS fqn, r_name AS base FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, CASE WHEN r_regionkey < 2 THEN 'WEST' ELSE 'EAST' END FROM region UNION SELECT 'WEST', 'WORLD' UNION SELECT 'WORLD', 'WEST'),
p AS (SELECT fqn, base FROM e UNION SELECT p.fqn, e.base FROM p JOIN e ON p.base = e.fqn) SELECT fqn, base FROM p WHERE fqn <> base""")
def closure_types(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    direct = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("fqn"), F.col("r_name").alias("base"))
    direct = direct.union(r.select("r_name", F.when(F.col("r_regionkey") < 2, "WEST").otherwise("EAST"))).union(spark.createDataFrame([("WEST", "WORLD"), ("WORLD", "WEST")], "fqn string, base string"))
    return graph.base_type_closure(direct)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
p AS (SELECT 'c1' AS node, 0 AS level UNION SELECT 'c2', 0 UNION SELECT 'c4', 0 UNION SELECT e.dst, p.level + 1 FROM p JOIN e ON p.node = e.src WHERE p.level < 3) SELECT level, count(*) AS nodes FROM (SELECT node, min(level) AS level FROM p GROUP BY 1) GROUP BY 1""")
def bounded_bfs(spark, d):
    l, tag = table(spark, d, "lineitem"), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))  # noqa: E741
    edges = table(spark, d, "orders").select(tag("c", "o_custkey").alias("src"), tag("o", "o_orderkey").alias("dst")).union(l.select(tag("o", "l_orderkey"), tag("p", "l_partkey"))).union(l.select(tag("p", "l_partkey"), tag("s", "l_suppkey")))
    edges = edges.union(table(spark, d, "supplier").select(tag("s", "s_suppkey"), tag("n", "s_nationkey")))
    start = spark.createDataFrame([("c1",), ("c2",), ("c4",)], "root string")
    pairs = graph.reach_pairs(edges, start, max_depth=3)
    return pairs.groupBy("node").agg(F.min("depth").alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("nodes"))


@query("""WITH RECURSIVE p AS (SELECT conv_id, turn, 1 AS n, CAST(role AS VARCHAR) AS chain FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, p.n + 1, p.chain || '>' || c.role FROM p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn + 1)
SELECT conv_id, max(n) AS turns, arg_max(chain, n) AS chain FROM p GROUP BY 1""")
def conv_chain(spark, d):
    c = table(spark, d, "conversations")
    numbered = c.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).filter("at = turn")
    return numbered.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("chain"))


# --- search and recon -------------------------------------------------------------------------------------------------


def _part_entries(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("node")).distinct().select("node", F.lit("name").alias("field"), F.col("node").alias("text"), text.normalize_text(F.col("node")).alias("norm"))


_GRAMS = "list_distinct(list_transform(range(1, length({x}) + 2), lambda i: substr('  ' || {x} || ' ', i, 3)))"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS node FROM part), g AS (SELECT node, {_GRAMS.format(x='node')} AS a, {_GRAMS.format(x="'red wigdet'")} AS b FROM n),
s AS (SELECT node, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS score FROM g) SELECT node, 'trigram' AS how, round_even(score, 3) AS score FROM s WHERE score >= 0.25 ORDER BY score DESC, node LIMIT 15""")
def trigram_topk(spark, d):
    return search.resolve(_part_entries(spark, d), "red wigdet", 15).select("node", "how", "score")


@query("""WITH n AS (SELECT DISTINCT p_name AS node FROM part) SELECT node, CASE WHEN node = 'red' THEN 'exact' WHEN starts_with(node, 'red') THEN 'prefix' ELSE 'substring' END AS how, CASE WHEN node = 'red' THEN 1.0 WHEN starts_with(node, 'red') THEN 0.8 ELSE 0.6 END::DOUBLE AS score
FROM n WHERE contains(node, 'red') ORDER BY score DESC, node LIMIT 10""")
def search_ladder(spark, d):
    return search.resolve(_part_entries(spark, d), "Red").select("node", "how", "score")


@query("""SELECT user_id, count(*) AS touches, round(sum(value), 2) AS size, round(count(*) * sum(value), 0) AS score FROM events GROUP BY 1 ORDER BY count(*) * sum(value) DESC, user_id LIMIT 15""")
def hotspots(spark, d):
    e = table(spark, d, "events")
    sizes = e.groupBy("user_id").agg(F.sum("value").alias("size"))
    return recon.hotspots(e, sizes, "user_id", "size").select("user_id", "touches", F.round("size", 2).alias("size"), F.round("score", 0).alias("score"))


@query("""WITH b AS (SELECT o_orderstatus AS area, o_custkey % 40 AS k, o_orderpriority AS author, count(*) AS n FROM orders GROUP BY 1, 2, 3), t AS (SELECT area, k, sum(n)::BIGINT AS touches, arg_min(author, (-n, author)) AS top_author, max(n) AS top_n FROM b GROUP BY 1, 2)
SELECT area, k, touches, top_author, top_n FROM t WHERE touches >= 5 AND top_n / touches >= 0.26""")
def bus_factor(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("area"), (F.col("o_custkey") % 40).alias("k"), F.col("o_orderpriority").alias("author"))
    return recon.bus_factor(o, ["area", "k"], "author", share=0.26)


@query("""WITH t AS (SELECT DISTINCT doc_id, lang, unnest(string_split(text, ' ')) AS literal FROM documents) SELECT literal, count(DISTINCT doc_id) AS files, array_to_string(list_sort(list(DISTINCT lang)), ',') AS families FROM t WHERE literal <> '' GROUP BY 1 HAVING count(DISTINCT lang) >= 3""")
def literal_seams(spark, d):
    words = table(spark, d, "documents").select(F.col("doc_id").alias("file"), "lang", F.explode(F.split("text", " ")).alias("literal")).filter("literal <> ''")
    return recon.shared_literals(words, "lang", 3).withColumn("families", F.array_join("families", ","))


@query("SELECT lang, count(*) AS files, sum(n_chars)::BIGINT AS total, round(sum(n_chars) / (SELECT sum(n_chars) FROM documents), 6) AS share FROM documents GROUP BY 1")
def language_composition(spark, d):
    return recon.composition(table(spark, d, "documents"), "lang", "n_chars")


@query("""WITH b AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark), k AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents) SELECT count(*) AS ids, count(k.w) AS known FROM b LEFT JOIN k ON b.w = k.w""")
def registry_overlap(spark, d):
    words = lambda n: table(spark, d, n).select(F.explode(F.split("text", " ")).alias("w"))
    return recon.overlap(words("benchmark"), words("documents"), "w")


@query("""WITH f AS (SELECT doc_id FROM documents WHERE n_chars > 1000), q AS (SELECT 'toxic-' || toxic AS question, doc_id AS item, quality = 1 AS expected FROM labels), j AS (SELECT q.*, f.doc_id IS NOT NULL AS seen FROM q LEFT JOIN f ON q.item = f.doc_id)
SELECT question, round(coalesce(count(*) FILTER (expected AND seen) / nullif(count(*) FILTER (expected), 0), 1.0), 3) AS recall, round(1 - coalesce(count(*) FILTER (NOT expected AND seen) / nullif(count(*) FILTER (NOT expected), 0), 0.0), 3) AS precision FROM j GROUP BY 1""")
def eval_recall(spark, d):
    questions = table(spark, d, "labels").select(F.concat(F.lit("toxic-"), F.col("toxic").cast("string")).alias("question"), F.col("doc_id").alias("item"), (F.col("quality") == 1).alias("expected"))
    big = table(spark, d, "documents").filter("n_chars > 1000").select(F.col("doc_id").alias("item"))
    return recon.evaluation(questions, bounded_broadcast(questions.select("question").distinct()).join(big.join(questions.select("item").distinct(), "item", "left_semi").join(questions.select("question", "item"), "item"), "question"))


@query("""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages""")
def zone_parse(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("lang"), F.trim(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)).alias("title"), F.size(F.regexp_extract_all(html, F.lit("<p[ >]"), F.lit(0))).cast("long").alias("paragraphs")
    )


@query("""WITH x AS (SELECT page_id, 'src/' || array_to_string(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), '/') AS path FROM pages) SELECT page_id, (starts_with(path, 'src/m.') OR path = 'src/m.') AS never, regexp_matches(path, '^src/.*example\\.com.*$') AS hit FROM x""")
def glob_scope(spark, d):
    path = F.concat(F.lit("src/"), F.regexp_replace("url", "^[a-z]+://", ""))
    return table(spark, d, "pages").select("page_id", F.startswith(path, F.lit("src/m.")).alias("never"), paths.matches_glob(path, ["src/*example.com*"]).alias("hit"))
