"""Business documents over code: anchors resolved by a ladder, fingerprints, states, back links and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash

#: The order in which an anchor is looked up.
RUNGS = ("registry", "page", "feature", "literal", "symbol")


def resolve_anchors(anchors: DataFrame, known: DataFrame, many_allowed: Sequence[str] = ("event_handler",)) -> DataFrame:
    """anchors(doc, kind, ref, verify) with rung, targets and state; known(rung, kind, ref, target).

    The first rung that has anything decides, even if it has too much: several targets leave an anchor ambiguous unless
    its kind may have many. Anchors that aren't to be verified aren't looked up.
    """
    order = F.array_position(F.array(*map(F.lit, RUNGS)), F.col("rung"))
    hits = anchors.filter("verify").join(known, ["kind", "ref"]).withColumn("__o", order)
    best = hits.withColumn("__b", F.min("__o").over(Window.partitionBy("doc", "kind", "ref"))).filter("__o = __b")
    found = best.groupBy("doc", "kind", "ref").agg(F.min("rung").alias("rung"), F.array_sort(F.collect_set("target")).alias("targets"))
    j = anchors.join(found, ["doc", "kind", "ref"], "left")
    state = F.when(~F.col("verify"), "unverified").when(F.col("rung").isNull(), "unresolved").when((F.size("targets") > 1) & ~F.col("kind").isin(*many_allowed), "ambiguous").otherwise("resolved")
    return j.select("doc", "kind", "ref", "verify", "rung", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"), state.alias("state"))


def fingerprints(resolved: DataFrame) -> DataFrame:
    """(doc, business_hash): hash of the verified anchors in order; what isn't resolved counts with no facts."""
    facts = F.when(F.col("state") == "resolved", F.col("targets")).otherwise(F.array().cast("array<string>"))
    cell = F.struct("kind", "ref", facts.alias("facts"))
    return resolved.filter("verify").groupBy("doc").agg(content_hash(F.to_json(F.array_sort(F.collect_list(cell)))).alias("business_hash"))


def states(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(doc, status, agent_action) of docs(doc, readable, empty_sections, accepted_hash).

    The first that holds: broken (unreadable), empty, broken (an anchor that should be verified isn't), undeclared, drifted, current.
    """
    bad = resolved.filter("verify and state <> 'resolved'").groupBy("doc").agg(F.count(F.lit(1)).alias("bad"))
    j = docs.join(bad, "doc", "left").join(fingerprints(resolved), "doc", "left")
    same = F.col("accepted_hash").eqNullSafe(F.coalesce("business_hash", F.lit("")))
    status = F.when(~F.col("readable"), "broken").when(F.col("empty_sections") > 0, "empty").when(F.coalesce("bad", F.lit(0)) > 0, "broken").when(F.col("accepted_hash").isNull(), "undeclared").when(~same, "drifted").otherwise("current")
    action = F.when(F.col("status") == "empty", "write").when(F.col("status") == "current", "skip").otherwise("review")
    return j.withColumn("status", status).select("doc", "status", action.alias("agent_action"))


def backlinks(resolved: DataFrame) -> DataFrame:
    """(target, docs): the documents that lead to each node."""
    return resolved.filter("state = 'resolved'").select("doc", F.explode("targets").alias("target")).groupBy("target").agg(F.array_sort(F.collect_set("doc")).alias("docs"))


def fact_changes(accepted: DataFrame, current: DataFrame) -> DataFrame:
    """(doc, kind, ref, change, added, removed) between two resolved sets: what came, went or has other targets."""
    a, b = (df.select("doc", "kind", "ref", F.col("targets").alias(n), F.lit(True).alias(f"in_{n}")) for n, df in (("was", accepted), ("now", current)))
    none = F.array().cast("array<string>")
    j = a.join(b, ["doc", "kind", "ref"], "full_outer").withColumn("was", F.coalesce("was", none)).withColumn("now", F.coalesce("now", none))
    change = F.when(F.col("in_was").isNull(), "anchor_added").when(F.col("in_now").isNull(), "anchor_removed").when(F.col("was") != F.col("now"), "targets_changed")
    return j.withColumn("change", change).filter("change is not null").select("doc", "kind", "ref", "change", F.array_except("now", "was").alias("added"), F.array_except("was", "now").alias("removed"))


def lint(docs: DataFrame, resolved: DataFrame, roots: DataFrame) -> DataFrame:
    """(ordinal, check, subject) of all findings, in the order of the checks."""
    duplicate = docs.groupBy("doc").count().filter("count > 1").select("doc")
    without = docs.join(resolved.select("doc").distinct(), "doc", "left_anti").select("doc")
    uncovered = roots.select("ref").join(resolved.filter("state = 'resolved'").select("ref"), "ref", "left_anti")
    found = [
        ("duplicate_id", duplicate), ("no_anchor", without), ("unresolved", resolved.filter("state = 'unresolved'").select(F.concat_ws(":", "doc", "kind", "ref"))), ("ambiguous", resolved.filter("state = 'ambiguous'").select(F.concat_ws(":", "doc", "kind", "ref"))),
        ("uncovered_root", uncovered), ("unreadable", docs.filter("not readable").select("doc")),
    ]
    out = None
    for i, (check, df) in enumerate(found):
        part = df.toDF("subject").select(F.lit(i).alias("ordinal"), F.lit(check).alias("check"), "subject")
        out = part if out is None else out.union(part)
    return out.orderBy("ordinal", "subject")


def find_by_implementation(resolved: DataFrame, names: DataFrame) -> DataFrame:
    """(asked, doc, kind, ref, siblings): names(asked) against anchors' targets, by the whole name or its last segment.

    siblings: other documents with the same kind and ref.
    """
    exploded = resolved.filter("state = 'resolved'").select("doc", "kind", "ref", F.explode("targets").alias("t"))
    keys = exploded.select("doc", "kind", "ref", F.explode(F.array_distinct(F.array("t", F.element_at(F.split("t", r"[.#:]"), -1)))).alias("asked"))
    hits = names.select("asked").distinct().join(keys, "asked").distinct()
    pool = resolved.groupBy("kind", "ref").agg(F.array_sort(F.collect_set("doc")).alias("docs"))
    return hits.join(pool, ["kind", "ref"]).select("asked", "doc", "kind", "ref", F.array_remove("docs", F.col("doc")).alias("siblings"))


def filter_anchors(anchors: DataFrame, kinds: Sequence[str] = (), teams: Sequence[str] = ()) -> DataFrame:
    """Anchors of the kinds and teams; an empty filter narrows nothing."""
    out = anchors.filter(F.col("kind").isin(*kinds)) if kinds else anchors
    return out.filter(F.col("team").isin(*teams)) if teams else out


def selected(resolved: DataFrame, owners: DataFrame) -> DataFrame:
    """resolved anchors with selector_missed and their targets narrowed by what an anchor asks for alone.

    resolved(doc, kind, ref, targets, only_assembly, only_team); owners(target, assembly, team). Assemblies and teams are compared whole.
    Where nothing fits, the targets stay and selector_missed says so; anchors that ask for nothing stay as they are.
    """
    asks = F.coalesce("only_assembly", "only_team").isNotNull()
    rows = resolved.filter(asks).select("doc", "kind", "ref", "only_assembly", "only_team", F.explode("targets").alias("target")).join(owners, "target")
    fits = F.when(F.col("only_assembly").isNotNull(), F.col("assembly") == F.col("only_assembly")).otherwise(F.col("team") == F.col("only_team"))
    kept = rows.filter(fits).groupBy("doc", "kind", "ref").agg(F.array_sort(F.collect_set("target")).alias("__kept"))
    j = resolved.join(kept, ["doc", "kind", "ref"], "left")
    return j.withColumn("selector_missed", asks & F.col("__kept").isNull() & (F.size("targets") > 0)).withColumn("targets", F.coalesce("__kept", "targets")).drop("__kept")


def link_warnings(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, kind, ref, reason) of verified, resolved anchors that give no link: selector_missed, no_implementation or not_documented."""
    rows = resolved.filter("verify and state = 'resolved'")
    some = rows.select("doc", "kind", "ref", F.explode("targets").alias("target")).join(nodes.select(F.col("fqn").alias("target")).distinct(), "target", "left_semi").select("doc", "kind", "ref").distinct()
    reason = F.when(F.col("selector_missed"), "selector_missed").when(F.size("targets") == 0, "no_implementation").when(F.col("__some").isNull(), "not_documented")
    j = rows.join(some.withColumn("__some", F.lit(True)), ["doc", "kind", "ref"], "left").withColumn("reason", reason)
    return j.filter("reason is not null").select("doc", "kind", "ref", "reason")


#: The checks of a catalogue in the order in which they are reported.
CHECKS = ("unresolved", "selector-empty", "no-entry", "ambiguous-version", "unknown-capability", "unknown-team", "team-mismatch", "catalog", "registry-unlinked", "uncovered", "pages-uncovered", "features-uncovered")


def lint_catalog(docs: DataFrame, resolved: DataFrame, capabilities: DataFrame, teams: DataFrame, records: DataFrame, owners: DataFrame, pages: DataFrame, features: DataFrame, errors: DataFrame) -> DataFrame:
    """(ordinal, check, subject): all twelve checks of a catalogue, in order.

    docs(doc, kind, has_entry, capability); resolved as selected() gives it; capabilities(id); teams(id); records(kind, ref, team, target, linked) of
    the registries, a row for each implementation they name; owners(target, team); pages(route); features(name); errors(doc).
    """
    anchor = F.concat_ws(":", "doc", "kind", "ref")
    checked = resolved.filter("verify")
    owned = records.filter("team is not null").join(owners.select("target", F.col("team").alias("owner")), "target").filter("owner is not null and owner <> team")
    gone = lambda left, right, on: left.join(right, on, "left_anti")
    found = {
        "unresolved": checked.filter("state = 'unresolved'").select(anchor), "selector-empty": checked.filter("selector_missed").select(anchor), "no-entry": docs.filter("kind = 'process' and not has_entry").select("doc"),
        "ambiguous-version": checked.filter("state = 'ambiguous' and not selector_missed").select(anchor), "unknown-capability": gone(docs.filter("capability is not null"), capabilities.select(F.col("id").alias("capability")), "capability").select("doc"),
        "unknown-team": gone(resolved.filter("only_team is not null"), teams.select(F.col("id").alias("only_team")), "only_team").select(anchor), "team-mismatch": owned.select(F.concat_ws(":", "kind", "ref")).distinct(), "catalog": errors.select("doc"),
        "registry-unlinked": records.filter("target is not null and not linked").select(F.concat_ws(":", "kind", "ref", "target")), "uncovered": gone(records.select("kind", "ref").distinct(), resolved.select("kind", "ref"), ["kind", "ref"]).select(F.concat_ws(":", "kind", "ref")),
        "pages-uncovered": gone(pages.select("route"), resolved.filter("kind = 'page'").select(F.col("ref").alias("route")), "route").select("route"), "features-uncovered": gone(features.select("name"), resolved.filter("kind = 'feature'").select(F.trim("ref").alias("name")), "name").select("name"),
    }
    out = None
    for i, check in enumerate(CHECKS):
        part = found[check].toDF("subject").select(F.lit(i).alias("ordinal"), F.lit(check).alias("check"), "subject")
        out = part if out is None else out.union(part)
    return out.orderBy("ordinal", "subject")
