"""Priority rules compiled to column expressions.

A condition is a tree of ``{"any": [...]}``, ``{"all": [...]}`` and single predicates ``{name: values}``. Conditions are
checked when they are compiled: an unknown predicate or a bad pattern is an error then, not a row that never matches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob_regex
from ..functions.text import base_type_candidates

Predicates = Mapping[str, Callable[[list], Column]]


class RuleError(ValueError):
    """A rule set that can't be compiled; names the rule and what is wrong."""


@dataclass(frozen=True)
class Rule:
    id: str
    priority: int
    when: dict
    outcome: str = ""  # kind, owner or reason
    template: str = ""
    unless: dict | None = None


def _pattern(values: list) -> str:
    for v in values:
        try:
            re.compile(v)
        except re.error as e:
            raise RuleError(f"bad pattern {v!r}: {e}") from e
    return "^(?:" + "|".join(f"(?:{v})" for v in values) + ")$"


def symbol_predicates() -> Predicates:
    """Predicates over symbols: name, type_kind, namespace, module, modifiers, attributes, base_types, base_type_closure, paths."""
    lits = lambda values: F.array(*map(F.lit, values))
    types = lambda column, values: F.exists(column, lambda t: F.arrays_overlap(base_type_candidates(t), lits(values)))
    prefix = lambda column, sep: lambda values: F.exists(lits(values), lambda v: (F.col(column) == v) | F.startswith(F.col(column), F.concat(v, F.lit(sep))))
    return {
        "attribute": lambda v: F.arrays_overlap("attributes", lits(v)),
        "modifier": lambda v: F.arrays_overlap("modifiers", lits(v)),
        "type_kind": lambda v: F.col("type_kind").isin(*v),
        "name_suffix": lambda v: F.exists(lits(v), lambda s: F.endswith(F.col("name"), s)),
        "name_regex": lambda v: F.col("name").rlike(_pattern(v)),
        "namespace_regex": lambda v: F.col("namespace").rlike(_pattern(v)),
        "path_glob": lambda v: F.exists("paths", lambda p: F.exists(lits([glob_regex(g) for g in v]), lambda g: F.rlike(p, g))),
        "member_attribute": lambda v: F.arrays_overlap("member_attributes", lits(v)),
        "base_type": lambda v: types(F.col("base_types"), v),
        "inherits": lambda v: types(F.col("base_type_closure"), v),
        "kind": lambda v: F.col("kind").isin(*v),
        "domain": lambda v: F.col("domain").isin(*v),
        "module_glob": lambda v: F.exists(lits([glob_regex(g) for g in v]), lambda g: F.rlike(F.col("module"), g)),
        "namespace_prefix": prefix("namespace", "."),
        "fqn_prefix": prefix("fqn", "."),
        "path_prefix": lambda v: F.exists("paths", lambda p: F.exists(lits(v), lambda x: (p == x) | F.startswith(p, F.concat(x, F.lit("/"))))),
    }


def compile_condition(tree: dict, predicates: Predicates, where: str = "rule") -> Column:
    if not isinstance(tree, Mapping) or not tree:
        raise RuleError(f"{where}: an empty condition")
    out = None
    for name, values in tree.items():
        if name in ("any", "all"):
            if not isinstance(values, Sequence) or not values:
                raise RuleError(f"{where}: {name} needs a list")
            parts = [compile_condition(x, predicates, where) for x in values]
            part = parts[0]
            for p in parts[1:]:
                part = (part | p) if name == "any" else (part & p)
        elif name in predicates:
            try:
                part = predicates[name](list(values) if isinstance(values, (list, tuple)) else [values])
            except RuleError as e:
                raise RuleError(f"{where}: {e}") from e
        else:
            raise RuleError(f"{where}: unknown predicate {name!r}")
        part = F.coalesce(part, F.lit(False))
        out = part if out is None else out & part
    return out


def load_rules(items, where: str, outcome: str, required: Sequence[str] = ("id", "priority", "when")) -> list[Rule]:
    """Rules of a parsed configuration: a list of mappings, each with the required fields and ids that don't repeat.

    outcome: the field that names what a rule decides (kind, team or reason). None is an empty list.
    """
    if items is None:
        return []
    if not isinstance(items, list):
        raise RuleError(f"{where}: rules have to be a list")
    out = []
    for n, item in enumerate(items):
        lacking = ["a mapping"] if not isinstance(item, Mapping) else sorted({*required, outcome} - item.keys())
        if lacking:
            raise RuleError(f"{where}: rule {n} lacks {', '.join(lacking)}")
        out.append(Rule(str(item["id"]), int(item["priority"]), dict(item["when"]), str(item[outcome]), str(item.get("template", "")), item.get("unless")))
    check_rules(out)
    return out


def check_rules(rules: Sequence[Rule]) -> None:
    seen: set[str] = set()
    for r in rules:
        if not r.id or r.id in seen:
            raise RuleError(f"missing or repeated rule id {r.id!r}")
        seen.add(r.id)


def matched(rules: Sequence[Rule], predicates: Predicates) -> Column:
    """The rules that hold, as an array of (rank, id, outcome, template) with the winner first: priority falling, then id."""
    check_rules(rules)
    cells = []
    for r in rules:
        holds = compile_condition(r.when, predicates, r.id)
        if r.unless:
            holds = holds & ~compile_condition(r.unless, predicates, r.id)
        cells.append(F.when(holds, F.struct(F.lit(-r.priority).alias("rank"), F.lit(r.id).alias("id"), F.lit(r.outcome).alias("outcome"), F.lit(r.template).alias("template"))))
    if not cells:
        return F.array().cast("array<struct<rank:int,id:string,outcome:string,template:string>>")
    return F.array_sort(F.filter(F.array(*cells), lambda x: x.isNotNull()))


def winner(df: DataFrame, rules: Sequence[Rule], predicates: Predicates) -> DataFrame:
    """df with rule_id, outcome and template of the winner (null if none) and matched_rules, sorted, for audit."""
    first = F.get("__m", F.lit(0))
    return df.withColumn("__m", matched(rules, predicates)).select(
        *df.columns, first["id"].alias("rule_id"), first["outcome"].alias("outcome"), first["template"].alias("template"), F.array_sort(F.transform("__m", lambda x: x["id"])).alias("matched_rules")
    )


def classify(df: DataFrame, excludes: Sequence[Rule], rules: Sequence[Rule], predicates: Predicates, require_public: bool = False) -> DataFrame:
    """df with state (excluded, classified, undecided) and what decided it. Exclusion comes first and has one reason."""
    gone = F.get(matched(excludes, predicates), F.lit(0))
    if require_public:
        gone = F.coalesce(gone, F.when(~F.array_contains("modifiers", "public"), F.struct(F.lit(0).alias("rank"), F.lit("require_public").alias("id"), F.lit("not public").alias("outcome"), F.lit("").alias("template"))))
    out = winner(df.withColumn("__gone", gone), rules, predicates)
    free = F.col("__gone").isNull()
    state = F.when(~free, "excluded").when(F.col("rule_id").isNotNull(), "classified").otherwise("undecided")
    return out.select(
        *df.columns, state.alias("state"), F.when(free, F.col("rule_id")).otherwise(F.col("__gone.id")).alias("rule_id"), F.when(free, F.col("outcome")).alias("kind"), F.when(free, F.col("template")).alias("template"),
        F.col("__gone.outcome").alias("reason"), F.when(free, F.col("matched_rules")).otherwise(F.array().cast("array<string>")).alias("matched_rules"),
    )


def owners(df: DataFrame, rules: Sequence[Rule], predicates: Predicates) -> DataFrame:
    """df with owner, rule_id and tie: whether several rules of different owners share the top priority."""
    m = df.withColumn("__m", matched(rules, predicates))
    first = F.get("__m", F.lit(0))
    top = F.filter("__m", lambda x: x["rank"] == F.get("__m", F.lit(0))["rank"])
    return m.select(*df.columns, first["outcome"].alias("owner"), first["id"].alias("rule_id"), (F.size(F.array_distinct(F.transform(top, lambda x: x["outcome"]))) > 1).alias("tie"))


def decision_stats(decided: DataFrame, by: Sequence[str]) -> DataFrame:
    return decided.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def dead_rules(decided: DataFrame, rules: Sequence[Rule]) -> list[str]:
    """Ids of rules that won nowhere; the list is as long as the rule set."""
    used = {r.rule_id for r in decided.select("rule_id").distinct().filter("rule_id is not null").collect()}
    return sorted(r.id for r in rules if r.id not in used)


def lint_owners(nodes: DataFrame, rule_set: Sequence[Rule], teams: Sequence[str], predicates: Predicates) -> DataFrame:
    """(check, subject, n): rules that win nowhere, nodes without owner by module, teams without nodes, ties."""
    spark = nodes.sparkSession
    decided = owners(nodes, rule_set, predicates)
    won, used = decided.select("rule_id").distinct(), decided.select("owner").distinct()
    given = spark.createDataFrame([(r.id,) for r in rule_set] or [("",)], "subject string").filter("subject <> ''")
    known = spark.createDataFrame([(t,) for t in teams] or [("",)], "subject string").filter("subject <> ''")
    dead = given.join(won.withColumnRenamed("rule_id", "subject"), "subject", "left_anti").select(F.lit("dead_rule").alias("check"), "subject", F.lit(0).cast("long").alias("n"))
    idle = known.join(used.withColumnRenamed("owner", "subject"), "subject", "left_anti").select(F.lit("idle_team"), "subject", F.lit(0).cast("long"))
    orphans = decided.filter("owner is null").groupBy("module").agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphans"), "module", "n")
    ties = decided.filter("tie").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("tie"), "rule_id", "n")
    return dead.union(idle).union(orphans).union(ties)


def select(decided: DataFrame, state: str | None = None, module: str | None = None, namespace: str | None = None, kind: str | None = None, rule: str | None = None, limit: int = 20) -> tuple[DataFrame, int]:
    """The first rows of a decision by fqn after all filters that are given, and how many there are."""
    rows = decided
    for column, value in (("state", state), ("kind", kind), ("rule_id", rule)):
        rows = rows.filter(F.col(column) == value) if value else rows
    if module:
        rows = rows.filter(F.col("module").rlike(glob_regex(module)) | F.contains(F.col("module"), F.lit(module)))
    if namespace:
        rows = rows.filter((F.col("namespace") == namespace) | F.startswith(F.col("namespace"), F.lit(namespace + ".")))
    return rows.orderBy("fqn").limit(limit), rows.count()
