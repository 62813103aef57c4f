"""Items from XML and JSON registries by a declarative specification, and project files.

A specification names the files by globs, where the items are and how each field is read: ``@name`` an attribute,
``path/@name`` one of a child, ``path`` a child's text, ``#tag`` the item's own tag; in JSON a dotted path. Items without a ``ref`` are
left out with an error row, and a file that can't be read gives one error row.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..functions.paths import clean, matches_glob
from .files import scan

ITEM_DDL = "registry string, kind string, ref string, fields map<string,string>, parent_ref string, depth int, ordinal int, error string"


@dataclass(frozen=True)
class Spec:
    id: str
    kind: str
    paths: tuple[str, ...]
    item: str
    fields: dict[str, str]
    format: str = "xml"
    children: Spec | None = field(default=None)


def strip_json_comments(text: str) -> str:
    """JSON without comments and trailing commas; strings are left alone."""
    text = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", text, flags=re.S)


def _from_xml(node: ET.Element, expression: str) -> str | None:
    if expression == "#tag":
        return node.tag.rsplit("}", 1)[-1]
    path, _, attribute = expression.rpartition("@")
    if "@" in expression and not expression.endswith("]"):
        at = node.find(path.rstrip("/")) if path.rstrip("/") not in ("", ".") else node
        return None if at is None else at.get(attribute)
    at = node.find(expression)
    return None if at is None else (at.text or "").strip()


def _from_json(value, path: str):
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return None if value is None or isinstance(value, (dict, list)) else value if isinstance(value, str) else json.dumps(value)


def _items(spec: Spec, node, parent: str, depth: int):
    is_xml = spec.format == "xml"
    found = node.findall(spec.item) if is_xml else (node if isinstance(node, list) else _list_at(node, spec.item))
    for n, item in enumerate(found):
        values = {k: (_from_xml if is_xml else _from_json)(item, e) for k, e in spec.fields.items()}
        ref = values.pop("ref", None) or values.get("title")
        row = {"registry": spec.id, "kind": spec.kind, "ref": ref, "fields": sorted((k, v) for k, v in values.items() if v is not None), "parent_ref": parent, "depth": depth, "ordinal": n}
        if not ref:
            yield row | {"ref": None, "error": f"item {n} has no ref"}
            continue
        yield row
        if spec.children:
            yield from _items(spec.children, item, ref, depth + 1)


def _list_at(value, path: str) -> list:
    for part in filter(None, path.split(".")):
        value = value.get(part) if isinstance(value, dict) else None
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def read_registry(files: DataFrame, spec: Spec) -> DataFrame:
    """The specification's items of files(path, text, content_hash)."""

    def read(path: str, text: str):
        try:
            node = ET.fromstring(text.encode()) if spec.format == "xml" else json.loads(strip_json_comments(text))
        except (ET.ParseError, ValueError) as e:
            return [{"registry": spec.id, "kind": spec.kind, "error": f"unreadable: {e}"}]
        return list(_items(spec, node, "", 0))

    return scan(files.filter(matches_glob(F.col("path"), list(spec.paths))), _parse_datatype_string(ITEM_DDL), read)


def merge_implementations(items: DataFrame, key: Sequence[str] = ("kind", "ref"), implementation: str = "impl_fqn") -> DataFrame:
    """Items of one key as one: their implementations united, and of the other fields those that all of them agree on."""
    entries = items.filter("error is null").select(*key, F.monotonically_increasing_id().alias("__i"), F.explode_outer("fields").alias("name", "value"))
    n = items.filter("error is null").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    same = entries.groupBy(*key, "name", "value").agg(F.count_distinct("__i").alias("m")).join(n, list(key))
    agreed = F.collect_list(F.when((F.col("name") != implementation) & (F.col("m") == F.col("n")), F.struct("name", "value")))
    return same.groupBy(*key).agg(F.array_sort(F.collect_set(F.when(F.col("name") == implementation, F.col("value")))).alias("implementations"), F.map_from_entries(F.array_sort(agreed)).alias("fields"))


def type_name(x: Column) -> Column:
    """struct(fqn, assembly) of an assembly-qualified name: cut at the first comma outside square brackets, arity marks dropped."""
    fqn = F.regexp_extract(x, r"^((?:[^\[\],]|\[(?:[^\[\]]|\[[^\[\]]*\])*\])*)", 1)
    rest = F.trim(F.regexp_replace(F.substring(x, F.length(fqn) + 1, F.lit(1 << 20)), "^,", ""))
    return F.struct(F.regexp_replace(F.trim(fqn), "`[0-9]+", "").alias("fqn"), rest.alias("assembly"))


def projects(files: DataFrame) -> DataFrame:
    """(path, target_frameworks, project_references, package_references) of .csproj files(path, text)."""
    node = lambda name, attribute: F.expr(f"xpath(text, \"//*[local-name()='{name}']/{attribute}\")")
    frameworks = F.flatten(F.transform(F.concat(node("TargetFramework", "text()"), node("TargetFrameworks", "text()")), lambda t: F.split(t, ";")))
    folder = F.regexp_replace("path", "[^/]*$", "")
    resolve = lambda p: clean(F.concat(folder, F.replace(p, F.lit("\\"), F.lit("/"))))
    rows = files.filter(F.lower("path").endswith(".csproj"))
    return rows.select("path", F.filter(frameworks, lambda t: t != "").alias("target_frameworks"), F.transform(node("ProjectReference", "@Include"), resolve).alias("project_references"), F.array_sort(node("PackageReference", "@Include")).alias("package_references"))


def solution_projects(files: DataFrame) -> DataFrame:
    """(path, project) of the projects that .sln and .slnx files name."""
    classic = F.regexp_extract_all("text", F.lit(r'(?m)^Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+proj)"'), F.lit(1))
    modern = F.regexp_extract_all("text", F.lit(r'<Project\s+Path="([^"]+)"'), F.lit(1))
    return files.filter(F.lower("path").rlike(r"\.slnx?$")).select("path", F.explode(F.transform(F.concat(classic, modern), lambda p: F.replace(p, F.lit("\\"), F.lit("/")))).alias("project"))


def resolve_references(found: DataFrame) -> DataFrame:
    """(path, reference, project): project references to known projects by path, else by file name where that names one project only."""
    refs = found.select("path", F.explode("project_references").alias("reference"))
    known = found.select(F.col("path").alias("project"))
    base = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    by_name = known.groupBy(base(F.col("project")).alias("n")).agg(F.min("project").alias("by_name"), F.count(F.lit(1)).alias("c")).filter("c = 1")
    j = refs.join(known, refs["reference"] == known["project"], "left").withColumn("n", base(F.col("reference"))).join(by_name, "n", "left")
    return j.select("path", "reference", F.coalesce("project", "by_name").alias("project"))


def follow(items: DataFrame, files: DataFrame, field: str, base: str, spec: Spec) -> DataFrame:
    """Items of the files that a field of other items names, under base, with the naming item's ref as their parent's name.

    Result: the columns of read_registry and via_ref. A path that leads to no file gives one error row.
    """
    target = F.regexp_replace(F.concat(F.lit(base.rstrip("/") + "/"), F.replace(F.try_element_at("fields", F.lit(field)), F.lit("\\"), F.lit("/"))), "/+", "/")
    wanted = items.filter("error is null").select(F.col("ref").alias("via_ref"), target.alias("target")).filter("target is not null")
    there = wanted.join(files, wanted["target"] == files["path"], "left_semi").select("target").distinct()
    read = read_registry(files.join(there, files["path"] == there["target"], "left_semi"), Spec(spec.id, spec.kind, ("*",), spec.item, spec.fields, spec.format, spec.children))
    found = read.join(wanted, read["path"] == wanted["target"]).drop("target")
    gone = wanted.join(files.select(F.col("path").alias("target")), "target", "left_anti")
    lost = gone.select(*(F.concat(F.lit("no file "), F.col("target")).alias(c) if c == "error" else F.lit(spec.kind).alias(c) if c == "kind" else F.lit(None).cast(read.schema[c].dataType).alias(c) for c in read.columns), "via_ref")
    return found.unionByName(lost)


def record_key(ref: Column, parent: Column, version: Column) -> Column:
    """parent:ref@version, the parts that are there."""
    return F.concat(F.when(F.coalesce(parent, F.lit("")) != "", F.concat(parent, F.lit(":"))).otherwise(""), ref, F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("@"), version)).otherwise(""))


#: The kinds of records and what each must have.
RECORD_KINDS = {"entry_point": ("entry_kind",), "data": ("data_kind",), "seam": ("seam_kind", "literal"), "layer": ("role",)}


def check_records(records: DataFrame) -> DataFrame:
    """(finding, kind, key) of all that is wrong with records(kind, key, fields map), at once."""
    unknown = records.filter(~F.col("kind").isin(*RECORD_KINDS)).select(F.lit("unknown kind").alias("finding"), "kind", "key")
    empty = records.filter(F.coalesce("key", F.lit("")) == "").select(F.lit("no key"), "kind", "key")
    twice = records.groupBy("kind", "key").count().filter("count > 1").select(F.lit("repeated key"), "kind", "key")
    out = unknown.union(empty).union(twice)
    for kind, fields in RECORD_KINDS.items():
        for f in fields:
            out = out.union(records.filter((F.col("kind") == kind) & (F.coalesce(F.try_element_at("fields", F.lit(f)), F.lit("")) == "")).select(F.lit(f"no {f}"), "kind", "key"))
    return out
