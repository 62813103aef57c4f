"""Managed markdown documents: front matter, generated blocks, named sections and the text between them.

Parsing is reversible: the front matter and the segments' texts, joined, are the document byte for byte. A document whose markers
don't match has an error and no segments, as its authored text has no known bounds then.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, _parse_datatype_string

from ..functions.paths import clean
from ..plans.ship import ship
from .files import scan

#: The word that begins a marker.
MARKER = "managed"
DOCUMENT_DDL = "front_matter string, segments array<struct<kind:string,name:string,body:string,text:string>>, error string"


def _lines(text: str) -> list[str]:
    """The lines with their ends, which may be CR LF, CR or LF; other separators are part of a line."""
    ends = [m.end() for m in re.finditer("\r\n?|\n", text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)]) if a < b]


def parse_document(text: str, marker: str = MARKER) -> dict:
    mark = re.compile(rf"<!--\s*{re.escape(marker)}:(generated|section):(start|end)(?:\s+([a-z][a-z0-9_]*))?\s*-->\s*")
    lines, at = _lines(text), 0
    if lines and lines[0].strip() == "---":
        at = next((i + 1 for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), 0)
        if not at:
            return {"error": "the front matter isn't closed"}
    segments, pending, opened, seen = [], [], None, set()
    for number, line in enumerate(lines[at:], at + 1):
        m = mark.fullmatch(line.rstrip("\r\n"))
        if not m or (m[1] == "section") != bool(m[3]):
            pending.append(line)
            continue
        this = (m[1], m[3])
        if m[2] == "start":
            if opened or this in seen:
                return {"error": f"line {number}: {m[1]} opens {'inside another' if opened else 'twice'}"}
            if pending:
                segments.append({"kind": "literal", "name": None, "body": "".join(pending), "text": "".join(pending)})
            seen.add(this)
            opened, pending = this, [line]
        elif opened != this:
            return {"error": f"line {number}: {m[1]} ends that isn't open"}
        else:
            segments.append({"kind": m[1], "name": m[3], "body": "".join(pending[1:]), "text": "".join(pending) + line})
            opened, pending = None, []
    if opened:
        return {"error": f"{opened[0]} isn't closed"}
    if pending:
        segments.append({"kind": "literal", "name": None, "body": "".join(pending), "text": "".join(pending)})
    return {"front_matter": "".join(lines[:at]), "segments": segments}


def parse_documents(files: DataFrame, marker: str = MARKER) -> DataFrame:
    """(path, content_hash, front_matter, segments, error) of markdown files(path, text, content_hash)."""
    return scan(files, _parse_datatype_string(DOCUMENT_DDL), lambda _, text: parse_document(text, marker))


def is_empty(body: Column) -> Column:
    """Whether a section holds nothing but comments and white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(body, "(?s)<!--.*?-->", ""), r"\s+", " ")) == ""


def assemble(front_matter: Column, segments: Column) -> Column:
    return F.concat(front_matter, F.array_join(F.transform(segments, lambda s: s["text"]), ""))


def broken_links(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target) of relative links in authored sections that lead to no file."""
    bodies = documents.select("path", F.explode("segments").alias("s")).filter("s.kind = 'section'")
    targets = bodies.select("path", F.explode(F.regexp_extract_all("s.body", F.lit(r"\]\(([^)#\s]+)[^)]*\)"), F.lit(1))).alias("target")).filter(~F.col("target").rlike("^[a-z]+:|^/"))
    return targets.withColumn("full", clean(F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("target")))).join(files.select(F.col("path").alias("full")), "full", "left_anti").select("path", "target").distinct()


def zone_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind, name, change) of zones between two parsed states: added, removed or changed; equal zones go."""
    zones = lambda df, n: df.select("path", F.inline("segments")).filter("kind <> 'literal'").select("path", "kind", F.coalesce("name", F.lit("")).alias("name"), F.col("body").alias(n))
    j = zones(before, "was").join(zones(after, "now"), ["path", "kind", "name"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return j.withColumn("change", change).filter("change is not null").select("path", "kind", "name", "change")


def unified_diff(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """pairs with the unified text diff of two columns; empty for equal texts."""
    ship(pairs.sparkSession)

    @F.pandas_udf(StringType())
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import unified_diff as lines

        return pd.Series(["".join(lines((x or "").splitlines(True), (y or "").splitlines(True), "before", "after")) for x, y in zip(a, b)])

    return pairs.withColumn("diff", diff(before, after))


def shadowed(expected: DataFrame, documents: DataFrame, files: DataFrame) -> DataFrame:
    """(path) where a document is due and a file is, but the scan of documents didn't return it."""
    return expected.select("path").join(files.select("path"), "path", "left_semi").join(documents.select("path"), "path", "left_anti")


def template_accesses(templates: DataFrame, members: DataFrame) -> DataFrame:
    """(path, type, member): members of its component that a template's interpolations and bindings name.

    templates(path, type, text); members(type, member).
    """
    text = F.col("text")
    held = F.concat(F.regexp_extract_all(text, F.lit(r"(?s)\{\{(.*?)\}\}"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"""(?:\[[\w.-]+\]|\([\w.-]+\)|\*\w+)\s*=\s*"([^"]*)\""""), F.lit(1)), F.regexp_extract_all(text, F.lit(r"@(?:if|for|switch)\s*\(([^)]*)\)"), F.lit(1)))
    names = F.array_distinct(F.flatten(F.transform(held, lambda e: F.regexp_extract_all(e, F.lit(r"(?<![\w.'])([A-Za-z_]\w*)"), F.lit(1)))))
    return templates.select("path", "type", F.explode(names).alias("member")).join(members.select("type", "member").distinct(), ["type", "member"]).select("path", "type", "member")
