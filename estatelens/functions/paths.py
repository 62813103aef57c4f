"""Predicates and lookups on file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """An anchored regex in which * crosses slashes and a leading **/ may match nothing."""
    lead, rest = ("(?:.*/)?", glob[3:]) if glob.startswith("**/") else ("", glob)
    out, i = "", 0
    while i < len(rest):
        c = rest[i]
        if c == "*":
            out += ".*"
            while i + 1 < len(rest) and rest[i + 1] == "*":
                i += 1
        elif c == "?":
            out += "."
        elif c == "[" and "]" in rest[i + 2 :]:
            end = rest.index("]", i + 2)
            out += "[" + rest[i + 1 : end].replace("\\", "\\\\").replace("!", "^", 1 if rest[i + 1] == "!" else 0) + "]"
            i = end
        else:
            out += re.sub(r"([\\.^$|()\[\]{}+])", r"\\\1", c)
        i += 1
    return f"(?s)^{lead}{out}$"


def matches_glob(path: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g))
    return hit


def in_scope(path: Column, scope: list[str]) -> Column:
    """Whether the path lies under one of the prefixes, by segment; an empty scope, or a dot in it, holds everything."""
    clean = [s.strip().strip("/").removeprefix("./") for s in scope]
    if not clean or any(s in ("", ".") for s in clean):
        return F.lit(True)
    hit = F.lit(False)
    for s in clean:
        hit = hit | (path == s) | path.startswith(s + "/")
    return hit


def has_segment(path: Column, segments: list[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, segments)))


def clean(path: Column) -> Column:
    """A relative path without empty, . and .. segments, however many; .. that leads out of it stays."""

    def step(a: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != "..")
        return F.when((s == "") | (s == "."), a).when(F.coalesce(up, F.lit(False)), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def ancestors(path: Column) -> Column:
    """(dir, depth) of each folder above a file, the root as the empty one."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("dir"), n.alias("depth")))
