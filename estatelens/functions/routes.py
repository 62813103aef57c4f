"""Routes in one canonical spelling, and the keys that calls and endpoints meet on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

HOLE = "{}"


@dataclass(frozen=True)
class Rewrite:
    """A module's proxy rule: a head of the path that goes, and one that is put in front unless it is there."""

    strip_prefix: str = ""
    add_prefix: str = ""


def _parts(path: str) -> list[str]:
    return [p for p in path.split("/") if p]


def _starts(segments: Column, head: list[str]) -> Column:
    lowered = F.transform(F.slice(segments, 1, len(head)), F.lower)
    return (F.size(segments) >= len(head)) & (lowered == F.array(*(F.lit(p.lower()) for p in head)))


def normalize_route(raw: Column, rewrite: Rewrite | None = None) -> Column:
    """Without scheme, host, query and fragment, prefix rewritten by segment, holes as {}, single slashes, lower case."""
    route = F.trim(raw)
    route = F.when(route.contains("://"), F.regexp_replace(route, r"^.*?://[^/]*", "")).otherwise(route)
    route = F.regexp_replace(route, r"[?#](?![^{]*\}).*$", "")
    if rewrite is not None:
        segments = F.filter(F.split(route, "/"), lambda p: p != "")
        head, added = _parts(rewrite.strip_prefix), _parts(rewrite.add_prefix)
        if head:
            segments = F.when(_starts(segments, head), F.slice(segments, len(head) + 1, F.greatest(F.size(segments) - len(head), F.lit(0)))).otherwise(segments)
        if added:
            segments = F.when(_starts(segments, added), segments).otherwise(F.concat(F.array(*map(F.lit, added)), segments))
        if head or added:
            route = F.array_join(segments, "/")
    route = F.regexp_replace(route, r"\$?\{[^{}]*\}", HOLE)
    route = F.regexp_replace(route, r"(^|/):[^/]+(?=/|$)", "$1" + HOLE.replace("{", r"\{"))
    route = F.regexp_replace(route, "/{2,}", "/")
    return F.lower(F.regexp_replace(route, "^/|/$", ""))


def route_key(method: Column, raw: Column, rewrite: Rewrite | None = None, discriminator: Column | None = None) -> Column:
    """The composite key; the discriminator stays as written."""
    extra = F.trim(discriminator) if discriminator is not None else F.lit("")
    return F.struct(F.upper(F.trim(method)).alias("http_method"), normalize_route(raw, rewrite).alias("route"), extra.alias("discriminator"))


def fixed_segments(route: Column) -> Column:
    """What routes that differ in the number of holes alone have in common: an equi-join key."""
    return F.array_join(F.filter(F.split(route, "/"), lambda p: (p != "") & (p != HOLE)), "/")


def almost_equal(a: Column, b: Column) -> Column:
    """Whether two route keys differ in holes alone; equal keys don't."""
    same = (a["http_method"] == b["http_method"]) & (a["discriminator"] == b["discriminator"])
    return same & (a["route"] != b["route"]) & (fixed_segments(a["route"]) == fixed_segments(b["route"]))


def combine_templates(base: Column, template: Column, type_name: Column, member_name: Column) -> Column:
    """An endpoint's route from its class's and its method's template; a leading / or ~/ makes the latter absolute."""
    absolute = template.startswith("/") | template.startswith("~/")
    joined = F.when(absolute, F.regexp_replace(template, "^~?/", "")).otherwise(F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(template, F.lit(""))))
    controller, action = F.regexp_replace(type_name, "Controller$", ""), F.regexp_replace(member_name, "Async$", "")
    return F.replace(F.replace(joined, F.lit("[controller]"), controller), F.lit("[action]"), action)
