"""What an SQL text names: objects defined, read, written and called. Names follow keywords; it isn't a grammar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_data_name

#: The keywords before a name, and words that stand where a name is due.
NAME = r"([\[\]\w.\"`#@]+)"
READ = r"FROM|JOIN|APPLY"
WRITE = r"INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO|TRUNCATE\s+TABLE"
CALL = r"EXEC|EXECUTE|CALL"
DEFINE = r"(?i)\bCREATE\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(PROCEDURE|PROC|FUNCTION|VIEW)\s+"
DYNAMIC = r"(?i)\b(?:EXEC|EXECUTE)\s*\(|\bsp_executesql\b"
NOISE = ("select", "values", "set", "where", "as", "on", "inner", "left", "right", "full", "cross")


#: A name whose last part, quotes aside, begins like a temporary table or a table variable.
TEMPORARY = r"(?:^|\.)[\[\]\"`]*[#@][^.]*$"


def sql_facts(text: Column) -> Column:
    """struct(defines, reads, writes, calls, dynamic, temporary); lists are distinct and sorted, temporary tables only counted."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")

    def found(keywords: str) -> Column:
        return F.filter(F.regexp_extract_all(body, F.lit(rf"(?i)\b(?:{keywords})\s+{NAME}"), F.lit(1)), lambda n: ~F.lower(n).isin(*NOISE))

    def names(keywords: str) -> Column:
        plain = F.transform(F.filter(found(keywords), lambda n: ~n.rlike(TEMPORARY)), normalize_data_name)
        return F.array_sort(F.array_distinct(F.filter(plain, lambda n: n != "")))

    defined = F.arrays_zip(F.regexp_extract_all(body, F.lit(DEFINE + NAME), F.lit(2)).alias("name"), F.regexp_extract_all(body, F.lit(DEFINE + NAME), F.lit(1)).alias("kind"))
    temporary = F.size(F.filter(F.concat(found(READ), found(WRITE)), lambda n: n.rlike(TEMPORARY)))
    return F.struct(
        F.transform(defined, lambda x: F.struct(normalize_data_name(x["name"]).alias("name"), F.lower(x["kind"]).alias("kind"))).alias("defines"),
        names(READ).alias("reads"), names(WRITE).alias("writes"), names(CALL).alias("calls"), body.rlike(DYNAMIC).alias("dynamic"), temporary.alias("temporary"),
    )


def sql_objects(files: DataFrame) -> DataFrame:
    """(path, name, kind, reads, writes, calls, dynamic) of files(path, text) that define procedures, functions or views."""
    facts = files.select("path", sql_facts(F.col("text")).alias("f"))
    return facts.select("path", F.explode("f.defines").alias("d"), "f").select("path", "d.name", "d.kind", "f.reads", "f.writes", "f.calls", "f.dynamic")
