"""Parameter types of member signatures, by bracket-aware scanning in Arrow batches.

Two readings are kept apart on purpose: a member's identity takes the last balanced group, so that a tuple result is no
parameter list; constructor injection takes the first, so that an initialiser isn't one.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Words before a parameter's type that aren't part of it.
PASSING = frozenset(("ref", "out", "in", "params", "this", "scoped", "readonly"))
_OPEN, _CLOSE = "<([{", ">)]}"


def split_at(text: str, separator: str = ",") -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth = max(0, depth - 1)
        elif c == separator and depth == 0:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, text[last:]] if p.strip()]


def _groups(text: str) -> list[str]:
    """The contents of all outermost round groups."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c == "(":
            depth += 1
            start = i + 1 if depth == 1 else start
        elif c == ")" and depth:
            depth -= 1
            if not depth:
                out.append(text[start:i])
    return out


def identity_types(signature: str) -> list[str]:
    """Types of the last group's parameters; a parameter of one word is its type."""
    groups, types = _groups(signature or ""), []
    for p in split_at(groups[-1]) if groups else []:
        words = [w for w in split_at(p, "=")[0].split() if w.lower() not in PASSING]
        types.append(" ".join(words[:-1] if len(words) > 1 else words))
    return types


def injected_types(signature: str) -> list[str]:
    """Types of the first group's parameters without attributes and defaults; parameters of one word are skipped."""
    groups, types = _groups(signature or ""), []
    for p in split_at(groups[0]) if groups else []:
        words = split_at(re.sub(r"^(?:\s*\[[^\]]*\])+\s*", "", p), "=")[0].split()
        while words and words[0] in PASSING:
            words.pop(0)
        if len(words) > 1:
            types.append(" ".join(words[:-1]))
    return types


@F.pandas_udf(ArrayType(StringType()))
def parameter_types(signatures: pd.Series) -> pd.Series:
    return signatures.map(identity_types)


@F.pandas_udf(ArrayType(StringType()))
def injected_parameter_types(signatures: pd.Series) -> pd.Series:
    return signatures.map(injected_types)


def fingerprint(kind: Column, types: Column) -> Column:
    """Eight digits of the hash of a member's kind and parameter types."""
    return F.substring(F.sha2(F.array_join(F.concat(F.array(kind), types), "|"), 256), 1, 8)


def member_key(owner: Column, name: Column, arity: Column, kind: Column, types: Column) -> Column:
    return F.concat(owner, F.lit("::"), name, F.lit("`"), arity.cast("string"), F.lit("~"), fingerprint(kind, types))
