"""Facts from C# sources by a hand-made lexer and a scanner of declarations.

It knows nesting, strings, comments and declaration heads, not expressions: bodies are searched for constructions and
calls alone. Unbalanced braces count as parse errors; what could be read is kept.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string

from .files import scan

_ATTRIBUTE = "array<struct<name:string,args:array<string>,named_args:map<string,string>>>"
SCHEMA_DDL = (
    f"usings array<string>, global_usings array<string>, declarations array<struct<name:string,type_kind:string,namespace:string,containing_type:string,type_parameters:array<string>,modifiers:array<string>,base_types:array<string>,attributes:{_ATTRIBUTE},"
    f"members:array<struct<name:string,kind:string,signature:string,modifiers:array<string>,attributes:{_ATTRIBUTE},line:int,end_line:int,xml_doc:string>>,start:int,end:int,xml_doc:string,decl_hash:string>>,"
    "registrations array<struct<service_type:string,impl_type:string,lifetime:string,confidence:string,line:int>>, constructions array<struct<type_name:string,member:string,line:int>>,"
    "literal_calls array<struct<method:string,arguments:array<string>,entity:string,member:string,line:int>>, parse_errors int"
)
#: Modifiers and type keywords of the language, and registration methods with their lifetimes.
MODIFIERS = frozenset("public private protected internal static sealed abstract partial virtual override readonly async extern new unsafe volatile const required file ref".split())
TYPE_KINDS = ("class", "struct", "interface", "record", "enum")
LIFETIMES = {"AddSingleton": "singleton", "AddScoped": "scoped", "AddTransient": "transient", "TryAddSingleton": "singleton", "TryAddScoped": "scoped", "TryAddTransient": "transient"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}

_LEXEME = re.compile(
    r'(?P<doc>///[^\n]*)|(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|^[ \t]*\#[^\n]*|\s+)|(?P<string>\$*"{3,}.*?"{3,}|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?"(?:[^"\\\n]|\\.)*")|(?P<char>\'(?:[^\'\\\n]|\\.)+\')'
    r"|(?P<word>@?[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>=>|::|\?\?|[^\w\s])",
    re.S | re.M,
)


@dataclass
class Token:
    kind: str
    text: str
    line: int
    at: int
    end: int


def tokens(source: str) -> list[Token]:
    out, line, at = [], 1, 0
    for m in _LEXEME.finditer(source):
        line += source.count("\n", at, m.start())
        at = m.start()
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], line, m.start(), m.end()))
    return out


def normalize_type(text: str) -> str:
    """A type text in one line: single spaces, none around punctuation, one after a comma."""
    text = re.sub(r"\s*([<>\[\]().?:])\s*", r"\1", " ".join(text.split()))
    return re.sub(r">(?=[\w@])", "> ", re.sub(r"\s*,\s*", ", ", text))


def split_top(text: str, separator: str = ",") -> list[str]:
    """The parts between separators outside all brackets and strings; the arrow of a lambda is no bracket."""
    parts, depth, start, quote = [], 0, 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in "<([{":
            depth += 1
        elif c in ")]}" or c == ">" and text[i - 1] != "=":
            depth -= 1
        elif c == separator and not depth:
            parts.append(text[start:i].strip())
            start = i + 1
    return [p for p in [*parts, text[start:].strip()] if p]


def _unquote(text: str) -> str:
    return re.sub(r'^[$@]*"+|"+$', "", text)


class _Scanner:
    def __init__(self, source: str) -> None:
        self.source, self.all = source, tokens(source)
        self.docs = {t.line: t.text for t in self.all if t.kind == "doc"}
        self.t = [t for t in self.all if t.kind != "doc"]
        self.errors = 0
        self.usings: set[str] = set()
        self.global_usings: set[str] = set()
        self.declarations: list[dict] = []
        self.registrations: list[dict] = []
        self.constructions: list[dict] = []
        self.calls: list[dict] = []
        self.close = self._pairs()

    def _pairs(self) -> dict[int, int]:
        """The closing token of each opening one; what doesn't match is counted."""
        stack, pairs = [], {}
        for i, t in enumerate(self.t):
            if t.kind == "mark" and t.text in _OPEN:
                stack.append(i)
            elif t.kind == "mark" and t.text in _CLOSE:
                if stack and _OPEN[self.t[stack[-1]].text] == t.text:
                    pairs[stack.pop()] = i
                else:
                    self.errors += 1
        self.errors += len(stack)
        return pairs | {i: len(self.t) - 1 for i in stack}

    def text(self, a: int, b: int) -> str:
        return self.source[self.t[a].at : self.t[b - 1].end] if a < b else ""

    def angle(self, i: int, end: int) -> int:
        """The index past the type arguments that begin at i."""
        depth = 0
        while i < end:
            depth += (self.t[i].text == "<") - (self.t[i].text == ">")
            i += 1
            if not depth:
                break
        return i

    def doc_before(self, line: int) -> str:
        lines = []
        while (line := line - 1) in self.docs:
            lines.append(self.docs[line][3:].strip())
        body = " ".join(reversed(lines))
        m = re.search(r"<summary>(.*?)</summary>", body, re.S)
        return " ".join(re.sub(r"<[^>]+>", " ", m[1] if m else "").split())

    def attributes(self, i: int) -> tuple[list[dict], int]:
        found = []
        while self.t[i].text == "[" and i in self.close:
            for part in split_top(self.text(i + 1, self.close[i])):
                part = re.sub(r"^\w+\s*:\s*(?=\w)", "", part)
                m = re.match(r"([\w.:]+)(?:<.*>)?\s*(?:\((.*)\))?\s*$", part, re.S)
                if m:
                    args = split_top(m[2] or "")
                    named = {k: _unquote(v) for k, v in (re.split(r"\s*[=]\s*", a, maxsplit=1) for a in args if re.match(r"\w+\s*=[^=>]", a))}
                    found.append({"name": re.sub("Attribute$", "", m[1].split(".")[-1]) or m[1], "args": [_unquote(a) for a in args if not re.match(r"\w+\s*=[^=>]", a)], "named_args": sorted(named.items())})
            i = self.close[i] + 1
            if i >= len(self.t):
                break
        return found, i

    def run(self) -> None:
        self.block(0, len(self.t), "", "")

    def block(self, i: int, end: int, namespace: str, outer: str) -> None:
        """Namespaces and types between two places."""
        while i < end:
            first = i
            attributes, i = self.attributes(i) if self.t[i].text == "[" else ([], i)
            modifiers = []
            while i < end and self.t[i].text in MODIFIERS:
                modifiers.append(self.t[i].text)
                i += 1
            if i >= end:
                break
            word = self.t[i].text
            if word == "global" and i + 1 < end and self.t[i + 1].text == "using" or word == "using":
                stop = next((j for j in range(i, end) if self.t[j].text == ";"), end - 1)
                name = re.sub(r"^(global\s+)?using\s+(static\s+)?", "", self.text(i, stop)).strip()
                if not name.startswith("("):
                    (self.global_usings if word == "global" else self.usings).add(normalize_type(name.split("=")[-1].strip()))
                i = stop + 1
            elif word == "namespace":
                stop = next((j for j in range(i, end) if self.t[j].text in (";", "{")), end - 1)
                name = ".".join(x for x in (namespace, self.text(i + 1, stop).strip()) if x)
                if self.t[stop].text == "{":
                    self.block(stop + 1, self.close[stop], name, outer)
                    i = self.close[stop] + 1
                else:
                    namespace, i = name, stop + 1
            elif word in TYPE_KINDS and i + 1 < end and self.t[i + 1].kind == "word":
                i = self.type(first, i, end, namespace, outer, attributes, modifiers)
            elif self.t[i].text == "{":
                i = self.close[i] + 1
            else:
                stop = next((j for j in range(i, end) if self.t[j].text in (";", "{")), end - 1)
                self.body(i, self.close.get(stop, stop), "", "")
                i = self.close.get(stop, stop) + 1

    def type(self, first: int, i: int, end: int, namespace: str, outer: str, attributes: list[dict], modifiers: list[str]) -> int:
        kind = self.t[i].text
        i += 1
        if kind == "record" and self.t[i].text in ("class", "struct"):
            i += 1
        name, i, parameters, bases, members = self.t[i].text, i + 1, [], [], []
        if i < end and self.t[i].text == "<":
            past = self.angle(i, end)
            parameters = [p.split()[-1] for p in split_top(self.text(i + 1, past - 1))]
            i = past
        if i < end and self.t[i].text == "(":
            members.append({"name": name, "kind": "constructor", "signature": normalize_type(self.text(first, self.close[i] + 1)), "modifiers": ["public"], "attributes": [], "line": self.t[i].line, "end_line": self.t[self.close[i]].line, "xml_doc": ""})
            i = self.close[i] + 1
        stop = i
        while stop < end and self.t[stop].text not in ("{", ";"):
            stop = self.close.get(stop, stop) + 1
        if i < stop and self.t[i].text == ":":
            head = re.split(r"\bwhere\b", self.text(i + 1, stop))[0]
            bases = [normalize_type(re.sub(r"\(.*\)$", "", b, flags=re.S)) for b in split_top(head)]
        last = self.close.get(stop, stop) if stop < end else end - 1
        entity = ".".join(x for x in (outer, name) if x)
        nested = len(self.declarations)
        if stop < end and self.t[stop].text == "{":
            if kind == "enum":
                for part in split_top(self.text(stop + 1, last)):
                    m = re.search(r"(\w+)\s*(?:=.*)?$", part, re.S)
                    if m:
                        members.append({"name": m[1], "kind": "enum_member", "signature": m[1], "modifiers": [], "attributes": [], "line": self.t[stop].line, "end_line": self.t[stop].line, "xml_doc": ""})
            else:
                members += self.members(stop + 1, last, namespace, entity, name, kind)
        shape = self.text(first, last + 1)
        self.declarations.insert(nested, {
            "name": name, "type_kind": kind, "namespace": namespace, "containing_type": outer, "type_parameters": parameters, "modifiers": modifiers, "base_types": bases, "attributes": attributes, "members": members,
            "start": self.t[first].line, "end": self.t[last].line, "xml_doc": self.doc_before(self.t[first].line), "decl_hash": "sha256:" + hashlib.sha256(" ".join(shape.split()).encode()).hexdigest(),
        })
        return last + 1

    def members(self, i: int, end: int, namespace: str, entity: str, owner: str, owner_kind: str) -> list[dict]:
        found = []
        while i < end:
            first = i
            attributes, i = self.attributes(i) if self.t[i].text == "[" else ([], i)
            modifiers, head = [], i
            while i < end and self.t[i].text in MODIFIERS and not (self.t[i].text == "file"):
                modifiers.append(self.t[i].text)
                i += 1
            if i >= end:
                break
            if self.t[i].text in TYPE_KINDS and i + 1 < end and self.t[i + 1].kind == "word" and self.t[min(i + 2, end - 1)].text not in ("=", ";"):
                i = self.type(first, i, end, namespace, entity, attributes, modifiers)
                continue
            stop, paren = i, -1
            while stop < end and self.t[stop].text not in ("{", ";", "=>", "="):
                if self.t[stop].text == "(" and paren < 0 and stop > i and (self.t[stop - 1].kind == "word" or self.t[stop - 1].text == ">"):
                    paren = stop
                stop = self.close[stop] + 1 if self.t[stop].text in ("(", "[") else stop + 1
            if stop >= end:
                break
            last = stop
            if self.t[stop].text == "{":
                last = self.close[stop]
                if last + 1 < end and self.t[last + 1].text == "=":
                    last = next((j for j in range(last, end) if self.t[j].text == ";"), end - 1)
            else:
                while last < end and self.t[last].text != ";":
                    last = self.close.get(last, last) + 1
            last = min(last, end - 1)
            name, kind = self._named(i, stop, paren, owner)
            if name:
                modifiers = modifiers or (["public"] if owner_kind == "interface" else [])
                found.append({"name": name, "kind": kind, "signature": normalize_type(self.text(head, stop)), "modifiers": modifiers, "attributes": attributes, "line": self.t[first].line, "end_line": self.t[last].line, "xml_doc": self.doc_before(self.t[first].line)})
                self.body(stop, last + 1, entity, name)
            i = last + 1
        return found

    def _named(self, i: int, stop: int, paren: int, owner: str) -> tuple[str, str]:
        if self.t[i].text == "event":
            return self.t[stop - 1].text, "event"
        if paren >= 0:
            at = paren - 1
            while at > i and self.t[at].text != "<" and self.t[paren - 1].text == ">":
                at -= 1
            name = self.t[at - 1 if self.t[at].text == "<" else at].text
            return name, "constructor" if name == owner and at == i else "method"
        names = [k for k in range(i, stop) if self.t[k].kind == "word"]
        if not names:
            return "", ""
        if self.t[names[-1]].text == "this" or any(self.t[k].text == "this" for k in names):
            return "this", "indexer"
        return self.t[stop - 1].text if self.t[stop - 1].kind == "word" else self.t[names[-1]].text, "property" if self.t[stop].text in ("{", "=>") else "field"

    def body(self, i: int, end: int, entity: str, member: str) -> None:
        """Constructions, calls with literals and registrations between two places."""
        while i < end:
            t = self.t[i]
            if t.text == "new" and i + 1 < end and self.t[i + 1].kind == "word":
                j = i + 1
                while j + 1 < end and (self.t[j + 1].text in (".", "::") or self.t[j].text in (".", "::")):
                    j += 1
                past = self.angle(j + 1, end) if j + 1 < end and self.t[j + 1].text == "<" else j + 1
                if past < end and self.t[past].text in ("(", "{"):
                    self.constructions.append({"type_name": normalize_type(self.text(i + 1, past)), "member": member, "line": t.line})
            elif t.kind == "word" and i + 1 < end:
                past = self.angle(i + 1, end) if self.t[i + 1].text == "<" else i + 1
                if past < end and self.t[past].text == "(" and past in self.close:
                    types = split_top(self.text(i + 2, past - 1)) if past > i + 1 else []
                    arguments = split_top(self.text(past + 1, self.close[past]))
                    literals = [_unquote(a) for a in arguments if re.fullmatch(r'[$@]*"(?:[^"\\]|\\.|"")*"', a, re.S)]
                    if literals:
                        self.calls.append({"method": t.text, "arguments": literals, "entity": types[0] if types else entity, "member": member, "line": t.line})
                    if t.text in LIFETIMES:
                        self.register(t, types, arguments)
            i += 1

    def register(self, t: Token, types: list[str], arguments: list[str]) -> None:
        named = [m[1] for a in arguments if (m := re.fullmatch(r"typeof\s*\((.*)\)", a.strip(), re.S))]
        service, impl, confidence = None, None, "high"
        if len(types) >= 2:
            service, impl = types[:2]
        elif len(types) == 1 and not arguments:
            service = impl = types[0]
        elif len(named) >= 2:
            service, impl = named[:2]
        elif len(named) == 1:
            service, impl, confidence = named[0], named[0] if len(arguments) == 1 else None, "high" if len(arguments) == 1 else "medium"
        if service:
            self.registrations.append({"service_type": normalize_type(service), "impl_type": impl and normalize_type(impl), "lifetime": LIFETIMES[t.text], "confidence": confidence, "line": t.line})


def parse(path: str, text: str) -> dict:
    s = _Scanner(text)
    if s.t:
        s.run()
    return {
        "usings": sorted(s.usings), "global_usings": sorted(s.global_usings), "declarations": s.declarations, "registrations": s.registrations, "constructions": s.constructions, "literal_calls": s.calls, "parse_errors": s.errors,
    }


def parse_files(files: DataFrame) -> DataFrame:
    """One row of facts for each C# file of files(path, text, content_hash)."""
    return scan(files, _parse_datatype_string(SCHEMA_DDL), parse)
