"""Facts from TypeScript sources: imports, classes, calls over HTTP, route tables and store actions.

A lexer that knows strings, templates, comments and nesting feeds searches for these forms. Values are followed inside
one file only: literal fields and constants. A call whose address can't be told is kept with the reason.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string

from .csharp import split_top
from .files import scan

SCHEMA_DDL = (
    "imports array<struct<source:string,names:array<struct<local:string,imported:string>>,star:boolean,re_export:boolean,line:int>>,"
    "declarations array<struct<name:string,type_kind:string,modifiers:array<string>,base_types:array<string>,attributes:array<struct<name:string,args:array<string>>>,"
    "members:array<struct<name:string,kind:string,line:int,end_line:int>>,bindings:array<struct<name:string,type:string>>,start:int,end:int,decl_hash:string>>,"
    "http_calls array<struct<http_method:string,url:string,reason:string,member:string,line:int>>, routes array<struct<table:string,path:string,component:string,spread:string,lazy:string,depth:int,line:int>>,"
    "dispatches array<struct<action:string,member:string,line:int>>, usages array<struct<receiver:string,method:string,member:string,line:int>>, parse_errors int"
)
METHODS = ("get", "post", "put", "delete", "patch", "head", "options")
_HIDDEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`", re.S)
_PAIR = {"(": ")", "[": "]", "{": "}"}


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def without_comments(text: str) -> str:
    """The text with comments blanked, so that places stay; comment marks inside strings are left alone."""
    return re.sub(f"({_STRING.pattern})|({_HIDDEN.pattern})", lambda m: m[0] if m[1] else _blank(m), text, flags=re.S)


def _closing(text: str, i: int) -> int:
    """The place of the bracket that closes the one at i, strings skipped; the end of the text if there is none."""
    stack = []
    while i < len(text):
        c = text[i]
        if c in "'\"`" and (m := _STRING.match(text, i)):
            i = m.end()
            continue
        if c in _PAIR:
            stack.append(_PAIR[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i
        i += 1
    return len(text) - 1


class _File:
    def __init__(self, text: str) -> None:
        self.text = without_comments(text)
        self.ends = [m.start() for m in re.finditer("\n", self.text)]
        self.constants = {m[1]: m[2][1:-1] for m in re.finditer(rf"(?:const|readonly|static)\s+(\w+)\s*(?::\s*[\w<>\[\]]+)?\s*=\s*({_STRING.pattern})\s*[;\n]", self.text) if "${" not in m[2]}
        self.spans: list[tuple[int, int, str]] = []

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_left(self.ends, at) + 1

    def member(self, at: int) -> str:
        inside = [(b - a, n) for a, b, n in self.spans if a <= at <= b]
        return min(inside)[1] if inside else ""

    def imports(self) -> list[dict]:
        out = []
        for m in re.finditer(r"^[ \t]*(import|export)\s+(?:type\s+)?(.*?)\s*from\s*(['\"])(.+?)\3", self.text, re.M | re.S):
            if ";" in m[2]:
                continue
            names = [re.split(r"\s+as\s+", n.strip()) for n in split_top(re.sub(r"^.*?\{|\}.*$", "", m[2], flags=re.S))] if "{" in m[2] else []
            lead = m[2].split("{")[0].strip().rstrip(",").strip()
            if lead and "*" not in lead:
                names.append(["default", lead])
            out.append({"source": m[4], "names": [{"local": n[-1], "imported": n[0]} for n in names], "star": "*" in m[2], "re_export": m[1] == "export", "line": self.line(m.start())})
        return out

    def classes(self) -> list[dict]:
        out = []
        for m in re.finditer(r"((?:@\w+\s*\([^@]*?\)\s*)*)((?:export\s+|default\s+|abstract\s+|declare\s+)*)\b(class|interface|enum)\s+(\w+)([^{;]*)\{", self.text):
            stop = _closing(self.text, m.end() - 1)
            bases = [b for part in re.findall(r"\b(?:extends|implements)\s+(.*?)(?=\bimplements\b|$)", m[5], re.S) for b in split_top(part)]
            body = self.text[m.end() : stop]
            members = self.members(m.end(), stop) if m[3] == "class" else []
            ctor = re.search(r"\bconstructor\s*\(", body)
            bindings = []
            if ctor:
                inner = body[ctor.end() : _closing(body, ctor.end() - 1)]
                bindings += [{"name": b[1], "type": b[2]} for p in split_top(inner) if (b := re.search(r"(?:private|public|protected|readonly)\s+(?:readonly\s+)?(\w+)\s*\??:\s*([\w.]+)", p))]
            bindings += [{"name": b[1], "type": b[2]} for b in re.finditer(r"(\w+)\s*(?::\s*[\w<>]+)?\s*=\s*inject\(\s*(\w+)", body)]
            start = m.start(2) if m[2] else m.start(3)
            out.append({
                "name": m[4], "type_kind": m[3], "modifiers": m[2].split(), "base_types": [" ".join(b.split()) for b in bases], "attributes": [{"name": a[1], "args": split_top(a[2])} for a in re.finditer(r"@(\w+)\s*\((.*?)\)\s*(?=@|$)", m[1], re.S)],
                "members": members, "bindings": bindings, "start": self.line(start), "end": self.line(stop), "decl_hash": "sha256:" + hashlib.sha256(" ".join(self.text[m.start() : stop + 1].split()).encode()).hexdigest(),
            })
        return out

    def members(self, i: int, end: int) -> list[dict]:
        out = []
        while i < end:
            m = re.compile(r"\s*(?:@\w+\s*(?:\([^)]*\))?\s*)*((?:(?:public|private|protected|static|readonly|async|abstract|override|get|set|declare)\s+)*)([#\w]+)\s*([?!]?)\s*(<[^>(]*>)?\s*([(:=;])").match(self.text, i, end)
            if not m:
                i += 1
                continue
            stop = m.end() - 1
            if m[5] == "(":
                stop = _closing(self.text, stop) + 1
                brace = re.compile(r"\s*(?::\s*(?:\{[^{}\n]*\}(?=\s*\{)|<\s*\{[^{}\n]*\}\s*>|[^{;\n])*?)?\s*(?!\{[^{}\n]*\}\s*\{)([{;\n])").match(self.text, stop, end)
                if brace and brace[1] == "{":
                    stop = _closing(self.text, brace.end() - 1)
                kind = "constructor" if m[2] == "constructor" else "method"
            else:
                while stop < end and self.text[stop] not in ";\n":
                    stop = (_closing(self.text, stop) if self.text[stop] in _PAIR else _STRING.match(self.text, stop).end() - 1 if self.text[stop] in "'\"`" and _STRING.match(self.text, stop) else stop) + 1
                kind = "field"
            self.spans.append((m.start(2), stop, m[2]))
            out.append({"name": m[2], "kind": kind, "line": self.line(m.start(2)), "end_line": self.line(stop)})
            i = stop + 1
        return out

    def address(self, expression: str) -> tuple[str | None, str | None]:
        """(url, None) or (None, why not). Unknown parts become holes; an unknown start is no address."""
        parts, known = re.split(r"\s*\+\s*(?=(?:[^'\"`]*['\"`][^'\"`]*['\"`])*[^'\"`]*$)", expression.strip()), []
        for i, p in enumerate(parts):
            p = p.strip()
            if m := _STRING.fullmatch(p):
                value = p[1:-1]
                if p[0] == "`":
                    def fill(h: re.Match, first: bool = i == 0) -> str:
                        name = h[1].strip().removeprefix("this.")
                        return self.constants.get(name, "\0" if first and h.start() == 0 else "{}")

                    value = re.sub(r"\$\{([^}]*)\}", fill, value)
                known.append(value)
            else:
                name = p.removeprefix("this.")
                known.append(self.constants.get(name, "\0" if i == 0 else "{}"))
        url = "".join(known)
        if url.startswith("\0"):
            return None, "parameter" if re.fullmatch(r"\w+", expression.strip()) else "unknown_base"
        return url.replace("\0", "{}"), None

    def calls(self) -> list[dict]:
        out = []
        for m in re.finditer(rf"\b(?:this\.)?_?http\w*\s*\.\s*({'|'.join(METHODS)})\s*(?:<[^()]*?>)?\s*\(", self.text, re.I):
            inner = split_top(self.text[m.end() : _closing(self.text, m.end() - 1)])
            url, reason = self.address(inner[0]) if inner else (None, "no_argument")
            out.append({"http_method": m[1].upper(), "url": url, "reason": reason, "member": self.member(m.start()), "line": self.line(m.start())})
        return out

    def routes(self) -> list[dict]:
        out = []

        def walk(table: str, start: int, end: int, prefix: str, depth: int) -> None:
            i = start
            while i < end:
                c = self.text[i]
                if c == "{":
                    stop = _closing(self.text, i)
                    self.route(table, i + 1, stop, prefix, depth, out, walk)
                    i = stop
                elif self.text.startswith("...", i) and (m := re.compile(r"\.\.\.(\w+)").match(self.text, i)):
                    out.append({"table": table, "path": prefix, "component": None, "spread": m[1], "lazy": None, "depth": depth, "line": self.line(i)})
                    i = m.end()
                i += 1

        for m in re.finditer(r"(?:const|let)\s+(\w+)\s*:\s*(?:Routes|Route\[\])\s*=\s*\[", self.text):
            walk(m[1], m.end(), _closing(self.text, m.end() - 1), "", 0)
        return out

    def route(self, table: str, i: int, end: int, prefix: str, depth: int, out: list[dict], walk) -> None:
        own = {}
        for part in split_top(self.text[i:end]):
            k, _, v = part.partition(":")
            own[k.strip()] = v.strip()
        path = own.get("path", "''")[1:-1]
        if path == "**" or "redirectTo" in own:
            return
        full = "/".join(p for p in (prefix, path) if p)
        lazy = re.search(r"import\(\s*['\"](.+?)['\"]\s*\)", own.get("loadChildren", "") + own.get("loadComponent", ""))
        name = re.search(r"\.then\(\s*\(?\w+\)?\s*=>\s*\w+\.(\w+)", own.get("loadChildren", ""))
        if "component" in own or lazy:
            out.append({"table": table, "path": full, "component": own.get("component"), "spread": name and name[1], "lazy": lazy and lazy[1], "depth": depth, "line": self.line(i)})
        if m := re.compile(r"\bchildren\s*:\s*\[").search(self.text, i, end):
            walk(table, m.end(), _closing(self.text, m.end() - 1), full, depth + 1)

    def parse(self) -> dict:
        classes = self.classes()
        usages = [{"receiver": m[1], "method": m[2], "member": self.member(m.start()), "line": self.line(m.start())} for m in re.finditer(r"\bthis\.(\w+)\.(\w+)\s*(?:<[^()]*?>)?\(", self.text)]
        dispatches = [{"action": m[1], "member": self.member(m.start()), "line": self.line(m.start())} for m in re.finditer(r"\bdispatch\(\s*new\s+([\w.]+)", self.text)]
        plain = _STRING.sub(_blank, self.text)
        errors = sum(abs(plain.count(a) - plain.count(b)) for a, b in _PAIR.items())
        return {"imports": self.imports(), "declarations": classes, "http_calls": self.calls(), "routes": self.routes(), "dispatches": dispatches, "usages": usages, "parse_errors": errors}


def parse(path: str, text: str) -> dict:
    return _File(text).parse()


def parse_files(files: DataFrame) -> DataFrame:
    """One row of facts for each TypeScript file of files(path, text, content_hash)."""
    return scan(files, _parse_datatype_string(SCHEMA_DDL), parse)
