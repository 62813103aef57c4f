"""Scalar functions over names, literals and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .routes import normalize_route

#: What case folding changes beyond lower case, for the letters that texts here have.
FOLDED = {"ß": "ss", "ſ": "s", "ς": "σ"}
#: File extension to language, and languages that share a family.
LANGUAGES = {
    "cs": "csharp", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "vue": "vue", "py": "python", "java": "java", "kt": "kotlin", "go": "go", "rs": "rust", "rb": "ruby", "php": "php",
    "sql": "sql", "html": "html", "css": "css", "scss": "css", "xml": "xml", "json": "json", "yaml": "yaml", "yml": "yaml", "sh": "shell", "ps1": "powershell", "md": "markdown", "sln": "solution", "csproj": "project",
}
#: Extensions of files that aren't text, and literals that name nothing.
BINARY = (
    "png", "jpg", "jpeg", "gif", "ico", "svg", "webp", "bmp", "tif", "tiff", "psd", "otf", "woff", "woff2", "ttf", "eot", "pdf", "zip", "gz", "tar", "7z", "dll", "jar", "class", "nupkg", "xlsx", "docx", "pptx", "exe", "so", "dylib", "pdb",
    "snk", "mp4", "mp3", "wav", "bin", "dat", "db", "sqlite",
)
PLAIN_WORDS = (
    "true", "false", "null", "none", "utf-8", "utf8", "application/json", "text/plain", "text/html", "content-type", "authorization", "accept", "get", "post", "put", "delete", "patch", "http", "https", "localhost", "0.0.0.0", "127.0.0.1",
)
FAMILIES = {"typescript": "web", "javascript": "web", "vue": "web", "html": "web", "css": "web", "csharp": "dotnet", "project": "dotnet", "solution": "dotnet", "java": "jvm", "kotlin": "jvm"}


def casefold(x: Column) -> Column:
    out = F.lower(x)
    for a, b in FOLDED.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize_text(x: Column) -> Column:
    """Case folded, white space single and trimmed, the letter yo as ye."""
    plain = F.translate(x, "ёЁ", "еЕ")
    return casefold(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def normalize_data_name(x: Column) -> Column:
    """A dotted table name without quotes and brackets; a schema is never added."""
    bare = F.regexp_replace(x, r"[\[\]\"`']", "")
    parts = F.filter(F.transform(F.split(bare, r"\."), normalize_text), lambda p: p != "")
    return F.array_join(parts, ".")


def normalize_seam(kind: Column, value: Column) -> Column:
    return F.when(kind == "http_route", normalize_route(value)).otherwise(normalize_text(value))


def route_reference(method: Column, route: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.upper(F.trim(method)), normalize_route(route)))


def content_hash(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys; maps among the fields are brought to key order too."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def stable_hash(**fields: Column) -> Column:
    return content_hash(canonical_json(**fields))


def slug(name: Column) -> Column:
    """Kebab case without type parameters; camel humps are split, a name without letters or digits is `unnamed`."""
    plain = F.regexp_replace(name, "(?s)<.*$", "")
    humps = F.regexp_replace(F.regexp_replace(plain, "([A-Z]+)([A-Z][a-z])", "$1-$2"), "([a-z0-9])([A-Z])", "$1-$2")
    dashed = F.lower(F.regexp_replace(F.regexp_replace(humps, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(dashed == "", F.lit("unnamed")).otherwise(dashed)


def trigrams(x: Column) -> Column:
    padded = F.concat(F.lit("  "), x, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _outside(x: Column, opening: str, closing: str) -> Column:
    """The characters of x that no bracket encloses, brackets left out, however deep they nest."""

    def step(a: Column, c: Column) -> Column:
        opens, closes = F.instr(F.lit(opening), c) > 0, F.instr(F.lit(closing), c) > 0
        depth = F.when(opens, a["depth"] + 1).when(closes & (a["depth"] > 0), a["depth"] - 1).otherwise(a["depth"])
        kept = ~opens & ~closes & (a["depth"] == 0)
        return F.struct(depth.alias("depth"), F.when(kept, F.concat(a["out"], c)).otherwise(a["out"]).alias("out"))

    chars = F.filter(F.split(x, ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step)["out"]


def strip_generics(x: Column) -> Column:
    """Without balanced <...> groups, however deep, and without global::."""
    plain = F.regexp_replace(x, "^global::", "")
    return F.when(plain.contains("<"), _outside(plain, "<", ">")).otherwise(plain)


def generic_arity(x: Column) -> Column:
    """The number of type arguments in the last top-level group; 0 without one."""
    inner = F.regexp_extract(F.trim(x), "^[^<]*<(.*)>[^>]*$", 1)
    return F.when(F.trim(x).rlike("<.*>"), F.size(F.split(_outside(inner, "<([", ">)]"), ","))).otherwise(0)


def symbol_key(module: Column, fqn: Column, arity: Column) -> Column:
    return F.concat(module, F.lit("#"), fqn, F.when(arity > 0, F.concat(F.lit("`"), arity.cast("string"))).otherwise(""))


def namespace_prefixes(namespace: Column) -> Column:
    """All prefixes of a dotted namespace, longest first, the empty one last."""
    parts = F.filter(F.split(namespace, r"\."), lambda p: p != "")
    some = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return F.when(F.size(parts) > 0, some).otherwise(F.array(F.lit("")))


def base_type_candidates(x: Column) -> Column:
    """The names under which a rule may mean a type text: whole, without type arguments, last segment of that."""
    head = F.trim(F.split_part(x, F.lit("<"), F.lit(1)))
    return F.array_distinct(F.array(x, head, F.element_at(F.split(head, r"\."), -1)))


def literal_is_noise(x: Column) -> Column:
    """Whether a literal is too plain to be a name that two sides share: a common word, a version, short without structure, or a file's name."""
    version, structured = x.rlike(r"^[vV]?[0-9]+(\.[0-9]+)*([-+][\w.]+)?$"), x.rlike(r"[/.\-_:]")
    upper = (x == F.upper(x)) & (x != F.lower(x))
    extension = F.lower(F.regexp_extract(x, r"[^/]\.([A-Za-z0-9]+)$", 1))
    return F.lower(x).isin(*PLAIN_WORDS) | version | (~structured & (F.length(x) < 12) & ~upper) | extension.isin(*LANGUAGES, *BINARY)


def seam_kind(x: Column) -> Column:
    return (
        F.when(x.contains("/"), "route").when(x.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$"), "upper_name").when(x.rlike(r"^[A-Za-z_]\w*(\.\w+)+$"), "dotted_name").when(x.rlike("^[a-z0-9]+([-.][a-z0-9]+)+$"), "dashed_name").otherwise("identifier")
    )


def language_of(path: Column) -> Column:
    """The language of a file by its extension; empty if unknown."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit(""))


def family_of(language: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, language), language)


def markdown_cell(x: Column) -> Column:
    return F.replace(F.regexp_replace(x, r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))


def substitute(template: Column, values: dict[str, Column]) -> Column:
    """{{ key }} replaced by the value of each allowed key; other places stay."""
    out = template
    for k, v in values.items():
        out = F.replace(F.regexp_replace(out, r"\{\{\s*" + k + r"\s*\}\}", "{{" + k + "}}"), F.lit("{{" + k + "}}"), v)
    return out


def relative_path(source: Column, target: Column) -> Column:
    """The POSIX path from the folder of source to target."""
    a, b = F.slice(F.split(source, "/"), 1, F.size(F.split(source, "/")) - 1), F.split(target, "/")
    most = F.least(F.size(a), F.size(b) - 1)
    common = F.coalesce(F.array_min(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.when((i > most) | (F.get(a, i - 1) != F.get(b, i - 1)), i - 1)), lambda i: i.isNotNull())), most)
    ups = F.array_repeat(F.lit(".."), F.size(a) - common)
    return F.array_join(F.concat(ups, F.slice(b, common + 1, F.size(b) - common)), "/")


#: The folder of a business document by the first part of its id.
DOCUMENT_FOLDERS = {"bp": "processes", "be": "entities", "cap": "capabilities"}


def business_path(doc_id: Column, root: str) -> Column:
    """Where a business document lies: its id, which never changes, says so. Null for an id of another form."""
    table = F.create_map(*(F.lit(x) for pair in DOCUMENT_FOLDERS.items() for x in pair))
    parts = F.split(doc_id, r"\.")
    folder = F.try_element_at(table, F.get(parts, F.lit(0)))
    return F.when(F.size(parts) > 1, F.concat(F.lit(root.rstrip("/") + "/"), folder, F.lit("/"), F.array_join(F.slice(parts, 2, F.size(parts)), "/"), F.lit(".md")))


def counted(n: Column, one: str, few: str, many: str) -> Column:
    """A number with its noun in the form that Slavic languages ask for: 1, 21, ... one; 2 to 4, 22 to 24, ... few; others many."""
    teen = (n % 100).between(11, 14)
    form = F.when(~teen & (n % 10 == 1), one).when(~teen & (n % 10).between(2, 4), few).otherwise(many)
    return F.concat_ws(" ", n.cast("string"), form)


def state_name(decorators: Column) -> Column:
    """The name that a State decorator gives, as its contract, of decorators(name, args); empty without one."""
    states = F.transform(F.filter(decorators, lambda a: a["name"] == "State"), lambda a: F.regexp_extract(F.array_join(a["args"], ","), r"\bname\s*:\s*['\"]([^'\"]*)['\"]", 1))
    return F.coalesce(F.get(states, F.lit(0)), F.lit(""))
