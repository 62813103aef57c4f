"""SQL for the corpus queries that SQL can express, run on whole tables."""

from __future__ import annotations

from .decontaminate import LOWER, UPPER, WINDOW
from .mixing import MOST_COPIES, SEED

_DOC_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_DOC_WORDS} AS w FROM documents), b AS (SELECT item_id, {_DOC_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2), lambda i: array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' '))) AS gram FROM b WHERE len(w) > 0),
l AS (SELECT DISTINCT n FROM g),
x AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'gram': array_to_string(w[i:i + n - 1], ' ')}})) AS s FROM d JOIN l ON len(w) >= n),
h AS (SELECT DISTINCT x.doc_id, x.s.i AS i, x.n AS n, g.item_id FROM x JOIN g ON x.n = g.n AND x.s.gram = g.gram),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)"""

MIXING = f"""WITH u AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, (CAST('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM u GROUP BY 1),
t AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, {MOST_COPIES} * source_size AS cap FROM z),
r AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft FROM t),
s AS (SELECT *, max(CASE WHEN cap * lft >= w * rest THEN rest::DOUBLE / lft END) OVER () AS level FROM r),
p AS (SELECT source, source_size, least(cap::DOUBLE, level * w) AS target FROM s),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS due FROM p),
o AS (SELECT *, floor(due) AS whole, (due - floor(due)) / (1 - (due - floor(due))) AS odds, target - floor(due) * source_size AS rest FROM q),
y AS (SELECT u.*, o.source_size, o.target, o.whole, o.odds, o.rest, CASE WHEN o.odds > 0 THEN u.u / (1 - u.u) / o.odds END AS q FROM u JOIN o ON u.source IS NOT DISTINCT FROM o.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q / (1 + q), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM y)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN odds > 0 AND upto + upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
v AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT c.doc_id, v.b FROM c JOIN v ON c.c = v.a)
SELECT c.doc_id, coalesce(min(n), 0) AS n_shingles, min(c) AS component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY 1"""


def _pii_kind(name: str, pattern: str, confirm: str, base: float, words: str, least: float) -> str:
    """A list of the kind's spans: matches in order, their places from the lengths of gaps and matches before them."""
    pattern, words = pattern.replace("'", "''"), words.replace("'", "''")
    located = (
        f"list_transform(range(1, len(ms) + 1), lambda i: {{'m': ms[i], 's': list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0), "
        f"'near': regexp_matches(lower(right(gs[i], 40)), '{words}')}})"
    )
    score = f"CASE WHEN x.near THEN {min(1.0, base + 0.3)} ELSE {base} END::DOUBLE"
    kept = f"list_filter({located}, lambda x: ({confirm.format(m='x.m')}) AND {score} >= {least})"
    spelled = f"list_transform({kept}, lambda x: {{'t': '{name}:' || CAST(x.s::BIGINT AS VARCHAR) || ':' || CAST((x.s + length(x.m))::BIGINT AS VARCHAR), 'score': {score}}})"
    return f"{name} AS (SELECT doc_id, {spelled} AS spans FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d))"


_DIGITS = "regexp_replace({m}, '[^0-9]', '', 'g')"
_LUHN = (
    "length(" + _DIGITS + ") BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length(" + _DIGITS + ")), lambda i: "
    "CASE WHEN i % 2 = 0 THEN CAST(substr(" + _DIGITS + ", length(" + _DIGITS + ") - i::BIGINT, 1) AS INTEGER) ELSE (CAST(substr(" + _DIGITS + ", length(" + _DIGITS + ") - i::BIGINT, 1) AS INTEGER) * 2) % 10 + (CAST(substr(" + _DIGITS + ", length(" + _DIGITS + ") - i::BIGINT, 1) AS INTEGER) * 2) // 10 END)) % 10 = 0"
)
_TURNED = "(substr(replace({m}, ' ', ''), 5) || substr(replace({m}, ' ', ''), 1, 4))"
_MOD97 = "list_reduce(list_prepend(0, list_transform(string_split(" + _TURNED + ", ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: (CASE WHEN v < 10 THEN a * 10 ELSE a * 100 END + v) % 97) = 1"
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 0.9, "e-?mail|contact|write", 0.0),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split({m}, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST(CASE WHEN length(ltrim(p, '0')) BETWEEN 1 AND 3 THEN ltrim(p, '0') ELSE '0' END AS INTEGER) > 255)) = 0", 0.6, r"\bip\b|host|server|address", 0.0),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", _LUHN, 0.8, "card|visa|credit|payment", 0.0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(" + _DIGITS + ") BETWEEN 9 AND 15", 0.6, r"phone|\btel|call|mobile|\bfax", 0.0),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", _MOD97, 0.6, "iban|account|konto|bank", 0.5),
    "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches({m}, '^(?:000|666|9)|-00-|-0000$')", 0.3, r"\bssn\b|social security", 0.5),
}
_BASE = ("email", "ip", "card", "phone")

PII = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), " + ", ".join(_pii_kind(k, *v) for k, v in _PII.items())
    + " SELECT d.doc_id, " + ", ".join(f"len({k}.spans) AS n_{k}" for k in _BASE)
    + ", sha256(array_to_string(list_transform(" + "list_concat(list_concat(email.spans, ip.spans), list_concat(card.spans, phone.spans)), lambda x: x.t), ',')) AS base_sha256"
    + ", array_to_string(list_transform(list_concat(list_concat(list_concat(email.spans, ip.spans), list_concat(card.spans, phone.spans)), list_concat(iban.spans, ssn.spans)), lambda x: x.t), ',') AS spans"
    + ", len(iban.spans) AS n_iban, len(ssn.spans) AS n_ssn"
    + ", list_max(list_transform(list_concat(list_concat(list_concat(email.spans, ip.spans), list_concat(card.spans, phone.spans)), list_concat(iban.spans, ssn.spans)), lambda x: x.score)) AS top_score FROM d "
    + " ".join(f"JOIN {k} ON {k}.doc_id = d.doc_id" for k in _PII)
)
