"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is built-in column functions. A kind's pattern splits the text into gaps and matches; the running sum of
their lengths gives the places, in code points. The sums run in blocks, so texts with very many matches stay cheap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

BLOCK = 256
CONTEXT = 40
#: Spans beyond the four base kinds stay from this score on.
LEAST = 0.5


@dataclass(frozen=True)
class Kind:
    """pattern: possessive where that changes no match, so that time stays in proportion to the text. needs: a
    cheaper pattern that any text with a match has. words: context that speaks for the kind."""

    name: str
    pattern: str
    needs: str
    confirm: Callable[[Column], Column]
    base: float
    words: str
    certain: bool = False  # its confirmed spans stay at any score


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def mod97(x: Column) -> Column:
    """Whether the account number's remainder is right, its first four characters moved to the end."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + code(c)).otherwise(a * 100 + code(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda x: F.lit(True), 0.9, "e-?mail|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", lambda x: ~F.exists(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{4,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])$")), 0.6, r"\bip\b|host|server|address", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9][\\x20-]?[0-9]", lambda x: F.length(_digits(x)).between(13, 19) & F.call_function("luhn_check", _digits(x)), 0.8, "card|visa|credit|payment", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda x: F.length(_digits(x)).between(9, 15), 0.6, r"phone|\btel|call|mobile|\bfax", True),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])", "[A-Z]{2}[0-9]{2}", mod97, 0.6, r"iban|account|konto|bank"),
    Kind("ssn", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", "[0-9]-[0-9]{2}-[0-9]", lambda x: ~x.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, r"\bssn\b|social security"),
)
BASE = tuple(k for k in KINDS if k.certain)
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def spans_of(kind: Kind, text: Column) -> Column:
    """The kind's confirmed spans: leftmost, non-overlapping matches; those that fail confirmation go, without retry."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    cells = F.transform(F.arrays_zip(gaps.alias("g"), matches.alias("m")), lambda x: F.struct(x["g"].alias("g"), x["m"].alias("m"), (F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))).cast("long").alias("n")))

    def located(cells: Column) -> Column:
        # blocks of cells; where each block starts; then the kept spans of each block
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(cells) - 1) / BLOCK).cast("int")), lambda b: F.slice(cells, b * BLOCK + 1, BLOCK))
        with_sum = F.transform(blocks, lambda b: F.struct(b.alias("b"), F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n")))
        empty = F.array().cast("array<struct<at:bigint,b:array<struct<g:string,m:string,n:bigint>>>>")
        starts = F.aggregate(
            with_sum, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
            lambda a, x: F.struct((a["at"] + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), x["b"].alias("b")))).alias("out")),
        )["out"]
        return F.flatten(F.transform(starts, lambda s: _block_spans(kind, s)))

    one = F.transform(F.array(cells), located)[0]  # binds the cells, so they are computed once
    return F.when(text.rlike(kind.needs), one).otherwise(F.array().cast(_SPAN))


def _block_spans(kind: Kind, block: Column) -> Column:
    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["g"])
        near = F.lower(F.right(x["g"], F.lit(CONTEXT))).rlike(kind.words)
        score = F.when(near, F.lit(min(1.0, kind.base + 0.3))).otherwise(F.lit(kind.base))
        keep = x["m"].isNotNull() & kind.confirm(x["m"])
        if not kind.certain:
            keep = keep & (score >= LEAST)
        span = F.struct(F.lit(kind.name).alias("kind"), start.cast("long").alias("start"), (start + F.length(x["m"])).cast("long").alias("end"), score.alias("score"))
        return F.struct((a["at"] + x["n"]).alias("at"), F.when(keep, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.aggregate(block["b"], F.struct(block["at"].alias("at"), F.array().cast(_SPAN).alias("out")), step)["out"]


def find_pii(df: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS, out: str = "pii") -> DataFrame:
    """df with a column of spans: kind, start, end (code points, end exclusive) and score, by kind, then start.

    A null or empty text gives an empty array; repeated rows each get their own; a column already named ``out`` is
    replaced. Base kinds keep each confirmed match; the others need a score of LEAST, which context words raise.
    Spans of different kinds may overlap. An empty table gives an empty table.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(out, F.concat(*(spans_of(k, body) for k in kinds)))


def redact(df: DataFrame, text: str = "text", out: str = "redacted") -> DataFrame:
    """df with a column of the text in which each found span reads <KIND>; of overlapping spans the first of the longest counts.

    A null text gives null. All other columns and repeated rows stay as they are; a column already named out is replaced.
    """
    pii, end = unused(df, "pii", "done")
    found = find_pii(df, text, out=pii)
    order = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["end"] != b["end"], F.when(a["end"] > b["end"], -1).otherwise(1)).otherwise(0)
    cell = lambda a, s: F.struct(
        F.concat(a["t"], F.substring(F.col(text), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("t"), s["end"].alias("at")
    )
    done = F.aggregate(F.array_sort(pii, order), F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at")), lambda a, s: F.when(s["start"] >= a["at"], cell(a, s)).otherwise(a))
    rest = F.concat(F.col(f"{end}.t"), F.substring(F.col(text), (F.col(f"{end}.at") + 1).cast("int"), F.lit(2**31 - 1)))
    return found.withColumn(end, done).withColumn(out, rest).drop(pii, end)


def pii_digest(df: DataFrame) -> DataFrame:
    """The digest columns of documents(doc_id, text)."""
    found = find_pii(df.select("doc_id", "text")).select("doc_id", "pii")
    spell = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = [k.name for k in BASE]
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(count, base), F.sha2(spell(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), spell(F.col("pii")).alias("spans"),
        *(count(k.name) for k in KINDS if not k.certain), F.array_max(F.transform("pii", lambda s: s["score"])).alias("top_score"),
    )
