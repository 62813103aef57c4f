"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds its letters' vectors, each permuted (rolled) by
its place; a text's vector bundles (adds) those of all its trigrams, and a language's prototype bundles those of all
its training texts. A text gets the language whose prototype has the largest cosine with its vector, after what all
prototypes share is taken out. Runs of other characters count as one boundary.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import id_residue, small_batches, text_of, trimmed, unused

DIMENSIONS = 512
SEED = 97
#: Code points below have a vector of their own; letters beyond share HASHED vectors.
OWN, HASHED = 0x250, 320
ALPHABET = OWN + HASHED
#: Trigrams up to which a longer training text counts for more: the bundle of a longer one is scaled down to so many. Scaled
#: bundles are added in units of 1 / SCALE.
LONGEST, SCALE = 1000, 1 << 16
#: Texts, and code points, bundled at once (a longer text goes alone); trigrams whose vectors are made at once.
GROUP, GROUP_POINTS, KINDS = 64, 1 << 20, 1 << 13
#: Labels of which prototypes are made at most; more are refused, as a vector for each comes to the driver.
MAX_LABELS = 4096
#: Sharpness of the score.
SHARPNESS = 12.0
UNKNOWN = "und"


@lru_cache(1)
def _slots() -> np.ndarray:
    """A code point's letter, case folded away; 0: not a letter."""
    table = np.zeros(sys.maxunicode + 1, np.int64)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            low = ord(c.lower()[0])
            table[i] = low if low < OWN else OWN + low % HASHED
    return table


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (ALPHABET, DIMENSIONS))
    return np.roll(one, 2, axis=1), np.roll(one, 1, axis=1), one


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct trigrams' letters, counts by text and trigram, the number of letters of each text)."""
    joined = "".join(f"\0{t}\0" for t in texts)
    letters = _slots()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    n_letters = np.bincount(owner[letters > 0], minlength=len(texts))
    kept = np.ones(len(letters), bool)
    kept[1:] = (letters[1:] > 0) | (letters[:-1] > 0) | (owner[1:] != owner[:-1])
    letters, owner = letters[kept], owner[kept]
    whole = (owner[2:] == owner[:-2]) & (letters[1:-1] > 0)
    code = (letters[:-2] * ALPHABET + letters[1:-1]) * ALPHABET + letters[2:]
    kinds, which = np.unique(code[whole], return_inverse=True)
    counts = np.bincount(owner[:-2][whole] * len(kinds) + which, minlength=len(texts) * len(kinds)).reshape(len(texts), len(kinds))
    return kinds, counts, n_letters


def trigram_vectors(kinds: np.ndarray) -> np.ndarray:
    first, second, third = _letters()
    return first[kinds // ALPHABET**2] * second[kinds // ALPHABET % ALPHABET] * third[kinds % ALPHABET]


def groups(texts: list[str]):
    """Slices of texts that are bundled at once."""
    first, points = 0, 0
    for i, t in enumerate(texts):
        if i > first and (i - first >= GROUP or points + len(t) > GROUP_POINTS):
            yield slice(first, i)
            first, points = i, 0
        points += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def bundles(kinds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The texts' vectors: whole numbers, exact as long as a text has less than 2**53 trigrams."""
    kind = np.float32 if counts.sum(axis=1).max(initial=0) < 1 << 24 else np.float64
    out = np.zeros((len(counts), DIMENSIONS), kind)
    for i in range(0, len(kinds), KINDS):
        out += counts[:, i : i + KINDS].astype(kind) @ trigram_vectors(kinds[i : i + KINDS]).astype(kind)
    return out


class Profiles:
    """Languages with their prototypes; scores texts."""

    def __init__(self, prototypes: dict[str, np.ndarray]) -> None:
        self.languages = sorted(k for k, v in prototypes.items() if np.any(v))
        unit = [prototypes[k] / np.linalg.norm(prototypes[k]) for k in self.languages]
        shared = np.mean(unit, axis=0) if len(unit) > 1 else np.zeros(DIMENSIONS)
        own = [v - shared for v in unit]
        self.own = np.array([v / (np.linalg.norm(v) or 1.0) for v in own], np.float32).reshape(-1, DIMENSIONS)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        languages, scores = [], np.zeros(len(texts))
        for at in groups(texts):
            group = texts[at]
            kinds, counts, n_letters = trigram_counts(group)
            if not self.languages or not len(kinds):
                languages += [UNKNOWN] * len(group)
                continue
            vectors = bundles(kinds, counts)
            norms = np.linalg.norm(vectors, axis=1)
            cosines = (vectors @ self.own.T).astype(np.float64) / np.where(norms > 0, norms, 1.0)[:, None]
            best, odds = cosines.argmax(axis=1), np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True)))
            known = n_letters > 0
            scores[at] = np.where(known, 1 / odds.sum(axis=1), 0.0)
            languages += [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return languages, scores


def learn_profiles(labelled: DataFrame, text: str = "text", label: str = "lang") -> Profiles:
    """Prototypes of all rows with a label. Partial bundles are added on the executors; a vector for each label comes back.

    Every trigram of a text is bundled; the bundle of a text with more than LONGEST is then scaled down to so many. Rows with
    a null label or without letters add nothing, repeated rows each count. More than MAX_LABELS labels raise ValueError.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("l"), text_of(text).alias("t"))

    def batch_of(sums):
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["l", "v"])

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in groups(texts):
                kinds, counts, _ = trigram_counts(texts[at])
                length = np.maximum(counts.sum(axis=1, keepdims=True), 1)
                scaled = np.rint(bundles(kinds, counts).astype(np.float64) * (SCALE * np.minimum(1.0, LONGEST / length))).astype(np.int64)
                for name, v in zip(labels[at], scaled):
                    sums[name] = sums.get(name, 0) + v
            if len(sums) > MAX_LABELS:
                yield batch_of(sums)
                sums.clear()
        if sums:
            yield batch_of(sums)

    parts = rows.mapInArrow(trimmed(bundle), "l string, v array<bigint>").select("l", F.posexplode("v").alias("i", "x"))
    out: dict[str, np.ndarray] = {}
    summed = parts.groupBy("l", "i").agg(F.sum("x").alias("x")).limit(MAX_LABELS * DIMENSIONS + 1).collect()
    if len(summed) > MAX_LABELS * DIMENSIONS:
        raise ValueError(f"more than {MAX_LABELS} languages")
    for r in summed:
        out.setdefault(r.l, np.zeros(DIMENSIONS))[r.i] = r.x
    return Profiles(out)


def identify(df: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, lang_pred, score. A null text or one without letters gives UNKNOWN and 0; repeated rows stay."""
    small_batches(df.sparkSession)
    df = df.select(F.col(key).alias("k"), text_of(text).alias("t"))

    def run(batches):
        for batch in batches:
            languages, scores = profiles.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages, pa.string()), pa.array(scores)], ["k", "lang_pred", "score"])

    return df.mapInArrow(trimmed(run), f"k {df.schema['k'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("k", key)


def with_language(df: DataFrame, profiles: Profiles, text: str = "text", out: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """df with the predicted language and its score (0 to 1) in two columns that are added or replaced; all others stay.

    Null texts and texts without letters get UNKNOWN and 0.
    """
    small_batches(df.sparkSession)
    df = df.drop(out, score)

    def run(batches):
        for batch in batches:
            languages, scores = profiles.predict(["" if t is None else t for t in batch.column(text).to_pylist()])
            yield batch.append_column(out, pa.array(languages, pa.string())).append_column(score, pa.array(scores))

    return df.mapInArrow(trimmed(run), StructType([*df.schema.fields, StructField(out, StringType()), StructField(score, DoubleType())]))


def select_languages(df: DataFrame, profiles: Profiles, languages: Sequence[str] | None = None, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of df whose text is in one of languages (null: any of the profiles') with a score of least at least.

    A score over 0.5 says that the language is likelier than all others together. Null texts and texts without letters go. Where
    no language was learned and none is asked for, all texts with letters stay. Columns and repeated rows stay as they are.
    """
    if not profiles.languages and languages is None:
        return df.filter(F.col(text).rlike(r"\p{L}"))
    out, score = unused(df, "language", "score")
    found = with_language(df, profiles, text, out, score)
    wanted = F.col(out) != UNKNOWN if languages is None else F.col(out).isin(*languages)
    return found.filter(wanted & (F.col(score) >= least)).select(*(F.col(f"`{c}`") for c in df.columns))


def language_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of documents(doc_id, text, lang), learned from those whose id's residue isn't 1."""
    profiles = learn_profiles(docs.filter(id_residue(3) != 1))
    return identify(docs, profiles).select("doc_id", (id_residue(3) == 1).alias("held_out"), "lang_pred", "score")
