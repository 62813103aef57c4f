"""Benchmark decontamination: test n-grams hashed to a broadcast set, all training windows scanned, hits verified.

Everything is built-in column functions. Each document window of ``window`` words (and of the length of any shorter
item) is hashed. A bitmap of the windows' hashes, bounded in size, drops nearly all of them where they arise; the rest are looked
up in the set of windows, and a hit counts only if its words equal the item's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, stored, unused

WINDOW = 13
#: A document is contaminated from a hit share of 1 / SHARE of its words on.
SHARE = 20
#: Distinct windows up to which the set is broadcast (some 300 bytes each); beyond that the join shuffles.
BROADCAST_WINDOWS = 500_000
#: Documents with hits up to which they are broadcast with their hits' positions, if these are few enough too.
BROADCAST_DOCUMENTS = 200_000
#: 64-bit words in the bitmap at most: 128 KB.
MAX_BITMAP = 1 << 14
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters [^\x00-\x2F\x3A-\x60\x7B-\x7F], spelled as what is in the class: it scans 15 times as fast.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def words_of(text: Column) -> Column:
    """The normalised words; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _pairs(hashes: Column, apart: int) -> Column:
    """The hash of each element with the one so many places on."""
    later = F.slice(hashes, apart + 1, F.greatest(F.size(hashes) - apart, F.lit(0)))
    return F.filter(F.zip_with(hashes, later, lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))), lambda x: x.isNotNull())


def window_hashes(words: Column, n: int) -> Column:
    """The hash of each window of n words: hashes of 1, 2, 4, ... words, the last two overlapping if need be."""
    hashes, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < n:
        step = min(width, n - width)
        hashes, width = _bound(hashes, step), width + step
    return hashes


def _bound(hashes: Column, apart: int) -> Column:
    """_pairs of a lambda's variable, so that what it stands for is computed once."""
    return F.flatten(F.transform(F.array(hashes), lambda h: _pairs(h, apart)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Each distinct window of the items: its words, their number, its hash and the ids of the items that have it."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    each = words.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("words"))
    grouped = each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sized = grouped.withColumn("n", F.size("words"))
    by_length = F.coalesce(*(F.when(F.col("n") == n, window_hashes(F.col("words"), n)[0]) for n in range(1, window + 1)))
    return sized.select("words", "items", "n", by_length.alias("hash"))


def _probes(hash_: Column, words: int) -> list[tuple[Column, Column]]:
    """Two places of a hash in a bitmap of so many 64-bit words: the word's index and the bit in it."""
    parts = (hash_, F.shiftrightunsigned(hash_, 32))
    return [(F.pmod(F.shiftrightunsigned(x, 6), F.lit(words)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))) for x in parts]


def bitmap_of(grams: DataFrame) -> tuple[Column, int]:
    """A bitmap of the windows' hashes as an array of longs, and its length, which MAX_BITMAP bounds."""
    n = max(1, grams.count())
    words = min(MAX_BITMAP, 1 << max(6, (n - 1).bit_length() - 1))
    bits = [grams.select(i.alias("i"), b.alias("b")) for i, b in _probes(F.col("hash"), words)]
    values = {r.i: r.v for r in bits[0].union(bits[1]).groupBy("i").agg(F.bit_or("b").alias("v")).collect()}  # a row for each word at most
    spelled = F.lit(",".join(str(values.get(i, 0)) for i in range(words)))
    return F.split(spelled, ",").cast("array<bigint>"), words  # a constant for the optimizer


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: the key, n_words, hits (sorted positions of hit words, from 0) and items (sorted ids).

    Null and empty texts have no words and no hits. Repeated rows each give a row; null keys stay. An empty docs
    table gives an empty table, an empty benchmark or one without words hits nothing. Other columns are dropped.
    """
    grams = stored(benchmark_windows(benchmark, window), "benchmark-windows")
    lengths = sorted(r.n for r in grams.select("n").distinct().collect()) or [window]  # at most `window` of them
    bitmap, n_words = bitmap_of(grams)
    likely = lambda x: [F.get(bitmap, i).bitwiseAND(b) != 0 for i, b in _probes(x, n_words)]

    def candidates(n: int) -> Column:
        numbered = F.transform(window_hashes(F.col("w"), n), lambda h, i: F.when(likely(h)[0] & likely(h)[1], F.struct(i.alias("at"), h.alias("hash"), F.slice("w", i + 1, n).alias("words"))))
        return F.filter(numbered, lambda x: x.isNotNull())

    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    words = own.select("k", F.xxhash64("t").alias("h"), words_of(F.col("t")).alias("w"))
    scanned = words.select("k", "h", F.inline_outer(F.concat(*map(candidates, lengths))))  # outer: else the optimizer adds a filter that computes it twice
    small = bounded_broadcast(grams.withColumnRenamed("words", "gram"), BROADCAST_WINDOWS, "gram", "items")
    found = scanned.join(small, "hash").filter(F.col("words") == F.col("gram"))
    spans = found.groupBy("k", "h").agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = spans.select(
        F.col("k").alias("k2"), F.col("h").alias("h2"), "items", F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))).alias("hits")
    )
    counted = own.select("k", F.xxhash64("t").alias("h"), F.size(words_of(F.col("t"))).cast("long").alias("n_words"))
    joined = counted.join(hits, F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")), "left")
    return joined.select(
        F.col("k").alias(key), "h", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def is_contaminated(share: int = SHARE) -> Column:
    n = F.size("hits")
    return (n > 0) & (n * share >= F.col("n_words"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of documents(doc_id, text)."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


def _cut(text: Column, hits: Column) -> Column:
    """The text without the hit words; what stands between words stays."""
    word = WORD.replace("a-z", "A-Za-z")
    gaps, words = F.split(text, word, -1), F.regexp_extract_all(text, F.lit(word), F.lit(0))
    kept = F.transform(F.arrays_zip(gaps.alias("g"), words.alias("w")), lambda x, i: F.concat(x["g"], F.when(F.array_contains(hits, i), F.lit("")).otherwise(F.coalesce(x["w"], F.lit("")))))
    return F.array_join(kept, "")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, documents: bool = True, spans: bool = True, window: int = WINDOW, share: int = SHARE, key: str = "doc_id", text: str = "text", length: str | None = "n_chars"
) -> DataFrame:
    """docs without contaminated documents (if documents) and, in the others, without hit words (if spans).

    All columns and repeated rows of what stays are kept; the length column, if docs has it, follows a text that was
    cut. Documents without a hit stay as they are.
    """
    found = contamination(docs, benchmark, window, key, text).filter(F.size("hits") > 0)
    k, h, hits, bad, cut = unused(docs, "k", "h", "hits", "bad", "cut")
    hit = found.select(F.col(key).alias(k), F.col("h").alias(h), F.col("hits").alias(hits), is_contaminated(share).alias(bad)).dropDuplicates([k, h])
    hit = bounded_broadcast(stored(hit, "benchmark-hits"), BROADCAST_DOCUMENTS, hits)
    same = docs[key].eqNullSafe(hit[k]) & (F.xxhash64(docs[text]) == hit[h])
    joined = docs.join(hit, same, "left")
    if documents:
        joined = joined.filter(~F.coalesce(bad, F.lit(False)))
    own = {c: F.col(f"`{c}`") for c in docs.columns}
    if not spans:
        return joined.select(*own.values())
    joined = joined.withColumn(cut, F.when(F.col(hits).isNotNull(), _cut(F.col(text), F.col(hits))))
    changed = {text: F.coalesce(cut, F.col(text))}
    if length in docs.columns:
        changed[length] = F.when(F.col(cut).isNotNull(), F.length(cut).cast(docs.schema[length].dataType)).otherwise(own[length])
    return joined.select(*(changed.get(c, own[c]).alias(c) for c in docs.columns))
