"""Set similarity join of documents by parity sketches: exact up to 64-bit hashes, for a Jaccard similarity of 0.8 or more on word shingles.

A text's shingles are hashed and dealt by hash into the m words of a sketch, each word the XOR of what fell into it.
Words that differ between two sketches, like bits that differ between two parity sketches, are at most as many as the
shingles that only one text has. Texts that link have at most d of those, where d follows from their sizes, so at
least m - d words agree. Each size band has an m of its own, and texts near the top of a band join the next band too.
A text gives out only its d + 1 fullest words: of the m - d that agree, the fullest can't be among those withheld by
either side. m is large enough that nearly no text gives out a word that nothing fell into, which unlike texts would share. Sets of
at most SMALL shingles have a sketch of one word: they give out its parity with and without each shingle, as linked sets differ by at most one of each
side. Equal words make runs, which are joined in three steps without emitting all pairs of a run:

1. Texts with equal sets are one class, with the smallest id.
2. Each member of a run is verified against the run's first member, and components are formed.
3. In runs that still hold several components, all members are compared by size and parity bits, in tiles of BLOCK by BLOCK members
   that are dealt to as many tasks, and the pairs that pass are verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, discard, small_batches, stored, trimmed, unused, utf8_of

WIDTH = 5
#: Linked: LINK[1] * intersection >= LINK[0] * union.
LINK = (80, 100)
PARITY_WORDS = 16
#: Ids up to which a set of them is broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Members of a run that are compared with as many others in a tile: SMALL_BLOCK, as long as that makes at most BLOCKS of them, then
#: more, up to BLOCK; pairs that are compared at once.
SMALL_BLOCK, BLOCKS, BLOCK, PAIRS = 1024, 16, 4096, 1 << 16
#: Sets of at most so many shingles have keys of their own kind.
SMALL = 9
MAX_CACHED_WORDS = 100_000
_C = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of the text's distinct shingles; a text of fewer words has its whole sequence as one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = _WORDS
    h = np.fromiter([w[x] for x in words], np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    span = min(width, len(h))
    s = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(span):
            s = s * _C + h[i : i + n]
        return np.unique(_mix(s + np.uint64(span) * _C))


def differences(a, b):
    """At most so many shingles that only one of two linked sets of these sizes has."""
    return (a + b) * (LINK[1] - LINK[0]) // (LINK[0] + LINK[1])


def largest_partner(n: int) -> int:
    return n * LINK[1] // LINK[0]


def _small_keys(s: np.ndarray) -> np.ndarray:
    """The parities of those subsets, of at most SMALL shingles, that a linked set of at most SMALL can have in common with s."""
    n, whole = len(s), np.bitwise_xor.reduce(s)
    if n > largest_partner(SMALL):
        return s[:0]
    least, out = -(-n * LINK[0] // LINK[1]), []
    for gone in range(max(0, n - SMALL), n - least + 1):
        if gone == 0 and largest_partner(n) == n:
            continue  # only equal sets link, and those are one class already
        if gone == 0:
            left = whole[None]
        elif gone == 1:
            left = whole ^ s
        else:
            i, j = np.triu_indices(n, 1)
            left = whole ^ s[i] ^ s[j]
        out.append(_mix(left ^ np.uint64(n - gone) * _C))
    return np.concatenate(out) if out else s[:0]


def sketch_keys(s: np.ndarray) -> np.ndarray:
    """The keys that a set gives out: of small sets, and of the words of its sketch for its own size band and, if a partner can be there, the next."""
    n = len(s)
    if not n:
        return np.zeros(0, np.uint64)
    band, top = max(0, (n - 1).bit_length()), largest_partner(n)
    with np.errstate(over="ignore"):
        out = [_small_keys(s)]
        for k in (band, band + 1) if n > SMALL else ():
            high = 1 << k
            if k > band and top <= high >> 1:
                continue
            d = int(differences(n, min(top, high)))
            if not d:
                continue  # only equal sets link, and those are one class already
            most = int(differences(high, high))
            m = most + 12 + most // 6
            word = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # s is sorted, so words are contiguous
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts = np.diff(np.append(starts, n))
            value = np.bitwise_xor.reduceat(_mix(s), starts)
            index = word[starts]
            if len(starts) < d + 1:  # empty words are given out last, by index
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), index)[: d + 1 - len(starts)]
                value, index, counts = np.append(value, np.zeros(len(empty), np.uint64)), np.append(index, empty), np.append(counts, np.zeros(len(empty), np.int64))
            full = np.argsort(-counts, kind="stable")[: d + 1]
            out.append(_mix(value[full] ^ _mix(index[full] + np.uint64(k + 1) * _C)))
    return np.unique(np.concatenate(out))


def parity(s: np.ndarray) -> np.ndarray:
    """PARITY_WORDS * 64 bits, each the parity of the shingles that hash to it."""
    bits = np.bincount((s & np.uint64(PARITY_WORDS * 64 - 1)).astype(np.int64), minlength=PARITY_WORDS * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _rows(df: DataFrame, schema: str, make) -> DataFrame:
    """Rows that make gives for each document of df(id, h, t)."""
    small_batches(df.sparkSession)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    arrow = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    kinds = [arrow[x.strip().split(" ")[1]] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            made = list(zip(*(make(*x) for x in zip(*(c.to_pylist() for c in batch.columns))))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, kinds)], names)

    return df.select("id", "h", "t").mapInArrow(trimmed(run), schema)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(np.bitwise_xor.reduce(s).view(np.int64)), int(_mix(s ^ _C).sum(dtype=np.uint64).view(np.int64))


def _describe(i, h, text: bytes) -> tuple:
    s = shingles(text)
    return i, h, len(s), *_fingerprint(s), parity(s), sketch_keys(s).view(np.int64)


def _compatible(a: str, b: str) -> Column:
    """Whether sizes and parity bits allow a link."""
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    apart = F.aggregate(F.zip_with(f"p_{a}", f"p_{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = (F.least(n_a, n_b) * LINK[1] >= F.greatest(n_a, n_b) * LINK[0])
    return sizes & (apart * (LINK[0] + LINK[1]) <= (n_a + n_b) * (LINK[1] - LINK[0]))


def _sets(column: pa.Array):
    """The sets of a binary column, without copies."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // 8
    values = np.frombuffer(data, np.uint64, int(at[-1])) if len(column) and at[-1] else np.zeros(0, np.uint64)
    for i, j in zip(at.tolist(), at[1:].tolist()):
        yield values[i:j]


def _verified(pairs: DataFrame, facts: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked ones of distinct pairs (a, b) of units, whose whole sets are compared. facts(u, id, h, n, p): a row for each unit."""
    for x in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("u").alias(x), F.col("n").alias(f"n_{x}"), F.col("p").alias(f"p_{x}")), x)
    pairs = stored(pairs.filter(_compatible("a", "b")).select("a", "b"), "jaccard-pairs")
    wanted = pairs.select(F.col("a").alias("u")).union(pairs.select(F.col("b").alias("u"))).distinct()
    units = stored(facts.join(wanted, "u").select("u", F.col("id").alias("i"), F.col("h").alias("j")), "jaccard-units")
    needed = bounded_broadcast(units, BROADCAST_IDS)
    texts = docs.join(needed, (docs["id"] == needed["i"]) & (docs["h"] == needed["j"])).select(F.col("u").alias("id"), "h", "t")
    sets = _rows(texts, "id long, s binary", lambda u, h, t: (u, shingles(t).tobytes()))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("s_b")), "b")

    def links(batches):
        for batch in batches:
            keep = []
            for x, y in zip(_sets(batch.column(2)), _sets(batch.column(3))):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common * LINK[1] >= LINK[0] * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    small_batches(docs.sparkSession)
    return both.select("a", "b", "s_a", "s_b").mapInArrow(trimmed(links), "a long, b long").distinct()


def _tile(left: list[np.ndarray], right: list[np.ndarray] | None):
    """The pairs of two blocks (u, c, n, p), or of one with itself, that are of different components and that size and parity bits allow."""
    same = right is None
    left, right = ([x[np.argsort(rows[2], kind="stable")] for x in rows] for rows in (left, left if same else right))
    (u, c, n, p), (v, e, o, q) = left, right
    low, high = np.searchsorted(o, -(-n * LINK[0] // LINK[1]), side="left"), np.searchsorted(o, n * LINK[1] // LINK[0], side="right")
    if same:
        low = np.maximum(low, np.arange(len(u)) + 1)
    i, upto = 0, np.append(0, np.cumsum(np.maximum(high - low, 0)))
    while i < len(u):  # as many rows of the left block at once as make PAIRS pairs
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PAIRS, side="right")) - 1)
        many = np.diff(upto[i : j + 1])
        x = np.repeat(np.arange(i, j), many)
        y = np.arange(len(x)) - np.repeat(upto[i:j] - upto[i], many) + np.repeat(low[i:j], many)
        apart = c[x] != e[y]
        x, y = x[apart], y[apart]
        most = differences(n[x], o[y])
        for words in (slice(0, 4), slice(0, PARITY_WORDS)):  # a quarter of the bits settles most pairs
            ok = np.bitwise_count(p[x, words] ^ q[y, words]).sum(axis=1, dtype=np.int64) <= most
            x, y, most = x[ok], y[ok], most[ok]
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u[x], v[y])), pa.array(np.maximum(u[x], v[y]))], ["a", "b"])
        i = j


def _tiles(batches):
    """From the members of tiles in order (key, x, y, side, u, c, n, p): pairs that may link. Tile (x, x) has one side."""

    def pairs(rows):
        sides = [np.concatenate(x) for x in zip(*rows)]
        parts = [[z[sides[0] == k] for z in sides[1:]] for k in (0, 1)]
        return _tile(parts[0], None if now[1] == now[2] else parts[1])

    now, rows = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = [batch.column(i).to_numpy() for i in range(3)]
        columns = [batch.column(i).to_numpy() for i in range(3, 7)] + [batch.column(7).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, PARITY_WORDS)]
        changes = np.any([x[1:] != x[:-1] for x in tile], axis=0)
        bounds = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            here = tuple(int(x[lo]) for x in tile)
            if rows and here != now:
                yield from pairs(rows)
                rows = []
            now = here
            rows.append([x[lo:hi] for x in columns])
    if rows:
        yield from pairs(rows)


def crowded_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) that may link, of different components, within the runs of members(key, u, c, n, p).

    A run's members are dealt by hash into blocks of BLOCK or less, and each pair of blocks is a tile of its own, so a task holds two blocks
    however long the run is; a member is copied once for each block of its run.
    """
    small_batches(members.sparkSession)
    n = F.count(F.lit(1))
    blocks = members.groupBy("key").agg(F.ceil(F.greatest(n / BLOCK, F.least(n / SMALL_BLOCK, F.lit(float(BLOCKS))))).cast("int").alias("blocks"))
    placed = members.join(blocks, "key").withColumn("b", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.select("key", "b", other.alias("o"), "u", "c", "n", "p").select(
        "key", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), (F.col("b") > F.col("o")).cast("int").alias("side"), "u", "c", "n", "p"
    )
    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(trimmed(_tiles), "a long, b long").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, c): for each node of edges (a, b) the smallest node it is connected with, by alternating large and small stars."""

    def star(e: DataFrame, small: bool) -> DataFrame:
        near = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        near = near if small else near.union(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        joined = near.join(least, "u")
        if small:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.filter("a != b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(edges.select("a", "b").filter("a != b"), name)
    before = None
    while (now := state(edges)) != before:
        before = now
        if not now[0]:
            break
        last, edges = edges, stored(star(star(edges, False), True), name)
        discard(last)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("c"))


def _linked(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h, n, group, component) of every row; h is the text's hash, rows of a group are linked, component is the group's smallest id."""
    docs = df.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("h"), utf8_of(text).alias("t"))
    described = stored(_rows(docs, "id long, h long, n long, f long, g long, p array<long>, keys array<long>", _describe), "jaccard-described")
    docs = docs.filter("id is not null")
    # units are what links: rows with one id and one text, named by the id, or by a hash where an id has several texts
    twice = described.filter("n > 0 and id is not null").groupBy("id").agg(F.min("h").alias("x"), F.max("h").alias("y")).filter("x != y").select(F.col("id").alias("twice"))
    twice = stored(twice, "jaccard-twice")
    if twice.isEmpty():
        described = described.withColumn("u", F.col("id"))
    else:
        twice = bounded_broadcast(twice, BROADCAST_IDS)
        described = described.join(twice, described["id"] == twice["twice"], "left").withColumn("u", F.when(F.col("twice").isNull(), F.col("id")).otherwise(F.xxhash64("id", "h"))).drop("twice")
    some = described.filter("n > 0 and id is not null")
    on = ["n", "f", "g"]
    classes = some.groupBy(*on).agg(F.min("u").alias("first"), F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    several = stored(classes.filter("rows > 1"), "jaccard-classes")
    others = some.select("u", *on).join(several, on).filter("u != first").select(F.col("u").alias("other")).distinct()
    others = bounded_broadcast(stored(others, "jaccard-others"), BROADCAST_IDS)
    keys = some.join(others, some["u"] == others["other"], "left_anti").select(F.explode("keys").alias("key"), "u")
    runs = stored(keys.groupBy("key").agg(F.min("u").alias("a"), F.max("u").alias("b"), F.count(F.lit(1)).alias("size")).filter("a != b"), "jaccard-runs")
    longer = bounded_broadcast(runs.filter("size > 2").select(F.col("key").alias("run"), F.col("a").alias("first")), BROADCAST_IDS)
    members = stored(keys.join(longer, keys["key"] == longer["run"]).select("key", "u", "first").distinct(), "jaccard-members")
    near = runs.filter("size = 2").select("a", "b").union(members.filter("u != first").select(F.col("first").alias("a"), F.col("u").alias("b"))).distinct()
    near = stored(near, "jaccard-near")
    facts = stored(some.select("u", "id", "h", "n", "p").dropDuplicates(["u"]), "jaccard-facts")
    links = stored(_verified(near, facts, docs), "jaccard-links")
    found = components(links)

    named = members.join(found, members["u"] == found["id"], "left").select("key", "u", F.coalesce("c", "u").alias("c"))
    mixed = named.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x != y").select("key")
    crowd = named.join(mixed, "key").join(facts.select("u", "n", "p"), "u")
    rest = stored(crowded_pairs(crowd.select("key", "u", "c", "n", "p")).join(near, ["a", "b"], "left_anti"), "jaccard-leftover")
    if not rest.isEmpty():
        links = stored(links.union(_verified(rest, facts, docs)), "jaccard-all-links")
        found = components(links)

    found = found.select(F.col("id").alias("first"), "c").union(found.select("c", "c").distinct())  # roots too
    labelled = classes.join(found, "first", "left").filter("rows > 1 or c is not null").withColumn("c", F.coalesce("c", "first"))
    smallest = labelled.groupBy("c").agg(F.min("least").alias("component"))
    labels = stored(labelled.join(smallest, "c").select(*on, "c", "component"), "jaccard-labels")
    rows = described.select("id", "h", "u", *on).join(labels, on, "left")
    return rows.select("id", "h", "n", F.coalesce("c", "u").alias("group"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def link_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, n_shingles and component_id (the smallest key reachable by links, itself included) of every row.

    A null or empty text has no shingles and links with nothing. Rows with equal keys and different texts are linked each on its own. A row with a
    null key links with nothing and has a null component. Equal sets are linked whatever the number of copies. An
    empty table gives an empty table; other columns are dropped. Keys are whole numbers.
    """
    return _linked(df, key, text).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one document of each component, that with the smallest key; rows with a null key stay.

    Of rows with equal key and text one stays, the first as JSON. Texts without words stay, as they link with nothing. Columns stay as they are.
    """
    linked = stored(_linked(df.select(key, text), key, text).filter("id is not null"), "jaccard-linked")
    several = linked.filter("n > 0").groupBy("group").agg(F.min(F.struct("id", "h")).alias("keep"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    several = bounded_broadcast(stored(several.drop("rows"), "jaccard-several"), BROADCAST_IDS)
    i, j, k, n = unused(df, "id", "h", "again", "n")
    gone = linked.filter("n > 0").join(several, "group").filter(F.struct("id", "h") != F.col("keep")).select(F.col("id").alias(i), F.col("h").alias(j)).distinct()
    gone = bounded_broadcast(stored(gone, "jaccard-gone"), BROADCAST_IDS)
    own = [F.col(f"`{c}`") for c in df.columns]
    kept = df.join(gone, (F.col(key).cast("long") == F.col(i)) & (F.xxhash64(text) == F.col(j)), "left_anti")
    again = stored(linked.groupBy(F.col("id").alias(k), F.col("h").alias(j)).count().filter("count > 1").select(k, j), "jaccard-again")
    if again.isEmpty():
        return kept.select(*own)
    again = bounded_broadcast(again, BROADCAST_IDS)
    same = (F.col(key).cast("long") == F.col(k)) & (F.xxhash64(text) == F.col(j))
    first = F.row_number().over(Window.partitionBy(key, text).orderBy(F.to_json(F.struct(*own))))
    once = kept.join(again, same, "left_semi").withColumn(n, first).filter(F.col(n) == 1)
    return kept.join(again, same, "left_anti").select(*own).unionByName(once.select(*own))
