"""Language-model scores: a log-bilinear model trained in numpy with noise-contrastive estimation.

The words before a token (CONTEXT of them) have a vector each; scaled by place and added they predict the token, whose logit is its own
vector's product with that sum, plus a bias. What is predicted are outputs: the corpus's frequent words and, for all other words, seen or
not, one of BUCKETS endings; in its bucket a word has its share of the counts. Outputs are in classes of like frequency,
and P(output) = P(class) * P(output in its class), each normalised by batched matrix products over all its terms.

Training covers all rows, in blocks: first one block alone, for a start; then each block goes on from there on its own, and what
the blocks learned is averaged, by how often each met a vector. All tokens are seen then, at the cost of one model for each block.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_residue, small_batches, stored, trimmed, utf8_of

#: What stands for the end among words; no word has white space. A text begins after CONTEXT ends.
END_WORD = b"\n"
#: Frequent words at most, and the count they need; buckets of all other words; letters (bytes) of their endings.
VOCABULARY, LEAST, BUCKETS, ENDING = 1 << 14, 4, 1 << 12, 3
CONTEXT, DIMENSIONS, NOISE, BATCH, RATE, SEED = 4, 24, 48, 1024, np.float32(0.1), 11
#: Classes, as a share of the number at which scoring has the fewest terms: training goes over classes only.
CLASSES = 0.5
#: Tokens of a training block at least, if there are so many.
BLOCK_TOKENS = 4 << 20
#: Parts in which the blocks' models are added up.
PARTS = 16
#: Words whose counts are broadcast for scoring, at most (some 30 bytes each); those of all others are joined.
MAX_FREQUENT = 1 << 19
#: Words that a task holds with their counts before it gives them out; words whose outputs it holds.
FLUSH, HELD = 500_000, 200_000
SMOOTH = 0.1
#: Tokens scored at once; logits made at once, few enough to stay in a processor's cache.
PART, CACHED = 1 << 15, 1 << 17
#: Sums over shuffled rows are taken in units of 2**-36, so that their order doesn't matter.
UNIT = float(1 << 36)


def _tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END_WORD]


def _encoded(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of texts (UTF-8): their distinct tokens, the end first; all tokens as places in these, text after text; each text's number of tokens."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    flat, owner = parts.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(flat), 0)
    code = flat.filter(some).dictionary_encode()
    n = np.bincount(owner[some.to_numpy(zero_copy_only=False)], minlength=len(texts)) + 1
    words = [END_WORD, *code.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()]
    codes, ends = np.empty(int(n.sum()), np.int64), np.cumsum(n) - 1
    inner = np.ones(len(codes), bool)
    inner[ends] = False
    codes[ends], codes[inner] = 0, code.indices.to_numpy() + 1
    return words, codes, n


def _bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word[-ENDING:]) % buckets


def count_words(train: DataFrame) -> DataFrame:
    """(word, c) of all tokens of train(t), added up per task before the shuffle. An empty text is one end."""
    small_batches(train.sparkSession)

    def added(parts):
        table = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("c", "sum")])
        return table.select(["word", "c_sum"]).rename_columns(["word", "c"])

    def run(batches):
        parts, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            words, codes, _ = _encoded(batch.column(0))
            parts.append(pa.table({"word": pa.array(words, pa.binary()), "c": np.bincount(codes, minlength=len(words))}))
            rows += len(words)
            if rows > 2 * FLUSH:
                parts = [added(parts)]
                rows = len(parts[0])
                if rows > FLUSH:
                    yield from parts[0].to_batches(max_chunksize=1 << 16)
                    parts, rows = [], 0
        if parts:
            yield from added(parts).to_batches(max_chunksize=1 << 16)

    return train.select("t").mapInArrow(trimmed(run), "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class _Outputs(dict):
    """The output of each word: its own, or that of its ending's bucket."""

    def __init__(self, vocabulary: list[bytes], buckets: int) -> None:
        super().__init__((w, i) for i, w in enumerate(vocabulary))
        self.first, self.buckets = len(vocabulary), buckets

    def __missing__(self, word: bytes) -> int:
        out = self.first + _bucket(word, self.buckets)
        if len(self) < HELD:
            self[word] = out
        return out


@dataclass
class Shape:
    """What is fixed before training: words with an output of their own, the outputs' counts, and their classes."""

    vocabulary: list[bytes]
    mass: np.ndarray
    mark: str  # tells models apart in a worker that serves several

    @property
    def buckets(self) -> int:
        return len(self.mass) - len(self.vocabulary)

    def __post_init__(self) -> None:
        self.share = self.mass / self.mass.sum()
        order = np.argsort(-self.mass, kind="stable")
        root = np.sqrt(self.share[order])  # equal sums of roots make the fewest terms: as many in a class, by frequency, as there are classes
        of = np.empty(len(order), np.int64)
        of[order] = CLASSES * (np.cumsum(root) - root / 2)
        self.classes = np.unique(of, return_inverse=True)[1]
        self.class_share = np.bincount(self.classes, self.share)
        self.members = np.split(np.argsort(self.classes, kind="stable"), np.cumsum(np.bincount(self.classes))[:-1])
        self.place = np.empty(len(order), np.int64)
        for x in self.members:
            self.place[x] = np.arange(len(x))


def start(shape: Shape) -> dict[str, np.ndarray]:
    """Before training each output has its share of the corpus, whatever the context."""
    rng, n, f = np.random.default_rng(SEED), len(shape.mass), np.float32
    return {
        "context": rng.normal(0, 0.1, (n, DIMENSIONS)).astype(f), "place": np.full((CONTEXT, 1), CONTEXT**-0.5, f), "word": np.zeros((n, DIMENSIONS), f), "word_bias": np.log(shape.share).astype(f)[:, None],
        "class": np.zeros((len(shape.class_share), DIMENSIONS), f), "class_bias": np.log(shape.class_share).astype(f)[:, None],
    }


#: Arrays with a row for each output; which count of meetings weighs them.
BY_OUTPUT = {"context": "met_context", "word": "met_word", "word_bias": "met_word"}


def _stream(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of texts of n tokens each, with CONTEXT ends (output 0) before each text, and which are to be predicted."""
    at = np.arange(len(ids)) + np.repeat(CONTEXT * np.arange(1, len(n) + 1), n)
    w, real = np.zeros(len(ids) + CONTEXT * len(n), np.int64), np.zeros(len(ids) + CONTEXT * len(n), bool)
    w[at], real[at] = ids, True
    return w, real


def _hidden(model: dict, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted sums of the context vectors before each output of w after the first CONTEXT, and the context vectors of w."""
    e, t, place = model["context"].take(w, axis=0), len(w) - CONTEXT, model["place"][:, 0]
    h = e[CONTEXT - 1 : CONTEXT - 1 + t] * place[0]
    for i in range(1, CONTEXT):
        h += e[CONTEXT - 1 - i : CONTEXT - 1 - i + t] * place[i]
    return h, e


class Trainer:
    """Goes over a block's tokens once, in batches, from a given model."""

    def __init__(self, shape: Shape, model: dict[str, np.ndarray]) -> None:
        self.shape, self.before = shape, model
        self.model = {k: v.copy() for k, v in model.items()}
        self.seen = {k: np.full(len(v), 1e-6, np.float32) for k, v in model.items()}
        self.met = {k: np.zeros(len(shape.mass), np.float32) for k in ("met_context", "met_word")}
        self.rng, self.tokens = np.random.default_rng(SEED), 0
        self.upto, self.level = np.cumsum(shape.share), np.log(shape.share * NOISE).astype(np.float32)
        self.class_level = np.log(shape.class_share * NOISE).astype(np.float32)
        self.class_noise = (shape.class_share * NOISE).astype(np.float32)

    def _move(self, name: str, rows, g: np.ndarray) -> None:
        """One AdaGrad step, with one sum of squares for each row."""
        seen = self.seen[name][rows] + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
        self.seen[name][rows] = seen
        self.model[name][rows] += g * (RATE / np.sqrt(seen))[:, None]

    @staticmethod
    def _by_row(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(rows.astype(np.uint16) if rows.max() < 1 << 16 else rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        return rows[first], np.add.reduceat(g.take(order, axis=0), first, axis=0)

    def step(self, w: np.ndarray, real: np.ndarray) -> None:
        """One batch: w begins CONTEXT before its first token; real: which tokens count (the ends before a text don't)."""
        m, t = self.model, len(w) - CONTEXT
        h, e = _hidden(m, w)
        true, real = w[CONTEXT:], real.astype(np.float32)

        # words: the true ones against NOISE sampled ones that the batch shares
        noise = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE)), len(self.upto) - 1)
        x, y = m["word"].take(true, axis=0), m["word"].take(noise, axis=0)
        g = np.einsum("ij,ij->i", h, x)
        g += m["word_bias"][true, 0] - self.level[true]
        g = real / (1 + np.exp(g, out=g))
        false = h @ y.T
        np.subtract(self.level[noise] - m["word_bias"][noise, 0], false, out=false)
        np.exp(false, out=false)
        false += 1
        np.divide(-real[:, None], false, out=false)
        dh = false @ y
        x *= g[:, None]
        dh += x
        each = np.empty((t + NOISE, DIMENSIONS + 1), np.float32)
        np.multiply(g[:, None], h, out=each[:t, :-1])
        each[t:, :-1] = false.T @ h
        each[:t, -1], each[t:, -1] = g, false.sum(axis=0)
        rows, moved = self._by_row(np.append(true, noise), each)

        # classes: against all of them, each as often as it is noise
        of = self.shape.classes[true]
        cells = h @ m["class"].T
        cells += m["class_bias"][:, 0] - self.class_level
        own = real / (1 + np.exp(cells[np.arange(t), of]))
        np.negative(cells, out=cells)
        np.exp(cells, out=cells)
        cells += 1
        np.divide(-self.class_noise, cells, out=cells)
        cells *= real[:, None]
        cells[np.arange(t), of] += own
        dh += cells @ m["class"]
        self._move("class", slice(None), cells.T @ h)
        self._move("class_bias", slice(None), cells.sum(axis=0)[:, None])
        self._move("word", rows, moved[:, :-1])
        self._move("word_bias", rows, moved[:, -1:])
        self.met["met_word"][rows] += 1

        de, places, place = np.zeros_like(e), np.empty_like(m["place"]), m["place"][:, 0]
        for i in range(CONTEXT):
            at = slice(CONTEXT - 1 - i, CONTEXT - 1 - i + t)
            places[i] = np.vdot(e[at], dh)
            de[at] += dh * place[i]
        rows, moved = self._by_row(w, de)
        self._move("context", rows, moved)
        self.met["met_context"][rows] += 1
        self._move("place", slice(None), places)
        self.tokens += int(real.sum())

    def learned(self) -> list[tuple[int, bytes]]:
        """By part what this block changed, weighed by its meetings, behind these; PARTS is the part of what isn't by output."""
        change = {k: (self.model[k] - self.before[k]) for k in self.model}
        out = []
        for p in range(PARTS):
            cells = [self.met[x][p::PARTS] for x in ("met_context", "met_word")]
            cells += [(change[k][p::PARTS].T * self.met[x][p::PARTS]).T.ravel() for k, x in BY_OUTPUT.items()]
            out.append((p, np.concatenate(cells).astype(np.float32).tobytes()))
        rest = np.concatenate([change[k].ravel() * self.tokens for k in sorted(change.keys() - BY_OUTPUT.keys())])
        return [*out, (PARTS, np.append(self.tokens, rest).astype(np.float32).tobytes())]


def merged(shape: Shape, model: dict[str, np.ndarray], sums: dict[int, np.ndarray]) -> dict[str, np.ndarray]:
    """The model after blocks whose learned() adds up to sums."""
    out = {k: v.copy() for k, v in model.items()}
    for p, x in sums.items():
        if p < PARTS:
            n = len(range(p, len(shape.mass), PARTS))
            met, at = {"met_context": x[:n], "met_word": x[n : 2 * n]}, 2 * n
            for k, by in BY_OUTPUT.items():
                size = n * (out[k].shape[1] if out[k].ndim > 1 else 1)
                change = x[at : at + size].reshape(n, -1) / np.maximum(met[by], 1)[:, None]
                out[k][p::PARTS] += change.reshape(out[k][p::PARTS].shape).astype(np.float32)
                at += size
        elif x[0]:
            at = 1
            for k in sorted(out.keys() - BY_OUTPUT.keys()):
                out[k] += (x[at : at + out[k].size] / x[0]).reshape(out[k].shape).astype(np.float32)
                at += out[k].size
    return out


_LOADED: dict[str, object] = {}


def _loaded(mark: str, make):
    """What make() gives, kept in the worker for its model."""
    if mark not in _LOADED:
        _LOADED.clear()
        _LOADED[mark] = make()
    return _LOADED[mark]


def train_blocks(train: DataFrame, shape: Shape, model: dict[str, np.ndarray], blocks: int, first: bool = False) -> dict[str, np.ndarray]:
    """The model after each of so many blocks of train(t) has gone on from it; with first, after one block alone, of BLOCK_TOKENS at most."""
    small_batches(train.sparkSession)
    shared = train.sparkSession.sparkContext.broadcast((shape, model))

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        if first and block:
            return
        shape, model = shared.value
        outputs, trainer = _Outputs(shape.vocabulary, shape.buckets), Trainer(shape, model)
        w, real = np.zeros(CONTEXT, np.int64), np.zeros(CONTEXT, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            words, codes, n = _encoded(batch.column(0))
            more, counts = _stream(np.fromiter(map(outputs.__getitem__, words), np.int64, len(words)).take(codes), n)
            w, real = np.append(w, more), np.append(real, counts)
            at = 0
            while len(w) - at >= CONTEXT + BATCH:
                trainer.step(w[at : at + CONTEXT + BATCH], real[at + CONTEXT : at + CONTEXT + BATCH])
                at += BATCH
            w, real = w[at:], real[at:]
            if first and trainer.tokens >= BLOCK_TOKENS:
                break
        if len(w) > CONTEXT:
            trainer.step(w, real[CONTEXT:])
        if trainer.tokens:
            part, x = zip(*trainer.learned())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([block] * len(part), pa.int32()), pa.array(x, pa.binary())], ["part", "block", "x"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                sums[p] = sums.get(p, 0) + np.frombuffer(x, np.float32).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "x"])

    learned = train.select("t").coalesce(blocks).mapInArrow(trimmed(run), "part int, block int, x binary")
    added = learned.repartitionById(PARTS + 1, "part").sortWithinPartitions("part", "block").mapInArrow(trimmed(add), "part int, x binary")
    return merged(shape, model, {r.part: np.frombuffer(r.x) for r in added.collect()})  # a row for each part, of a constant size


@dataclass
class Model:
    """shape and trained arrays; frequent words with their counts; the corpus's size. P(word | context) = P(output | context) for
    words with an output of their own, else that times (count + SMOOTH) / 10**scale[bucket]; each bucket has one more share
    of SMOOTH for the words that were never seen."""

    shape: Shape
    arrays: dict[str, np.ndarray]
    words: list[bytes]
    counts: np.ndarray
    scale: np.ndarray
    total: int
    distinct: int

    @property
    def base_scale(self) -> float:
        return float(np.log10(self.total + SMOOTH * (self.distinct + 1)))


def learn(train: DataFrame, counts: DataFrame) -> Model:
    """The model of train(t), whose word counts are given.

    An empty table gives a model in which all words are unseen. Repeated rows count each time; other columns play no part.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    level = F.floor(F.log2("c") * 8)
    least, n = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):  # some 500 rows at most
        n += r["count"]
        if n > MAX_FREQUENT:
            break
        least = r.level
    frequent = (level >= (least if least is not None else 1 << 30)) | (F.col("word") == END_WORD)
    got = counts.filter(frequent).toArrow()  # MAX_FREQUENT rows and the end at most
    c = dict(zip(got.column("word").to_pylist(), got.column("c").to_pylist()))
    del got
    words = [END_WORD, *sorted(c.keys() - {END_WORD}, key=lambda w: (-c[w], w))]
    of_word = np.array([c.get(w, 0) for w in words], np.int64)
    own = 1 + int((of_word[1:VOCABULARY] >= LEAST).sum())

    bucket = F.pmod(F.crc32(F.substring("word", -ENDING, ENDING)), F.lit(BUCKETS))
    sums, kinds = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in counts.groupBy(bucket.alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():  # BUCKETS rows at most
        sums[r.b], kinds[r.b] = r.c, r.n
    for w, n in zip(words[:own], of_word):  # words with an output of their own are in no bucket
        if n:
            sums[_bucket(w, BUCKETS)] -= n
            kinds[_bucket(w, BUCKETS)] -= 1
    shape = Shape(words[:own], np.append(of_word[:own], sums) + SMOOTH, uuid.uuid4().hex)
    model, blocks = start(shape), max(1, total // BLOCK_TOKENS)
    for first in (True, False):
        model = train_blocks(train, shape, model, blocks, first)
    return Model(shape, model, words, of_word, np.log10(sums + SMOOTH * (kinds + 1)), total, distinct)


def log_probabilities(shape: Shape, arrays: dict[str, np.ndarray], w: np.ndarray) -> np.ndarray:
    """Natural log P(output | the CONTEXT outputs before it) of w's outputs after the first CONTEXT, normalised."""
    norm = lambda x: float(np.einsum("ij,ij->i", x, x).max(initial=0))
    bias = max(float(arrays["word_bias"].max()), float(arrays["class_bias"].max()))
    longest, ones = max(norm(arrays["word"]), norm(arrays["class"])), np.ones(max(len(shape.members), max(map(len, shape.members))), np.float32)

    def picked(logits: np.ndarray, bias: np.ndarray, at: np.ndarray, safe: bool) -> np.ndarray:
        logits += bias[:, 0]
        own = logits[np.arange(len(at)), at]
        if safe:
            return own - np.log(np.exp(logits, out=logits) @ ones[: logits.shape[1]])
        top = logits.max(axis=1)
        logits -= top[:, None]
        return own - top - np.log(np.exp(logits, out=logits) @ ones[: logits.shape[1]])

    of, h = shape.classes[w[CONTEXT:]], np.empty((len(w) - CONTEXT, DIMENSIONS), np.float32)
    vectors, out, safe = np.ascontiguousarray(arrays["class"].T), np.empty(len(h)), True
    step = max(1, CACHED // vectors.shape[1])
    for i in range(0, len(h), step):
        part, _ = _hidden(arrays, w[i : i + step + CONTEXT])
        fits = (norm(part) * longest) ** 0.5 + bias < 60  # no sum of exp can overflow
        out[i : i + step] = picked(part @ vectors, arrays["class_bias"], of[i : i + step], fits)
        h[i : i + step], safe = part, safe and fits
    order = np.argsort(of.astype(np.uint16), kind="stable")  # fewer classes than the root of 2**32
    bounds = np.searchsorted(of[order], np.arange(len(shape.members) + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        mine = shape.members[k]
        if len(mine) == 1:
            continue
        vectors, own_bias, rows = np.ascontiguousarray(arrays["word"][mine].T), arrays["word_bias"][mine], max(1, CACHED // len(mine))
        for i in range(bounds[k], bounds[k + 1], rows):
            at = order[i : min(i + rows, bounds[k + 1])]
            out[at] += picked(h[at] @ vectors, own_bias, shape.place[w[CONTEXT + at]], safe)
    return out


def _score(df: DataFrame, model: Model) -> DataFrame:
    """(k, h, n, known, base, score, rare, times): sums over frequent words; words that aren't frequent with their numbers."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema["k"].dataType.simpleString()

    def run(batches):
        m = shared.value
        count, own = len(m.words), len(m.shape.vocabulary)

        def make():
            outputs = np.array([*range(own), *(own + _bucket(w, m.shape.buckets) for w in m.words[own:])], np.int64)
            return {w: i for i, w in enumerate(m.words)}, outputs, np.log10(m.counts + SMOOTH)

        index, outputs, logs = _loaded(m.shape.mark, make)
        for batch in batches:
            if not batch.num_rows:
                continue
            words, codes, n = _encoded(batch.column(2))
            at, rows = np.fromiter(map(index.get, words, repeat(count)), np.int64, len(words)), len(n)
            other = at == count
            o = outputs.take(at, mode="clip")
            o[other] = [own + _bucket(w, m.shape.buckets) for w, x in zip(words, other.tolist()) if x]
            log = np.where(other, 0.0, logs.take(at, mode="clip"))
            # a word in a bucket has its share there; the counts of words that aren't frequent are joined later
            inside = np.where(o >= own, log - m.scale.take(o - own, mode="clip"), 0.0)
            owner = np.repeat(np.arange(rows), n)
            total = lambda x: np.bincount(owner, x.take(codes), rows)
            base, known = total(log), total(~other & ((at > 0) | (m.counts[0] > 0))).astype(np.int64)
            w, real = _stream(o.take(codes), n)
            found = np.zeros(max(0, len(w) - CONTEXT))
            for i in range(0, len(found), PART):
                found[i : i + PART] = log_probabilities(m.shape, m.arrays, w[i : i + PART + CONTEXT])
            score = np.bincount(owner, found[real[CONTEXT:]], rows) / np.log(10) + total(inside)
            some = other.take(codes)
            rare, times = np.unique(owner[some] * len(words) + codes[some], return_counts=True)
            places = pa.array(np.searchsorted(rare // len(words), np.arange(rows + 1)).astype(np.int32))
            spelled = pa.array(words, pa.binary()).take(pa.array(rare % len(words)))
            cells = [pa.array(x) for x in (n, known, base, score)] + [pa.ListArray.from_arrays(places, spelled), pa.ListArray.from_arrays(places, pa.array(times.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cells], ["k", "h", "n", "known", "base", "score", "rare", "times"])

    return df.select("k", "h", "t").mapInArrow(trimmed(run), f"k {kind}, h bigint, n bigint, known bigint, base double, score double, rare array<binary>, times array<bigint>")


def score_texts(df: DataFrame, model: Model, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every whole text.

    counts: the model's word counts. A null or empty text is the end alone. Repeated rows each give a row; other columns are dropped;
    an empty table gives an empty table.
    """
    rows = df.select(F.col(key).alias("k"), utf8_of(text).alias("t")).withColumn("h", F.xxhash64("t"))
    scored = stored(_score(rows, model), "lm-scored")
    rare = scored.filter(F.size("rare") > 0).dropDuplicates(["k", "h"]).select(F.col("k").alias("k2"), F.col("h").alias("h2"), F.inline(F.arrays_zip(F.col("rare").alias("word"), "times")))
    c = F.coalesce(F.col("c"), F.lit(0))
    log = F.round(F.log10(c + SMOOTH) * UNIT).cast("long") * F.col("times")
    joined = rare.join(counts, "word", "left").groupBy("k2", "h2").agg(F.sum(log).alias("log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    both = scored.join(joined, F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")), "left")
    return both.select(
        F.col("k").alias(key), F.col("n").alias("n_tokens"), (F.col("known") + zero("more")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("log") / UNIT - F.col("n") * model.base_scale).alias("base_score"), (F.col("score") + zero("log") / UNIT).alias("score"),
    )


def lm_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of documents(doc_id, text), learned from those whose id's residue isn't 0; null texts are empty."""
    train = docs.filter(id_residue(10) != 0).select(utf8_of("text").alias("t"))
    counts = stored(count_words(train), "lm-counts")
    return score_texts(docs, learn(train, counts), counts).select("doc_id", (id_residue(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
