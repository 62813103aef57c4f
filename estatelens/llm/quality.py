"""Quality scores by histogram gradient-boosted trees over document statistics.

Training bins each statistic by quantiles and grows trees of fixed depth level by level from histograms of gradients.
The trees are kept as flat arrays, so that scoring walks all rows down all trees with a few numpy steps a level.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_residue, small_batches, trimmed, utf8_of

#: Labelled rows that training uses at most: those with the smallest hashes of their ids.
MAX_LABELLED = 20_000
BINS, DEPTH, TREES, RATE, LEAST_HESSIAN, RIDGE = 64, 4, 150, 0.1, 4.0, 1.0
THRESHOLD = 0.3
FEATURES = (
    "bytes", "words", "word_length", "upper", "digits", "marks", "symbols", "bangs", "bars", "white", "lines_by_byte", "distinct_words", "top_word", "repeated_neighbours",
    "repeated_lines", "line_length", "ended_lines", "wordless", "short_words", "longest_word", "entropy", "marked_words", "sentence_ends", "high_bytes",
)
_UPPER, _LOWER, _DIGIT = np.zeros((3, 256), bool)
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_WHITE, _HIGH = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]), np.arange(256) >= 128
_MARK = ~(_UPPER | _LOWER | _DIGIT | _WHITE | _HIGH) & (np.arange(256) > 32)
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*@^~<>{}[]\\/=+_"))
_ENDS = (b".", b"!", b"?", b":", b";", b'"')


def statistics(text: bytes) -> list[float]:
    """The FEATURES of a text given as UTF-8; of an empty text all are 0."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    if not words:
        return [np.log1p(n), *[0.0] * (len(FEATURES) - 1)]
    k, lines = len(words), [x for x in text.split(b"\n") if x]
    share = lambda mask: counts[mask].sum() / n
    p = counts[counts > 0] / n
    by_word = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, k)
    letters = share(_UPPER) + share(_LOWER)
    marked = sum(not w[-2:].isalnum() and w[-1] in b"#$%&*!|@^~=" for w in words)
    return [
        np.log1p(n), np.log1p(k), lengths.mean(), share(_UPPER) / letters if letters else 0.0, share(_DIGIT), share(_MARK), share(_SYMBOL), counts[33] / n, counts[124] / n, share(_WHITE), counts[10] / n, len(by_word) / k,
        max(by_word.values()) / k, sum(a == b for a, b in zip(words, words[1:])) / k, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(x.rstrip().endswith(_ENDS) for x in lines) / len(lines), sum(not any(c >= 128 or _UPPER[c] or _LOWER[c] for c in w) for w in words if len(w) < 3) / k,
        (lengths <= 3).mean(), np.log1p(lengths.max()), float(-(p * np.log2(p)).sum()), marked / k, (counts[46] + counts[63]) / k, share(_HIGH),
    ]


class Trees:
    """Boosted trees of one depth: feature and threshold of each inner node, value of each leaf, tree by tree."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray) -> None:
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row."""
        n, trees = len(x), len(self.leaf)
        if not trees:
            return np.full(n, 1 / (1 + np.exp(-self.base)))
        node, row = np.zeros((n, trees), np.int64), np.arange(n)[:, None]
        offset = np.arange(trees) * self.feature.shape[1]
        feature, threshold = self.feature.ravel(), self.threshold.ravel()
        for _ in range(DEPTH):
            at = offset + node
            node = 2 * node + 1 + (x[row, feature[at]] > threshold[at])
        leaf = self.leaf.ravel()[np.arange(trees) * self.leaf.shape[1] + node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-(self.base + leaf.sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Fits trees to 0/1 labels. Without rows, or with one label only, the score is a constant."""
    inner = 2**DEPTH - 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    n_features, cells = x.shape[1], np.arange(x.shape[1]) * BINS
    raw = np.full(len(y), base)
    feature, threshold, leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (n_features * BINS) + cells + binned).ravel()
            shape = (width, n_features, BINS)
            g = np.bincount(at, np.repeat(grad, n_features), width * n_features * BINS).reshape(shape).cumsum(axis=2)
            h = np.bincount(at, np.repeat(hess, n_features), width * n_features * BINS).reshape(shape).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(h < LEAST_HESSIAN) | (h_all - h < LEAST_HESSIAN)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i, b in enumerate(best):
                j, cut = divmod(int(b), BINS)
                if gain[i, j, cut] > 1e-9 and cut < len(edges[j]):
                    f[first + i], t[first + i] = j, edges[j][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        at = node - inner
        values = RATE * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + RIDGE)
        raw += values[at]
        feature.append(f), threshold.append(t), leaf.append(values)
    return Trees(base, np.array(feature), np.array(threshold), np.array(leaf))


def features(df: DataFrame, keep: str, text: str = "text") -> DataFrame:
    """Columns keep and features (array of doubles in the order of FEATURES) of every whole text; null counts as empty."""
    small_batches(df.sparkSession)
    df = df.select(F.col(keep).alias("k"), utf8_of(text).alias("t"))

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["k", "features"])

    return df.mapInArrow(trimmed(run), f"k {df.schema['k'].dataType.simpleString()}, features array<double>").withColumnRenamed("k", keep)


def learn_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_LABELLED, key: str = "doc_id", text: str = "text") -> Trees:
    """Trees fitted to at most max_rows labelled documents, those with the smallest hashes of their ids.

    Rows with a null id or a label other than 0 and 1 don't count; a null text counts as empty; repeated rows of docs each count,
    of repeated rows of labels one does. Other columns of either table, whatever their names, play no part. Without labelled
    rows the score is a constant.
    """
    some = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).distinct()
    some = F.broadcast(some.orderBy(F.xxhash64("k"), "k", "y").limit(max_rows))
    joined = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(some, "k").select(F.struct(F.xxhash64("k").alias("h"), "k", "y").alias("r"), "text")
    got = features(joined, "r").orderBy("r").limit(max_rows).select("r.y", "features").collect()
    x = np.array([r.features for r in got]).reshape(-1, len(FEATURES))
    return train(x, np.array([r.y for r in got], np.float64))


def score_quality(df: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key and score of every whole text; null counts as empty, repeated rows stay."""
    small_batches(df.sparkSession)
    df = df.select(F.col(key).alias("k"), utf8_of(text).alias("t"))

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(x))], ["k", "score"])

    return df.mapInArrow(trimmed(run), f"k {df.schema['k'].dataType.simpleString()}, score double").withColumnRenamed("k", key)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest columns of documents(doc_id, text), learned from labels of documents whose id's residue isn't 0.

    Null and empty texts are scored like any other; repeated rows each give a row.
    """
    trees = learn_quality(docs.filter(id_residue(5) != 0), labels.filter(id_residue(5) != 0))
    scored = score_quality(docs, trees)
    return scored.select("doc_id", (id_residue(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
