"""Token counts by compiled finite-state transducers.

Two deterministic transducers are compiled from the tokenizer's file; the tokenizer library takes no part.

The splitter reads pairs of character classes (a character's and the next one's); its transitions say whether a piece begins
there. A batch's texts are one row of symbols, cut into chunks: each chunk's map from start state to end state is run for all states at once, the
maps compose through a parallel prefix scan, and a last run from the true start states emits the cuts.

The counter reads a piece's bytes; each transition carries the number of tokens by which the count changes (0, 1 or less than 0), so the
emitted numbers add up to the piece's count. It rests on this: merges are made one at a time, the earliest in the list first
and of these the leftmost. A sequence of tokens that each encode themselves is an encoding if and only if each two
neighbours are. (If all neighbours are and some merge crosses a border, look at the first that does: until then both its
tokens were merged as they are alone, so it would cross in the two alone as well. The other way, a merge across a border of two alone
would come in the sequence too.) So each prefix has one last token: the one that ends there and may follow the last token of the prefix
before it. A state holds, for each place where a token of the next bytes may have begun, its node in the tokens' trie,
the last token before it and the count there, relative to the count now. States and transitions are made on demand, as the subset construction
does, and looked up in a hash table for all pieces of a batch at once. A piece begins in the start state, so the maps of pieces
need no composition.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trimmed, utf8_of

CHUNK = 512
#: States kept by the counter; beyond that it starts anew with the next batch, which changes no result.
MAX_STATES = 400_000
#: Pieces still unread from which on they are read one after the other.
FEW = 8

# Character classes.
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE, END = range(7)
#: Letters that contractions are made of have classes of their own.
MARKED = {c: 7 + i for i, c in enumerate("stmdrvel")}
N_CLASSES = 7 + len(MARKED)
# States: what the last character was a part of.
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_BLANK, AT_QUOTE, IN_TAIL, AFTER_TAIL = range(9)
N_STATES = 9
#: Contraction endings of the splitting rule.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Unicode white space.
WHITE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point; the one past the last code point ends a text."""
    table = np.zeros(sys.maxunicode + 2, np.uint8)
    for kind, value in (("L", LETTER), ("N", NUMBER)):
        table[[i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == kind]] = value
    table[WHITE] = BLANK
    table[0x20], table[0x27], table[-1] = SPACE, QUOTE, END
    for c, k in MARKED.items():
        table[ord(c)] = k
    return table


@lru_cache(1)
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, cut before this character) by [class * N_CLASSES + next class, state]."""
    mark = {k: c for c, k in MARKED.items()}
    to, cut = np.zeros((N_CLASSES**2, N_STATES), np.uint8), np.zeros((N_CLASSES**2, N_STATES), bool)
    white = (SPACE, BLANK)
    for c in range(N_CLASSES):
        kind = LETTER if c in mark else OTHER if c == QUOTE else c
        for ahead in range(N_CLASSES):
            i = c * N_CLASSES + ahead
            for s in range(N_STATES):
                if c == END:
                    to[i, s], cut[i, s] = BEGIN, True
                elif kind in white:
                    to[i, s] = AFTER_SPACE if c == SPACE else AFTER_BLANK
                    cut[i, s] = ahead not in (*white, END) if s in (AFTER_SPACE, AFTER_BLANK) else True
                elif s == AT_QUOTE and mark.get(c) in ENDINGS:
                    to[i, s] = AFTER_TAIL
                elif s == AT_QUOTE and c in mark and mark[c] + mark.get(ahead, "") in ENDINGS:
                    to[i, s] = IN_TAIL
                elif s == IN_TAIL:
                    to[i, s] = AFTER_TAIL
                else:
                    own = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}[kind]
                    joined = s == AFTER_SPACE or s == own or (s == AT_QUOTE and own == IN_OTHER)
                    to[i, s], cut[i, s] = (AT_QUOTE if c == QUOTE and not joined else own), not joined
    return to, cut


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (row after row), in log2(rows) rounds."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return maps


def cuts(points: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions in points where a piece begins. Each text in points ends with the code point past the last."""
    to, cut = transducer()
    kinds = classes()[points].astype(np.uint16)
    rows = -(-len(kinds) // chunk)
    symbols = np.full(rows * chunk, END * N_CLASSES + END, np.uint16)
    symbols[: len(kinds)] = kinds * N_CLASSES + np.append(kinds[1:], END)
    symbols = np.ascontiguousarray(symbols.reshape(rows, chunk).T)
    flat = to.ravel()
    maps = np.tile(np.arange(N_STATES, dtype=np.int32), (rows, 1))
    for column in symbols:
        maps = flat.take(column.astype(np.int32)[:, None] * N_STATES + maps).astype(np.int32)
    state = np.concatenate(([BEGIN], compose_scan(maps)[:-1, BEGIN])).astype(np.int32)
    marks, flat_cut = np.empty(symbols.shape, bool), cut.ravel()
    for j, column in enumerate(symbols):
        at = column.astype(np.int32) * N_STATES + state
        marks[j], state = flat_cut.take(at), flat.take(at).astype(np.int32)
    return np.flatnonzero(marks.T.ravel()[: len(kinds)])


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the tokenizer's file: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """The merge list compiled: tokens are numbered by bytes, then by merges in order; a trie of those that encode themselves."""

    def __init__(self, merges: list[tuple[bytes, bytes]]) -> None:
        ids = {bytes([b]): b for b in range(256)}
        self.left, self.right, self.rank = [-1] * 256, [-1] * 256, {}
        for x, y in merges:
            if x not in ids or y not in ids or x + y in ids:
                raise ValueError("each merge has to make a new token of two that were made before")
            self.rank[ids[x], ids[y]] = len(self.left)
            self.left.append(ids[x]), self.right.append(ids[y])
            ids[x + y] = len(ids)
        if max(map(len, ids)) > 128:
            raise ValueError("tokens of more than 128 bytes")
        self.follows: dict[tuple[int, int], bool] = {}
        sound = [True] * len(self.left)
        for t in range(256, len(self.left)):
            x, y = self.left[t], self.right[t]
            sound[t] = sound[x] and sound[y] and not self._crossed(x, y, True)
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for word, t in ids.items():
            if sound[t]:
                node = 0
                for b in word:
                    at = self.child.get(node << 8 | b)
                    if at is None:
                        at = self.child[node << 8 | b] = len(self.token)
                        self.token.append(-1), self.inner.append(False)
                        self.inner[node] = True
                    node = at
                self.token[node] = t

    def _crossed(self, x: int, y: int, own: bool = False) -> bool:
        """Whether a merge crosses the border of x and y before both are whole (own) or at all.

        The border's two symbols are followed back in time; a merge of them comes first if it is earlier than what either
        went into, or as early as what the right one went into, which lies further right.
        """
        never = len(self.left)
        x_goes = y_goes = never
        while True:
            r = self.rank.get((x, y))
            if r is not None and r < x_goes and r <= y_goes and not (own and x_goes == y_goes == never):
                return True
            if x < 256 and y < 256:
                return False
            if x > y:
                x_goes, x = x, self.right[x]
            else:
                y_goes, y = y, self.left[y]

    def may_follow(self, x: int, y: int) -> bool:
        """Whether y may stand after x in an encoding."""
        known = self.follows.get((x, y))
        if known is None:
            if len(self.follows) > 1 << 20:
                self.follows.clear()
            known = self.follows[x, y] = not self._crossed(x, y)
        return known


def _place(node: int, last: int, count: int) -> int:
    """A place of a state in one number: the trie's node, the last token before (-1: none) and the relative count, which stays far below 128."""
    return node << 32 | (last + 1) << 8 | count + 128


class Counter:
    """The counting transducer: states made on demand, transitions in an open hash table of (state, byte) to (state, emitted count)."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        first = (_place(0, -1, 0),)
        self.states, self.ids = [first], {first: 0}
        self.keys, self.values, self.used = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int64), 0

    def compile(self, key: int) -> int:
        """The value of the transition with this key: next state << 16 | emitted count + 2**15."""
        m, b, live, found = self.merges, key & 255, [], None
        for place in self.states[key >> 8]:
            at = m.child.get(place >> 32 << 8 | b)
            if at is None:
                continue
            t = m.token[at]
            if found is None and t >= 0 and (not place & 0xFFFF00 or m.may_follow((place >> 8 & 0xFFFFFF) - 1, t)):
                found, emitted = t, (place & 255) - 127
            if m.inner[at]:
                live.append(at << 32 | place & 0xFFFFFFFF)
        state = (*(place - emitted for place in live), _place(0, found, 0))
        n = self.ids.setdefault(state, len(self.states))
        if n == len(self.states):
            self.states.append(state)
        return n << 16 | emitted + (1 << 15)

    @staticmethod
    def _slot(keys, mask: int):
        return (keys * -7046029254386353131 >> 20) & mask

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        if self.used + len(keys) > len(self.keys) // 2:
            old = self.keys >= 0
            keys, values = np.append(self.keys[old], keys), np.append(self.values[old], values)
            size = 1 << int(len(keys) * 4 - 1).bit_length()
            self.keys, self.values, self.used = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0
        self.used += len(keys)
        with np.errstate(over="ignore"):
            at = self._slot(keys, len(self.keys) - 1)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]  # of several at one slot the last stays
            lost = np.flatnonzero(self.keys[at] != keys)
            keys, values, at = keys[lost], values[lost], (at[lost] + 1) & (len(self.keys) - 1)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The transitions' values; missing ones are compiled."""
        with np.errstate(over="ignore"):
            at = self._slot(keys, len(self.keys) - 1)
        got = self.keys[at]
        out = self.values[at]
        wrong = np.flatnonzero(got != keys)
        while len(wrong):
            gone = got[wrong] < 0
            if gone.any():
                made = np.unique(keys[wrong[gone]])
                self._put(made, np.array([self.compile(k) for k in made.tolist()], np.int64))
                out[wrong] = self.look_up(keys[wrong])
                return out
            at[wrong] = (at[wrong] + 1) & (len(self.keys) - 1)
            got[wrong], out[wrong] = self.keys[at[wrong]], self.values[at[wrong]]
            wrong = wrong[got[wrong] != keys[wrong]]
        return out

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The token counts of pieces of data (bytes): all pieces are read together, a byte at a time."""
        if len(self.states) > MAX_STATES:
            self.clear()
        order = np.argsort(-lengths, kind="stable")
        at, upto = starts[order].astype(np.int64), np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0)) + 1), side="left")
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for j in range(len(upto) - 1):
            n = int(upto[j])  # pieces of more than j bytes
            if n <= FEW:
                for i in range(n):
                    state[i], more = self._read(int(state[i]), data[at[i] + j : at[i] + int(lengths[order[i]])].tolist())
                    total[i] += more
                break
            value = self.look_up(state[:n] << 8 | data[at[:n] + j])
            np.right_shift(value, 16, out=state[:n])
            value &= 0xFFFF
            total[:n] += value
            total[:n] -= 1 << 15
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out

    def _read(self, state: int, data: list[int]) -> tuple[int, int]:
        """The end state and the count of one piece's rest."""
        known, total = {}, 0
        for b in data:
            key = state << 8 | b
            value = known.get(key)
            if value is None:
                value = known[key] = int(self.look_up(np.array([key], np.int64))[0])
                if len(known) > 1 << 16:
                    known.clear()
            state, total = value >> 16, total + (value & 0xFFFF) - (1 << 15)
        return state, total


class TokenCounter:
    """Counts tokens of texts with one byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        letters = _byte_letters()
        spelled = lambda x: bytes(letters[c] for c in x)
        merges = (m if isinstance(m, list) else m.split(" ") for m in made["model"]["merges"])
        self.special = [t["content"] for t in made.get("added_tokens", [])]
        self.counter = Counter(Merges([(spelled(x), spelled(y)) for x, y in merges]))

    def counts(self, texts: list[str]) -> np.ndarray:
        """The token count of each text."""
        parts, owner, total = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = [text]
            for mark in self.special:
                if mark in text:
                    pieces = [y for x in pieces for y in x.split(mark)]
            total[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        if not parts:
            return total
        joined = "\0".join(parts) + "\0"
        ends = np.cumsum([len(x) + 1 for x in parts]) - 1
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        places = np.append(0, np.cumsum(widths))
        points[ends] = sys.maxunicode + 1
        at = cuts(points)
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        starts = places[at]
        lengths = np.diff(np.append(starts, len(data)))
        lengths[np.searchsorted(at, ends)] = 0  # the end of a text emits nothing
        sums = np.append(0, np.cumsum(self.counter.counts(data, starts, lengths)))
        by_part = sums[np.searchsorted(at, ends)] - sums[np.searchsorted(at, np.append(0, ends[:-1] + 1))]
        np.add.at(total, owner, by_part)
        return total


@lru_cache(2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(df: DataFrame, tokenizer: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, n_bytes, n_tokens, over_limit of every whole text.

    A null text counts as empty: 0 bytes and 0 tokens. Repeated rows each give a row, an empty table none; other
    columns are dropped. tokenizer: the path of a byte-level tokenizer file, the same on all executors.
    """
    small_batches(df.sparkSession)
    df = df.select(F.col(key).alias("k"), utf8_of(text).alias("t"))
    kind = df.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = _counter(tokenizer).counts([x.decode("utf-8", "replace") for x in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["k", "n_bytes", "n_tokens", "over_limit"])

    return df.mapInArrow(trimmed(run), f"k {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("k", key)
