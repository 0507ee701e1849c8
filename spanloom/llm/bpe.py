"""Byte-level BPE encoding and decoding with a public vocabulary, pre-tokenised by scans instead of a regular expression.

Each code point has a class; with what follows it, that gives a symbol. The pattern of the vocabulary's pre-tokens is a
finite machine over such symbols. A symbol is a function from states to states, and functions compose associatively:
the composed function of every row of a table of symbols is found for all rows at once, a scan over rows gives the state
in which each begins, and the machine then runs through all rows side by side. Pre-tokens are slices of the text's
bytes; pairs are merged once for each distinct slice, for many slices at once, and the outcome is kept.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashed, listed, run_starts, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Slices of more bytes than this are merged one by one, with a heap.
LONG_SLICE = 96
#: Distinct slices that a Python worker keeps; it begins anew beyond, which changes no result.
KEPT = 300_000

LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER, BREAK = range(7)
(Q_LETTER, Q_NUMBER, Q_OTHER, Q_SPACE_MID, Q_SPACE_LAST, Q_BLANK_MID, Q_BLANK_LAST, Q_QUOTE1, Q_QUOTE2, Q_BREAK) = range(10)
CLOSED, LETTERS, NUMBERS, OTHERS, SPACED, BLANKS, ONE_MORE, TWO_MORE = range(8)
WHITE = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def move(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a slice begins here)."""
    if symbol == Q_BREAK:
        return CLOSED, True
    if state in (ONE_MORE, TWO_MORE):
        return (CLOSED if state == ONE_MORE else ONE_MORE), False
    if symbol in (Q_LETTER, Q_NUMBER, Q_OTHER, Q_QUOTE1, Q_QUOTE2):
        own = {Q_LETTER: LETTERS, Q_NUMBER: NUMBERS}.get(symbol, OTHERS)
        if state in (own, SPACED):
            return own, False
        return {Q_QUOTE1: ONE_MORE, Q_QUOTE2: TWO_MORE}.get(symbol, own), True
    if symbol == Q_SPACE_LAST:
        return SPACED, True
    if symbol == Q_BLANK_LAST:
        return CLOSED, True
    return BLANKS, state != BLANKS


@cache
def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(next state, slice begins) by state and symbol; (composition, states) of all functions that symbols compose to: the first ten are the symbols'."""
    steps = [[move(s, q) for q in range(10)] for s in range(8)]
    functions = [tuple(steps[s][q][0] for s in range(8)) for q in range(10)]
    functions.append(tuple(range(8)))
    number: dict[tuple[int, ...], int] = {}
    for i, f in enumerate(functions):
        number.setdefault(f, i)
    at = 0
    while at < len(functions):
        for q in range(10):
            g = tuple(functions[q][s] for s in functions[at])
            if g not in number:
                number[g] = len(functions)
                functions.append(g)
        at += 1
    compose = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions], np.int16)
    return np.array([[x[0] for x in r] for r in steps], np.int8), np.array([[x[1] for x in r] for r in steps]), compose, np.array(functions, np.int8)


def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[list(WHITE)] = BLANK
    table[0x20], table[0x27] = SPACE, QUOTE
    return table


def symbols(cp: np.ndarray, breaks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbols of the code points; breaks: places that part texts."""
    kind = table[cp]
    kind[breaks] = BREAK
    after = np.append(kind[1:], BREAK)
    out = np.array([Q_LETTER, Q_NUMBER, Q_SPACE_MID, Q_BLANK_MID, Q_OTHER, Q_OTHER, Q_BREAK], np.uint8)[kind]
    last = (after != SPACE) & (after != BLANK) & (after != BREAK)
    out[(kind == SPACE) & last] = Q_SPACE_LAST
    out[(kind == BLANK) & last] = Q_BLANK_LAST
    quotes = np.flatnonzero(kind == QUOTE)
    if len(quotes):
        near = np.concatenate([cp, [0, 0]])
        a, b = near[quotes + 1], near[quotes + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[quotes[one]], out[quotes[two]] = Q_QUOTE1, Q_QUOTE2
    return out


def begins(q: np.ndarray, width: int = 256) -> np.ndarray:
    """Whether a slice begins at each symbol."""
    step, starts, compose, functions = machine()
    n = len(q)
    rows = -(-n // width)
    grid = np.full(rows * width, Q_BREAK, np.uint8)
    grid[:n] = q
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    whole = grid[0].astype(np.int16)
    for column in grid[1:]:
        whole = compose[whole, column]
    reach = 1
    while reach < rows:  # inclusive scan over rows
        whole[reach:] = compose[whole[:-reach], whole[reach:]]
        reach *= 2
    state = np.empty(rows, np.int8)
    state[:1] = CLOSED
    state[1:] = functions[whole[:-1], CLOSED]
    out = np.empty(grid.shape, bool)
    for j, column in enumerate(grid):
        out[j] = starts[state, column]
        state = step[state, column]
    return out.T.reshape(-1)[:n]


@dataclass
class Vocabulary:
    tokens: list[bytes]  #: by id, which is the rank
    table: np.ndarray
    pairs: np.ndarray  #: left * 2 ** 32 + right of every two tokens that make a third
    merged: np.ndarray


def load(path: str = VOCABULARY) -> Vocabulary:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    found = [(ranks[t[:k]] << 32 | ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    return Vocabulary(tokens, classes(), np.array([p for p, _ in found], np.uint64), np.array([m for _, m in found], np.int64))


NEVER = 1 << 40


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.single = np.zeros(256, np.int64)
        for i, t in enumerate(vocabulary.tokens):
            if len(t) == 1:
                self.single[t[0]] = i
        self.pair = Hashed(vocabulary.pairs)
        self.merged = np.append(vocabulary.merged, NEVER)
        self.size = np.fromiter(map(len, vocabulary.tokens), np.int64, len(vocabulary.tokens))
        self.bytes = pa.array(vocabulary.tokens, pa.binary())
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.pool = np.zeros(1024, np.int32)
        self.ends = np.zeros(1024, np.int64)  # of the ids of each kept slice, in the pool

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.merged[self.pair.find((left << 32 | right).astype(np.uint64))]

    def merge_one(self, own: bytes) -> list[int]:
        """Least rank first, leftmost of equals, with a heap over a chain of symbols."""
        ids = self.single[np.frombuffer(own, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank(np.array(ids[:-1]), np.array(ids[1:])).tolist() if n > 1 else []
        heap = [(r, i) for i, r in enumerate(rank) if r < NEVER]
        heapq.heapify(heap)
        rank.append(NEVER)
        lookup = lambda a, b: int(self.rank(np.array([a]), np.array([b]))[0])
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            j = after[i]
            ids[i], after[i], ids[j], rank[j] = r, after[j], -1, NEVER
            if after[i] < n:
                before[after[i]] = i
                rank[i] = lookup(ids[i], ids[after[i]])
            else:
                rank[i] = NEVER
            if rank[i] < NEVER:
                heapq.heappush(heap, (rank[i], i))
            if (h := before[i]) >= 0:
                rank[h] = lookup(ids[h], ids[i])
                if rank[h] < NEVER:
                    heapq.heappush(heap, (rank[h], h))
        return [i for i in ids if i >= 0]

    def merge(self, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slices one after another, how many each has): one pair of every slice is merged at a time."""
        size = np.fromiter(map(len, own), np.int64, len(own))
        done: list[tuple[np.ndarray, np.ndarray]] = []  # slice of each id, ids
        short = np.flatnonzero(size <= LONG_SLICE)
        ids = self.single[np.frombuffer(b"".join(own[i] for i in short), np.uint8)]
        of = np.repeat(short, size[short])
        for i in np.flatnonzero(size > LONG_SLICE).tolist():
            got = np.array(self.merge_one(own[i]))
            done.append((np.full(len(got), i), got))
        rank = np.full(len(ids), NEVER)
        same = np.flatnonzero(of[1:] == of[:-1])
        rank[same] = self.rank(ids[same], ids[same + 1])
        while len(ids):
            starts = run_starts(of)
            least = np.minimum.reduceat(rank, starts)
            width = np.diff(np.append(starts, len(of)))
            over = np.repeat(least == NEVER, width)
            done.append((of[over], ids[over]))
            ids, of, rank = ids[~over], of[~over], rank[~over]
            if not len(ids):
                break
            go = least < NEVER
            least, width = least[go], width[go]
            at = np.flatnonzero(rank == np.repeat(least, width))
            at = at[run_starts(of[at])]
            ids[at] = rank[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # places after the removal of one symbol for each merge before
            ids, of, rank = ids[keep], of[keep], rank[keep]
            for here in (moved, moved[moved > 0] - 1):
                joined = here[(here + 1 < len(ids))]
                joined = joined[of[joined + 1] == of[joined]]
                rank[here] = np.where(np.isin(here, joined), rank[here], NEVER) if len(joined) < len(here) else rank[here]
                rank[joined] = self.rank(ids[joined], ids[joined + 1])
        order = np.argsort(np.concatenate([d[0] for d in done] or [np.zeros(0, np.int64)]), kind="stable")
        every = np.concatenate([d[1] for d in done] or [np.zeros(0, np.int64)])[order]
        return every, np.bincount(np.concatenate([d[0] for d in done] or [np.zeros(0, np.int64)]), minlength=len(own))

    def lookup(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) in the pool of each slice's ids."""
        if len(self.place) > KEPT:
            self.clear()
        new = [x for x in distinct if x not in self.place]
        if new:
            lo = len(self.place)
            self.place.update(zip(new, range(lo, lo + len(new))))
            ids, n = self.merge(new)
            begin = self.ends[lo]
            for name, need in (("pool", begin + len(ids) + 1), ("ends", len(self.place) + 1)):
                held = getattr(self, name)
                if need > len(held):
                    grown = np.zeros(max(need, 2 * len(held)), held.dtype)
                    grown[: len(held)] = held
                    setattr(self, name, grown)
            self.pool[begin : begin + len(ids)] = ids
            self.ends[lo + 1 : lo + 1 + len(new)] = begin + np.cumsum(n)
        at = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        return self.ends[at], self.ends[at + 1]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, byte where each token begins in its text, offsets of each text's tokens, bytes of the texts)."""
        own = [t or "" for t in texts.to_pylist()]
        joined = "\n".join([*own, ""])
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        breaks = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        start = np.flatnonzero(begins(symbols(cp, breaks, self.v.table)))
        size = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
        byte = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        data = joined.encode()
        cuts = byte[np.append(start, len(cp))].astype(np.int32)
        slices_ = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data)])
        enc = slices_.dictionary_encode()
        lo, hi = self.lookup(listed(enc.dictionary))
        part = np.searchsorted(start, breaks)  # the slices that part texts
        code = np.asarray(enc.indices).astype(np.int64)
        n = (hi - lo)[code]
        n[part] = 0
        from_ = lo[code]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(from_, n)
        ids = self.pool[place]
        offsets = np.concatenate([[0], np.cumsum(n)[part]])
        ends = np.cumsum(self.size[ids])
        begin = ends - self.size[ids]
        has = np.diff(offsets)
        begin -= np.repeat(np.where(has > 0, np.append(begin, 0)[np.minimum(offsets[:-1], len(begin))], 0), has)
        return ids, begin.astype(np.int32), offsets, np.frombuffer(data, np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after another."""
        taken = self.bytes.take(pa.array(ids))
        return np.frombuffer(taken.buffers()[2], np.uint8, int(self.size[ids].sum())) if len(ids) else np.zeros(0, np.uint8)


_encoders: dict[str, Encoder] = {}


def _shared(spark, path: str):
    """A function that gives the Encoder in a Python worker; only the driver reads the file."""
    shared = spark.sparkContext.broadcast(load(path))
    tag = f"{spark.sparkContext.applicationId}:{shared._jbroadcast.id()}"

    def get() -> Encoder:
        if tag not in _encoders:
            _encoders.clear()
            _encoders[tag] = Encoder(shared.value)
        return _encoders[tag]

    return get


def _lists(values: np.ndarray, offsets: np.ndarray, null: pa.Array) -> pa.Array:
    kept = pa.array(np.append(offsets[:-1], offsets[-1]).astype(np.int32), mask=np.append(np.asarray(null), False))
    return pa.ListArray.from_arrays(kept, pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids, token_begins, n_tokens, round_trip) for each row.

    token_begins are the bytes at which the tokens begin in the text's UTF-8. round_trip says whether decoding the ids
    gives the text again, byte by byte. A null text has null in all columns but doc_id; an empty one has no tokens.
    Rows are independent: repeated ones, those with a null doc_id and texts of any length are encoded like others.
    """
    get = _shared(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo)
                ids, begin, offsets, data = encoder.encode(texts)
                size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
                parted = np.cumsum(size + 1) - 1
                source = np.delete(data, parted)
                back = encoder.decode(ids)
                got = np.diff(np.concatenate([[0], np.cumsum(encoder.size[ids])])[offsets])
                if len(back) == len(source) and (got == size).all() and (back == source).all():
                    same = np.ones(hi - lo, bool)
                else:
                    a, b = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(got)])
                    same = np.array([np.array_equal(source[a[i] : a[i + 1]], back[b[i] : b[i + 1]]) for i in range(hi - lo)])
                null = texts.is_null()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), _lists(ids, offsets, null), _lists(begin, offsets, null), pa.array(np.diff(offsets).astype(np.int32), mask=np.asarray(null)), pa.array(same, mask=np.asarray(null))],
                    ["doc_id", "token_ids", "token_begins", "n_tokens", "round_trip"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, token_ids array<int>, token_begins array<int>, n_tokens int, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, token_ids). Null ids give null text; bytes that aren't UTF-8 give the replacement character; an id outside the vocabulary is an error."""
    get = _shared(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for batch in batches:
            own = batch.column(1)
            ids = np.asarray(own.flatten()).astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(encoder.size)):
                raise ValueError("a token id is outside the vocabulary")
            n = np.asarray(pc.fill_null(pc.list_value_length(own), 0)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(encoder.size[ids])])[np.concatenate([[0], np.cumsum(n)])]
            data = encoder.decode(ids).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if null else data[a:b].decode(errors="replace") for null, a, b in zip(own.is_null().to_pylist(), ends[:-1].tolist(), ends[1:].tolist())], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids")).mapInArrow(run, "doc_id long, text string")
