"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Every training text is cut into windows of twice the longest item's words, one such length apart, so that some window
holds any passage as long as an item whole. A window is a query; an item's score is divided by the score that its own
words would get, so that a window with all of them has 1. All items at or above the threshold are retrieved, and stay
if the window repeats enough word trigrams of the item's question and of its answer. Of a part with fewer than SHORT words
single words count, and then trigrams of the item as a whole too. An item of fewer than SHORT words in all is no evidence
within a text: it is found where a text consists of it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashed, plain, run_starts, slices, words

K1, B = 1.2, 0.75
THRESHOLD, MIN_QUESTION, MIN_ANSWER = 0.6, 0.5, 0.5
BLOCK = 8
#: Items of one broadcast index. A larger benchmark has several, each searched with every window.
SHARD_ITEMS = 100_000
NGRAM, SHORT = 3, 6
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def tokens(text: str) -> list[str]:
    of, forms = plain(words(pa.array([text]))[2])
    codes = words(pa.array([text]))[0]
    return [forms[i] for i in of[codes] if i >= 0]


def parts(text: str) -> tuple[list[str], list[str]]:
    """(question, answer): the answer is the last sentence, or the last third of a single one."""
    sentences = [t for t in map(tokens, SENTENCE.split(text.strip())) if t]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    own = sentences[0] if sentences else []
    cut = len(own) - max(1, len(own) // 3) if len(own) > 1 else 0
    return own[:cut], own[cut:]


def ngrams(own: list[str], n: int = NGRAM) -> set[tuple[str, ...]]:
    n = min(n, len(own))
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()


def overlap(own: list[str], passage: list[str], n: int = NGRAM) -> float:
    """The share of the n-grams of own in passage; a part without words is there in any."""
    mine = ngrams(own, n)
    return len(mine & ngrams(passage, min(n, len(own)))) / len(mine) if mine else 1.0


def overlaps(question: list[str], answer: list[str], passage: list[str], text: list[str] | None) -> tuple[float, float, float]:
    """(question, answer, the lesser share that the item as a whole must reach) in a passage; text: the words of the whole text if it has no others."""
    if len(question) + len(answer) < SHORT:
        same = float(text == question + answer)
        return same, same, same
    q, a = (overlap(x, passage, 1 if len(x) < SHORT else NGRAM) for x in (question, answer))
    return q, a, overlap(question + answer, passage) if min(len(question), len(answer)) < SHORT else 1.0


@dataclass
class Index:
    """Postings by term, each list cut into blocks of BLOCK neighbouring items; a block keeps its greatest impact."""

    item_ids: list[int]
    question: list[list[str]]
    answer: list[list[str]]
    longest: int
    terms: dict[str, int]
    tops: np.ndarray  #: greatest impact of each term
    block_of: np.ndarray  #: number of each block of each term, term by term
    block_tops: np.ndarray
    term_blocks: np.ndarray  #: where each term's blocks begin
    block_postings: np.ndarray  #: where each block's postings begin
    items: np.ndarray
    impacts: np.ndarray


def build(items: Iterable[tuple[int, str]], shard: int = SHARD_ITEMS) -> Iterator[Index]:
    """Indexes of at most shard items each, one at a time, with the statistics of all: items are iterated over twice.

    An item without an id or a word is left out, a repeated one too.
    """

    def rows() -> Iterator[tuple[int, list[str], list[str]]]:
        seen = set()
        for i, text in items:
            if i is None or text is None or (key := xxhash.xxh3_128_intdigest(f"{i} {text}")) in seen:
                continue
            seen.add(key)
            q, a = parts(text)
            if q or a:
                yield i, q, a

    df: Counter[str] = Counter()
    many, total, longest = 0, 0, 1
    for _, q, a in rows():
        df.update({*q, *a})
        many, total, longest = many + 1, total + len(q) + len(a), max(longest, len(q) + len(a))
    left = rows()
    while own := list(islice(left, shard)):
        terms: dict[str, int] = {}
        entries = []
        for at, (_, q, a) in enumerate(own):
            impact = {t: math.log(1 + (many - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * (len(q) + len(a)) * many / total)) for t, n in Counter(q + a).items()}
            whole = sum(impact.values())
            entries += [(terms.setdefault(t, len(terms)), at, x / whole) for t, x in impact.items()]
        entries.sort()
        term, item, impact = (np.array(x) for x in zip(*entries))
        starts = run_starts(term, item // BLOCK)
        begin = np.searchsorted(term[starts], np.arange(len(terms) + 1))
        tops = np.maximum.reduceat(impact, starts)
        yield Index([r[0] for r in own], [r[1] for r in own], [r[2] for r in own], longest, terms, np.maximum.reduceat(tops, begin[:-1]), item[starts] // BLOCK, tops, begin, np.append(starts, len(term)), item, impact)


class Items:
    """The items of a benchmark table, read anew for each iteration, a partition at a time."""

    def __init__(self, benchmark: DataFrame):
        self.rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")

    def __iter__(self) -> Iterator[tuple[int, str]]:
        return map(tuple, self.rows.toLocalIterator())


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) for every value of the ranges lo[i]..hi[i]-1, one after another."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class Searcher:
    def __init__(self, index: Index, threshold: float, min_question: float, min_answer: float):
        self.index, self.threshold, self.least = index, threshold, (min_question, min_answer)
        self.width, self.step = 2 * index.longest, index.longest
        self.blocks = -(-len(index.item_ids) // BLOCK)
        self.key = Hashed((np.repeat(np.arange(len(index.tops)), np.diff(index.term_blocks)) * self.blocks + index.block_of).astype(np.uint64))

    def retrieve(self, window: np.ndarray, term: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, score) at or above the threshold, of count windows with their distinct terms, sorted by window.

        Block-max WAND, all windows side by side. Of a window's terms from the least greatest impact up, those
        before the pivot can't reach the threshold among themselves: only blocks of the others are candidates. A
        candidate block is opened if the greatest impacts there, of all the window's terms, reach the threshold.
        """
        ix, least = self.index, self.threshold - 1e-9
        order = np.lexsort((ix.tops[term], window))
        window, term = window[order], term[order]
        ends = np.searchsorted(window, np.arange(count + 1))
        run = np.cumsum(ix.tops[term])
        run -= np.concatenate([[0.0], run])[ends[window]]
        past = np.flatnonzero(run >= least)
        which, at = ranges(ix.term_blocks[term[past]], ix.term_blocks[term[past] + 1])
        candidate = np.sort(window[past[which]] * self.blocks + ix.block_of[at])
        candidate = candidate[run_starts(candidate)]
        w, block = candidate // self.blocks, candidate % self.blocks
        which, at = ranges(ends[w], ends[w + 1])
        place = self.key.find((term[at] * self.blocks + block[which]).astype(np.uint64))
        which, place = which[place >= 0], place[place >= 0]
        opened = np.bincount(which, ix.block_tops[place], len(candidate)) >= least
        which, place = which[opened[which]], place[opened[which]]
        part, at = ranges(ix.block_postings[place], ix.block_postings[place + 1])
        score = np.bincount(which[part] * BLOCK + ix.items[at] % BLOCK, ix.impacts[at], len(candidate) * BLOCK)
        hit = np.flatnonzero(score >= least)
        return w[hit // BLOCK], block[hit // BLOCK] * BLOCK + hit % BLOCK, score[hit]

    def search(self, texts: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of the best window for each row and item."""
        codes, offsets, distinct = words(texts)
        of, forms = plain(distinct)
        term = np.array([*(self.index.terms.get(f, -1) for f in forms), -1], np.int64)[of] if len(distinct) else np.zeros(0, np.int64)
        known = of[codes] >= 0
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[known]
        form, code = of[codes][known], term[codes][known]
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))])
        n = np.diff(ends)
        windows = np.where(n > 0, 1 + np.maximum(0, -(-(n - self.width) // self.step)), 0)
        row = np.repeat(np.arange(len(n)), windows)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        lo = ends[row] + nth * self.step
        hi = np.minimum(lo + self.width, ends[row + 1])
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for first in range(0, len(row), 1000):
            some = slice(first, first + 1000)
            which, at = ranges(lo[some], hi[some])
            key = np.sort((which[code[at] >= 0] << 32) | code[at][code[at] >= 0])
            key = key[run_starts(key)]
            passage, before = [], -1
            for w, item, score in zip(*(x.tolist() for x in self.retrieve(key >> 32, key & 0xFFFFFFFF, len(lo[some])))):
                if w != before:
                    passage, before = [forms[i] for i in form[lo[first + w] : hi[first + w]].tolist()], w
                q, a, both = overlaps(self.index.question[item], self.index.answer[item], passage, passage if windows[row[first + w]] == 1 else None)
                if q >= self.least[0] and a >= self.least[1] and both >= min(self.least):
                    k = (int(row[first + w]), item)
                    best[k] = max(best.get(k, (0.0, 0.0, 0.0)), (score, q, a))
        return [(*k, *v) for k, v in sorted(best.items())]


_searchers: dict[str, Searcher] = {}


def _shards(docs: DataFrame, benchmark: DataFrame, threshold: float, min_question: float, min_answer: float):
    """For each index, a function that gives the Searcher in a Python worker. The driver holds one index at a time, and the number of items of each term."""
    spark = docs.sparkSession
    for index in build(Items(benchmark)):
        shared = spark.sparkContext.broadcast(index)
        tag = f"{spark.sparkContext.applicationId}:{shared._jbroadcast.id()}:{threshold}:{min_question}:{min_answer}"

        def get(shared=shared, tag=tag) -> Searcher:
            if tag not in _searchers:
                while len(_searchers) > 4:
                    _searchers.pop(next(iter(_searchers)))
                _searchers[tag] = Searcher(shared.value, threshold, min_question, min_answer)
            return _searchers[tag]

        yield get


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_question: float = MIN_QUESTION, min_answer: float = MIN_ANSWER) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each document and item that it repeats.

    The best window counts, by score, then overlaps. Null and empty texts hold no item; a row with a null doc_id is
    reported with it; repeated rows are, each. Items without an id or a word are left out, the same item given
    twice counts once, one of fewer than SHORT words is found in texts that consist of it alone, an empty benchmark finds
    nothing. Texts are searched whole, other columns aren't read.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = own.sparkSession.createDataFrame([], schema)
    for get in _shards(docs, benchmark, threshold, min_question, min_answer):

        def run(batches: Iterator[pa.RecordBatch], get=get) -> Iterator[pa.RecordBatch]:
            searcher = get()
            for batch in batches:
                for lo, hi in slices(batch.column(1)):
                    rows = searcher.search(batch.column(1).slice(lo, hi - lo))
                    if rows:
                        at, item, *scores = zip(*rows)
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(at)), pa.array([searcher.index.item_ids[i] for i in item], pa.int64()), *map(pa.array, scores)], schema.replace(" long", "").replace(" double", "").split(", "))

        found = found.union(own.mapInArrow(run, schema))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_question: float = MIN_QUESTION, min_answer: float = MIN_ANSWER) -> DataFrame:
    """The documents that repeat no item, all columns as they are, in one pass over them for each index."""
    at, schema = docs.columns.index("text"), docs.schema
    for get in _shards(docs, benchmark, threshold, min_question, min_answer):

        def run(batches: Iterator[pa.RecordBatch], get=get) -> Iterator[pa.RecordBatch]:
            searcher = get()
            for batch in batches:
                for lo, hi in slices(batch.column(at)):
                    keep = np.ones(hi - lo, bool)
                    keep[[r[0] for r in searcher.search(batch.column(at).slice(lo, hi - lo))]] = False
                    yield batch.slice(lo, hi - lo).filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
