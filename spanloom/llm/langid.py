"""Language identification by unigram pieces, marginalised over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. Words with digits (numbers, keys) and
punctuation say nothing about the language and count nowhere. The probability of a word is the sum over
all its segmentations into pieces, by the forward algorithm; of a text, the product over its words. Expectation-
maximisation fits the probabilities to words of labelled documents; a background model, uniform over characters,
stands for texts in none of the languages.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashed, Memo, codepoints, plain, run_starts, slices, sums, words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: About how many labelled documents of each language the fit reads, chosen by a hash of doc_id.
TRAIN_DOCS = 1500
#: Longer runs of letters, as in scripts without spaces, are learnt from in parts of so many characters, so that the sums of
#: the fit stay within the range of floating point; they are scored whole.
PART = 40
ROUNDS = 3
MIN_POSTERIOR = 0.5
BASE = np.uint64(0x100000001B3)
UNKNOWN = 1e-8


@dataclass
class Model:
    langs: list[str]
    pieces: list[str]
    p: np.ndarray  #: a row for each piece, a column for each language; the last row is for characters that are no piece
    background: float  #: log probability of a character under the background model


def read_pieces(path: str) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def hashes(cp: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For n = 1, 2, ...: a hash of the n code points from each place on, of those places that have n."""
    c = cp.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, longest + 1):
        if n > len(c):
            return
        h = h[: len(c) - n + 1] * BASE + c[n - 1 :]
        yield h


class Lattice:
    """Pieces that begin at each place of each word."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        cp, offsets = codepoints(pieces)
        size = np.diff(offsets)
        keys = np.zeros(len(pieces), np.uint64)
        for n, h in enumerate(hashes(cp, self.longest), 1):
            keys[size == n] = h[offsets[:-1][size == n]]
        self.table, self.none = Hashed(keys), len(pieces)

    def of(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(places x lengths of piece numbers, -1 for none; offsets of the words). A character that is no piece gets the number after the last."""
        cp, offsets = codepoints(["▁" + f for f in forms])
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(cp))
        found = np.full((len(cp), self.longest), -1, np.int32)
        for n, h in enumerate(hashes(cp, self.longest), 1):
            fits = np.flatnonzero(left[: len(h)] >= n)
            found[fits, n - 1] = self.table.find(h[fits])
        found[found[:, 0] < 0, 0] = self.none
        return found, offsets


def forward(found: np.ndarray, offsets: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language: the sum over all segmentations, rescaled now and then."""
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    n, longest = len(size), found.shape[1]
    p = np.vstack([p, np.zeros((1, p.shape[1]))])  # the last row, -1, is for no piece
    ring = np.zeros((longest, n, p.shape[1]))
    ring[0] = 1
    log, out = np.zeros((n, p.shape[1])), np.zeros((n, p.shape[1]))
    start = offsets[:-1][order]
    active = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), side="right")
    for t, m in enumerate(active.tolist(), 1):
        new = np.zeros((m, p.shape[1]))
        for k in range(1, min(t, longest) + 1):
            piece = found[start[:m] + t - k, k - 1]
            some = np.flatnonzero(piece >= 0)
            if len(some):
                new[some] += ring[(t - k) % longest, some] * p[piece[some]]
        ring[t % longest, :m] = new
        ended = np.arange(active[t] if t < len(active) else 0, m)
        out[order[ended]] = np.log(new[ended]) + log[ended]
        if t % 8 == 0:
            top = ring[:, :m].max(axis=0)
            ring[:, :m] /= top
            log[:m] += np.log(top)
    return out


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation from the counts of words by language. Every piece keeps a small share, so none is impossible."""
    langs, lattice = sorted(counts), Lattice(pieces)
    p = np.full((len(pieces) + 1, len(langs)), UNKNOWN)
    chars: set[str] = {"▁"}
    for j, lang in enumerate(langs):
        own: Counter[str] = Counter()
        for w, n in counts[lang].items():
            for i in range(0, len(w) if w.isalpha() else 0, PART):
                own[w[i : i + PART]] += n
        forms = sorted(own)
        weight = np.array([own[w] for w in forms], float)
        chars.update(*forms)
        found, offsets = lattice.of(forms)
        size = np.diff(offsets)
        q = np.full(len(pieces) + 1, 1.0)
        q[:-1] = 10.0 ** -np.fromiter(map(len, pieces), float, len(pieces)).clip(1, 2) / 10
        width = size.max(initial=0) + 1
        for _ in range(rounds):
            total = np.zeros(len(pieces) + 1)
            q[-1] = UNKNOWN
            for lo in range(0, len(forms), 20_000):
                some = slice(lo, lo + 20_000)
                start, n = offsets[:-1][some], size[some]
                a, b = np.zeros((len(n), width + 1)), np.zeros((len(n), width + 1))
                a[:, 0] = 1
                b[np.arange(len(n)), n] = 1
                edges = []
                for t in range(1, n.max(initial=0) + 1):
                    for k in range(1, min(t, lattice.longest) + 1):
                        rows = np.flatnonzero(n >= t)
                        piece = found[start[rows] + t - k, k - 1]
                        rows, piece = rows[piece >= 0], piece[piece >= 0]
                        if len(rows):
                            a[rows, t] += a[rows, t - k] * q[piece]
                            edges.append((t, k, rows, piece))
                for t, k, rows, piece in reversed(edges):
                    b[rows, t - k] += b[rows, t] * q[piece]
                z = weight[some] / np.maximum(a[np.arange(len(n)), n], 1e-300)
                for t, k, rows, piece in edges:
                    total += np.bincount(piece, a[rows, t - k] * q[piece] * b[rows, t] * z[rows], len(total))
            q = (total + 0.01) / (total + 0.01).sum()
        p[:-1, j] = q[:-1]
    return Model(langs, pieces, p, -float(np.log(len(chars) + 1)))


def train(docs: DataFrame, vocabulary: str = VOCABULARY, per_language: int = TRAIN_DOCS) -> Model:
    """Fits to about per_language documents of each value of lang, whole texts, chosen by a hash of doc_id.

    Only word counts of the chosen documents reach the driver. Rows with a null lang, doc_id or text don't count.
    """
    have = docs.select(F.col("lang").cast("string").alias("lang"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("at"), "text").where("lang is not null and text is not null and doc_id is not null")
    n = {r.lang: r.n for r in have.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    pick = F.lit(False)
    for lang, many in sorted(n.items()):
        pick |= (F.col("lang") == lang) & (F.col("at") < int((1 << 30) * min(1.0, per_language / many)))
    counts: dict[str, dict[str, int]] = {}
    for r in have.where(pick).select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r.lang, {})[r.word] = r.n
    return fit(counts, read_pieces(vocabulary))


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        lang = np.asarray(langs.indices).astype(np.int64)
        for lo, hi in slices(batch.column(1)):
            codes, offsets, distinct = words(batch.column(1).slice(lo, hi - lo))
            of, forms = plain(distinct)
            key = (np.repeat(lang[lo:hi], np.diff(offsets)) << 40) | of[codes]
            key = np.sort(key[of[codes] >= 0])
            starts = run_starts(key)
            n = np.diff(np.append(starts, len(key)))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key[starts] >> 40)), pa.array(forms, pa.string()).take(pa.array(key[starts] & ((1 << 40) - 1))), pa.array(n, pa.int64())], ["lang", "word", "n"])


class Scorer:
    """Scores of whole texts; words that come again are looked up."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.memo = Memo(len(model.langs) + 2, self.compute)

    def compute(self, tokens: pa.Array) -> np.ndarray:
        """Log probability in each language, under the background model, and 1; all 0 for a token with a digit or without a letter."""
        of, forms = plain(tokens)
        spelt = np.fromiter(map(str.isalpha, forms), bool, len(forms))
        of, forms = np.where(spelt[of] & (of >= 0), np.cumsum(spelt)[of] - 1, -1) if len(forms) else of, [f for f, s in zip(forms, spelt) if s]
        out = np.zeros((len(forms) + 1, len(self.model.langs) + 2))
        size = np.fromiter(map(len, forms), np.int64, len(forms))
        order = np.argsort(size, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(size[order]) // 200_000)) + 1):
            if len(part):
                found, offsets = self.lattice.of([forms[i] for i in part])
                out[part, :-2] = forward(found, offsets, self.model.p)
        out[:-1, -2] = (size + 1) * self.model.background
        out[:-1, -1] = 1
        return out[of]

    def score(self, texts: pa.Array) -> np.ndarray:
        codes, offsets, distinct = words(texts)
        return sums(self.memo.of(distinct)[codes], offsets)


_scorers: dict[str, Scorer] = {}


def decide(total: np.ndarray, model: Model, min_posterior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its log probability, its posterior among the languages, whether the text is accepted)."""
    logs = total[:, :-2]
    best = logs.argmax(axis=1)
    top = logs[np.arange(len(logs)), best]
    posterior = 1 / np.exp(logs - top[:, None]).sum(axis=1)
    return best, top, posterior, (total[:, -1] > 0) & (posterior >= min_posterior) & (top > total[:, -2])


def identify(docs: DataFrame, model: Model, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """(doc_id, predicted, log_prob, posterior, accepted) for each row.

    A document is rejected if its text is null, empty or has no word of letters, if no language has a posterior of
    min_posterior, or if the background model explains it better than the best language. predicted, log_prob and
    posterior are null where there is nothing to score; ties go to the language that sorts first. A row with a null
    doc_id is scored like others; repeated rows are, each. Texts are scored whole. Other columns aren't read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.langs, model.pieces, model.p, model.background))
    tag = f"{id(shared)}:{spark.sparkContext.applicationId}:{shared._jbroadcast.id() if shared._jbroadcast else 0}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _scorers:
            _scorers.clear()
            _scorers[tag] = Scorer(Model(*shared.value))
        scorer = _scorers[tag]
        names = pa.array([*scorer.model.langs, None], pa.string())
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                total = scorer.score(batch.column(1).slice(lo, hi - lo))
                best, top, posterior, accepted = decide(total, scorer.model, min_posterior) if scorer.model.langs else (np.zeros(hi - lo, int), *(np.zeros(hi - lo) for _ in "ab"), np.zeros(hi - lo, bool))
                blank = (total[:, -2] == 0) | (len(scorer.model.langs) == 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), names.take(pa.array(np.where(blank, len(scorer.model.langs), best))), pa.array(top, mask=blank), pa.array(posterior, mask=blank), pa.array(accepted & ~blank)],
                    ["doc_id", "predicted", "log_prob", "posterior", "accepted"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, predicted string, log_prob double, posterior double, accepted boolean")


def keep_identified(docs: DataFrame, model: Model, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """The accepted documents, all columns as they are, in one pass over them."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.langs, model.pieces, model.p, model.background))
    tag = f"{id(shared)}:{spark.sparkContext.applicationId}:{shared._jbroadcast.id() if shared._jbroadcast else 0}"
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _scorers:
            _scorers.clear()
            _scorers[tag] = Scorer(Model(*shared.value))
        scorer = _scorers[tag]
        for batch in batches:
            for lo, hi in slices(batch.column(at)):
                if scorer.model.langs:
                    total = scorer.score(batch.column(at).slice(lo, hi - lo))
                    yield batch.slice(lo, hi - lo).filter(pa.array(decide(total, scorer.model, min_posterior)[3]))

    return docs.mapInArrow(run, docs.schema)
