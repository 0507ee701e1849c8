"""Toxicity by multiple-instance learning: sentences scored from document labels alone.

A word's weight is the sum of those of the word itself and of its beginnings. A sentence is toxic with the logistic
probability of the sum of its words' weights; a document, by noisy-or, if any of its
sentences is. The weights are fitted to labels of documents, and then say which sentences offend.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, checkpoint, plain, run_starts, slices, sums, words

#: About how many labelled documents the fit reads, chosen by a hash of doc_id, and how many characters they have at most.
TRAIN_DOCS, TRAIN_CHARS = 12_000, 100_000_000
MIN_DOCS = 5  #: a word in fewer of them has no weight: too few to tell it from chance
BEGINNINGS = range(3, 9)
#: Steps of the fit, their size, and how many documents' worth of evidence a feature must bring before it has a weight.
STEPS, RATE, EVIDENCE = 200, 0.1, 1.5
THRESHOLD = 0.5
TOKEN = re.compile(r"\S+")
CLOSERS = "\"')]}»”’"


@dataclass
class Model:
    weights: dict[str, float]
    bias: float


def stops(distinct: pa.Array) -> np.ndarray:
    """Which tokens end a sentence."""
    return np.asarray(pc.match_substring_regex(distinct, r"[.!?]+[\"')\]}»”’]*$")) if len(distinct) else np.zeros(0, bool)


def sentences_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(code of each token, offsets of the sentences' tokens, offsets of the texts' sentences, distinct tokens). A line's end is a sentence's too."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    codes, offsets, distinct = words(lines.flatten())
    keep = codes != pc.index(distinct, "").as_py()  # what an empty line has for a token
    codes, offsets = codes[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
    ends = np.zeros(len(codes), bool)
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    ends |= stops(distinct)[codes] if len(codes) else False
    cut = np.concatenate([[0], np.flatnonzero(ends) + 1])
    line_ends = np.asarray(lines.offsets).astype(np.int64)
    docs = offsets[line_ends - line_ends[0]]
    return codes, cut, np.searchsorted(cut, docs), distinct


def spans(text: str) -> list[tuple[int, int, list[str]]]:
    """(begin, end, tokens) of the sentences of one text, as sentences_of finds them."""
    found, at = [], 0
    for line in text.split("\n"):
        begin, own = None, []
        for m in TOKEN.finditer(line):
            begin = m.start() if begin is None else begin
            own.append(m[0])
            if m[0].rstrip(CLOSERS).endswith((".", "!", "?")):
                found.append((at + begin, at + m.end(), own))
                begin, own = None, []
        if own:
            found.append((at + begin, at + m.end(), own))
        at += len(line) + 1
    return found


def features(form: str) -> list[str]:
    """A word and its beginnings, these marked by a star."""
    return [form, *(form[:n] + "*" for n in BEGINNINGS if n < len(form))]


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) for every value of the ranges lo[i]..hi[i]-1."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Of some texts at a time: (text, sentence, plain form) of each token from the first text and sentence on, number of sentences of each text, forms."""
    for lo, hi in slices(texts):
        codes, cut, docs, distinct = sentences_of(texts.slice(lo, hi - lo))
        of, forms = plain(distinct)
        word = of[codes] if len(codes) else np.zeros(0, np.int64)
        sentence = np.repeat(np.arange(len(cut) - 1), np.diff(cut))[word >= 0]
        yield sentence, word[word >= 0], np.diff(docs), forms


def feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, docs) of the texts in the column text: in how many each feature is."""
    for batch in batches:
        for sentence, word, n, forms in _parts(batch.column("text")):
            own = [features(form) for form in forms]
            names: dict[str, int] = {}
            feature = np.fromiter((names.setdefault(f, len(names)) for x in own for f in x), np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)[sentence]
            key = np.sort((doc << 32) | word)
            key = key[run_starts(key)]  # each document's distinct words
            at, place = ranges(ends[key & 0xFFFFFFFF], ends[(key & 0xFFFFFFFF) + 1])
            key = np.sort((key[at] >> 32 << 32) | feature[place])
            many = np.bincount(key[run_starts(key)] & 0xFFFFFFFF, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array(many, pa.int64())], ["feature", "docs"])


def encoded(known: set[str]):
    """(doc, txt, toxic, sentences, packed): each text's words with a feature among the known, packed as their distinct
    forms, the form of each word and how many words each sentence has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sentence, word, n, forms in _parts(batch.column("text")):
                some = np.array([*(any(f in known for f in features(form)) for form in forms), False])
                sentence, word = sentence[some[word]], word[some[word]]
                first = np.concatenate([[0], np.cumsum(n)])
                cuts = np.searchsorted(sentence, first)
                rows = []
                for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                    own, code = np.unique(word[lo:hi], return_inverse=True)
                    sizes = np.bincount(sentence[lo:hi] - first[i], minlength=n[i])
                    rows.append(zlib.compress(b"\0".join([str(len(code)).encode(), "\n".join(forms[k] for k in own.tolist()).encode(), code.astype(np.int32).tobytes() + sizes.astype(np.int32).tobytes()]), 1))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(n)) for c in ("doc", "txt", "toxic")), pa.array(n.astype(np.int32)), pa.array(rows, pa.binary())], ["doc", "txt", "toxic", "sentences", "packed"])
                at += len(n)

    return run


@dataclass
class Evidence:
    """What the fit knows of the documents: features of each form, tokens by form and sentence, sentences by document."""

    names: list[str]
    feature: np.ndarray
    ends: np.ndarray  #: where each form's features begin
    word: np.ndarray
    sentence: np.ndarray
    docs: np.ndarray  #: where each document's sentences begin
    toxic: np.ndarray


def gather(rows: pa.Table, names: list[str]) -> Evidence:
    """From what encoded() says of the documents, unpacked one at a time."""
    ids: dict[str, int] = {}
    tokens, sentences, base = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
    for n, packed in zip(rows["sentences"].to_pylist(), (x.as_py() for x in rows["packed"])):
        many, forms, numbers = zlib.decompress(packed).split(b"\0", 2)
        own = np.fromiter((ids.setdefault(f, len(ids)) for f in forms.decode().split("\n")), np.int32) if forms else np.zeros(0, np.int32)
        numbers = np.frombuffer(numbers, np.int32)
        tokens.append(own[numbers[: int(many)]])
        sentences.append(np.repeat(np.arange(base, base + n, dtype=np.int32), numbers[int(many) :]))
        base += n
    place = {x: i for i, x in enumerate(names)}
    lists = [[place[f] for f in features(form) if f in place] for form in ids]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    docs = np.concatenate([[0], np.cumsum(np.asarray(rows["sentences"]).astype(np.int64))]).astype(np.int64)
    return Evidence(names, np.fromiter((f for x in lists for f in x), np.int32), ends, np.concatenate(tokens), np.concatenate(sentences), docs, np.asarray(rows["toxic"]).astype(bool))


def slopes(w: np.ndarray, b: float, e: Evidence) -> tuple[float, np.ndarray, float]:
    """(negative log likelihood of the documents' labels, its gradient by weights, by bias)."""
    base = int(e.docs[-1])
    z = np.bincount(e.sentence, sums(w[e.feature], e.ends)[e.word], base) + b
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    none = sums(np.log1p(-np.minimum(p, 1 - 1e-12)), e.docs)
    clean = np.exp(none)  # the chance that no sentence is toxic
    pull = np.where(e.toxic, -clean / np.maximum(1 - clean, 1e-12), 1.0)
    g = p * np.repeat(pull, np.diff(e.docs))
    gw = np.bincount(e.feature, np.repeat(np.bincount(e.word, g[e.sentence], len(e.ends) - 1), np.diff(e.ends)), len(e.names))
    return float(-np.where(e.toxic, np.log(np.maximum(1 - clean, 1e-12)), none).sum()), gw, float(g.sum())


def fit(e: Evidence, steps: int = STEPS) -> Model:
    """Gradient descent (Adam) on the likelihood of the documents' labels, first with an absolute penalty, which leaves few
    features a weight, then without it."""
    many = len(e.toxic)
    if not e.toxic.any():
        return Model({}, -30.0)
    w, b = np.zeros(len(e.names)), -np.log(max(1.0, int(e.docs[-1]) / e.toxic.sum()))
    m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    held, penalty = np.ones(len(w), bool), EVIDENCE
    for step in range(1, steps + 1):
        if step == steps * 3 // 5:  # what has a weight by now is fitted without the penalty
            held, penalty = np.abs(w) > 0.1, 0.1
            w = np.where(held, w, 0.0)
        _, gw, gb = slopes(w, b, e)
        gw, gb = held * (gw + penalty * np.tanh(20 * w)) / many, gb / many
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= RATE * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return Model({n: float(x) for n, x in zip(e.names, w) if abs(x) > 0.1}, float(b))


def train(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Model:
    """Fits to about sample labelled documents of about chars characters at most, whole texts, drawn whatever their length.

    Executors count features and encode the words that have a frequent one; no text reaches the driver. A document with
    several labels is toxic if any says so; null labels, doc_ids and texts don't count.
    """
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30))
    least = int((1 << 30) * min(1.0, sample / max(own.count(), 1)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & (at("doc") < least))
    rows = checkpoint(texts.join(own.where(at("id") < least), F.col("doc") == F.col("id")).select("doc", F.xxhash64("text").alias("txt"), "toxic", "text"))
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    rows = rows.where(at("doc") < int(least * min(1.0, chars / max(size, 1))))
    names = sorted(rows.select("text").mapInArrow(feature_counts, "feature string, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS).select("feature").toArrow()["feature"].to_pylist())
    found = rows.mapInArrow(encoded(set(names)), "doc long, txt long, toxic int, sentences int, packed binary")
    return fit(gather(found.toArrow().sort_by([("doc", "ascending"), ("txt", "ascending")]), names))


def detect(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, sentences) of the documents whose score reaches the threshold.

    sentences holds (begin, end, score, text) of those that offend: with a probability of a half, or the highest if none
    has; begin and end count code points. Null and empty texts are never toxic; a row with a null doc_id is scored
    like others, repeated rows are, each. Texts are scored whole. Other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "doc_id long, score double, sentences array<struct<begin: int, end: int, score: double, text: string>>"
    arrow = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value.weights, shared.value.bias

        def weigh(tokens: pa.Array) -> np.ndarray:
            of, forms = plain(tokens)
            return np.array([*(sum(weights.get(x, 0.0) for x in features(f)) for f in forms), 0.0])[of][:, None]

        memo = Memo(1, weigh)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo)
                codes, cut, ends, distinct = sentences_of(texts)
                z = sums(memo.of(distinct)[codes, 0], cut) + bias if len(codes) else np.zeros(0)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                score = 1 - np.exp(sums(np.log1p(-p), ends))
                hits = np.flatnonzero(score >= threshold)
                if not len(hits):
                    continue
                found = []
                for i in hits.tolist():
                    text = texts[i].as_py()
                    parts = spans(text)
                    ends_ = np.concatenate([[0], np.cumsum([len(t) for *_, t in parts])]).astype(np.int64)
                    logits = sums(weigh(pa.array([w for *_, t in parts for w in t], pa.string()))[:, 0], ends_) + bias
                    own = list(zip([b for b, *_ in parts], [e for _, e, _ in parts], 1 / (1 + np.exp(-np.clip(logits, -30, 30)))))
                    bar = min(0.5, max((s for *_, s in own), default=0))
                    found.append([{"begin": b, "end": e, "score": float(s), "text": text[b:e]} for b, e, s in own if s >= bar])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(hits)), pa.array(score[hits]), pa.array(found, arrow)], ["doc_id", "score", "sentences"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)
