"""Language-model scores by deleted interpolation of character n-grams up to five.

All documents are counted: nine in ten (by a hash of the text, so that copies stay together) give the maximum-likelihood
estimates, the rest is held out.
The estimate of each order is mixed with that of the order below, by a weight that depends on the order and on how often
the context was seen (buckets of powers of two); expectation-maximisation on the held-out counts learns the weights. The
lowest order is mixed with a uniform one. Letters are lower case, all ASCII digits are one character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hashed, checkpoint, mix, run_starts, slices, sums

ORDER, BUCKETS, ROUNDS, HELD_OUT = 5, 24, 8, 10
START = 2  #: code point before each text
BITS = 12
FLUSH = 3_000_000
#: Distinct n-grams (16 bytes each) up to which each Python worker gets the model; beyond, the n-grams of documents are
#: joined with it. Both look up the same numbers by the same hashes.
BROADCAST_GRAMS = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, each text after ORDER - 1 starts; place of each text's characters; offsets of these)."""
    own = pc.utf8_lower(pc.fill_null(texts, "")).to_pylist()
    size = np.fromiter(map(len, own), np.int64, len(own))
    lead = chr(START) * (ORDER - 1)
    cp = np.frombuffer((lead + lead.join(own)).encode("utf-32-le"), np.uint32).copy()
    cp[(cp >= 48) & (cp <= 57)] = 48
    cp[cp == 0] = 0xFFFD
    offsets = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(offsets[-1]) + np.repeat(np.arange(1, len(own) + 1) * (ORDER - 1), size)
    return cp, place, offsets


class Counts:
    """Counts of n-grams, packed by an alphabet that grows; given out when they or it become many."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.symbol = np.full(0x110000, -1, np.int64)
        self.alphabet = np.zeros(0, np.uint32)
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        self.size = 0

    def add(self, cp: np.ndarray, place: np.ndarray, out: np.ndarray) -> Iterator[pa.RecordBatch]:
        """out: which of the characters at place are held out."""
        if not len(place):
            return
        new = np.flatnonzero(np.bincount(cp, minlength=0x110000))
        if len(new) > 1 << BITS and len(place) > 1:
            half = len(place) // 2
            for p, o in ((place[:half], out[:half]), (place[half:], out[half:])):
                lo = p[0] - ORDER + 1
                yield from self.add(cp[lo : p[-1] + 1], p - lo, o)
            return
        new = new[self.symbol[new] < 0]
        if len(self.alphabet) + len(new) > 1 << BITS:
            yield from self.flush()
            new = np.flatnonzero(np.bincount(cp, minlength=0x110000))
        self.symbol[new] = len(self.alphabet) + np.arange(len(new))
        self.alphabet = np.concatenate([self.alphabet, new.astype(np.uint32)])
        s = self.symbol[cp]
        key = np.zeros(len(cp) - ORDER + 1, np.int64)
        for k in range(ORDER):
            key = key << BITS | s[k : len(s) - ORDER + 1 + k]
        key = key[place - ORDER + 1]
        for which in (0, 1):
            own = np.sort(key[out == which])
            starts = run_starts(own)
            if len(own):
                self.held[which].append((own[starts], np.diff(np.append(starts, len(own)))))
                self.size += len(starts)
        if self.size > FLUSH:
            self.merge()
            if self.size > FLUSH // 2:
                yield from self.flush()

    def merge(self) -> None:
        self.size = 0
        for which, parts in enumerate(self.held):
            if parts:
                key, n = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(key, kind="stable")
                key, n = key[order], n[order]
                starts = run_starts(key)
                self.held[which] = [(key[starts], np.add.reduceat(n, starts))]
                self.size += len(starts)

    def flush(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for which, parts in enumerate(self.held):
            for key, n in parts:
                for lo in range(0, len(key), 50_000):
                    k, m = key[lo : lo + 50_000], n[lo : lo + 50_000]
                    cp = np.stack([self.alphabet[k >> BITS * (ORDER - 1 - i) & ((1 << BITS) - 1)] for i in range(ORDER)], axis=1)
                    zero = np.zeros(len(k), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cp).view(f"<U{ORDER}").ravel().tolist(), pa.string()), pa.array(zero if which else m), pa.array(m if which else zero)], ["gram", "train", "held"])
        self.clear()


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    for batch in batches:
        held = np.asarray(batch.column(0)).astype(np.int64)
        for lo, hi in slices(batch.column(1)):
            cp, place, offsets = characters(batch.column(1).slice(lo, hi - lo))
            out = np.repeat(held[lo:hi], np.diff(offsets))
            for at in range(0, len(place), 1_000_000):
                p = place[at : at + 1_000_000]
                first = p[0] - ORDER + 1
                yield from counts.add(cp[first : p[-1] + 1], p - first, out[at : at + 1_000_000])
    yield from counts.flush()


def bucket(n: Column) -> Column:
    """0 for a context that wasn't seen, else 1 and more by powers of two."""
    return F.when(n > 0, F.least(F.floor(F.log2(n.cast("double"))) + 1, F.lit(BUCKETS - 1))).otherwise(0).cast("int")


def chain(p: np.ndarray, b: np.ndarray, weights: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """(interpolated probability, share of each order in its mixture with those below) of rows with an estimate and a bucket for each order."""
    mixed, share = np.full(len(p), base), np.empty_like(p)
    for k in range(ORDER):
        own = weights[k][b[:, k]] * p[:, k]
        mixed = own + (1 - weights[k][b[:, k]]) * mixed
        share[:, k] = own / mixed
    return mixed, share


def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([np.asarray(batch.column(f"p{k}")) for k in range(1, ORDER + 1)], axis=1), np.stack([np.asarray(batch.column(f"b{k}")) for k in range(1, ORDER + 1)], axis=1)


def estimates(docs: DataFrame) -> DataFrame:
    """(gram, held, p1.., b1..) for every n-gram of ORDER characters of all documents: its estimates and the buckets of its contexts."""
    held = (F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(HELD_OUT)) == 0).cast("int")
    own = docs.select(held.alias("out"), F.col("text").cast("string").alias("text")).where("text is not null")
    grams = checkpoint(own.mapInArrow(count, "gram string, train long, held long").groupBy("gram").agg(F.sum("train").alias("train"), F.sum("held").alias("held")))
    out = grams
    for k in range(1, ORDER + 1):
        tail = lambda n: F.substring("gram", ORDER + 1 - k, n)  # noqa: B023, E731
        n, of = f"n{k}", f"of{k}"
        if k < ORDER:
            own = grams.groupBy(tail(k).alias("key")).agg(F.sum("train").alias(n))
            out = out.withColumn("key", tail(k)).join(own, "key").drop("key")
        else:
            out = out.withColumn(n, F.col("train"))
        if k > 1:
            own = grams.groupBy(tail(k - 1).alias("key")).agg(F.sum("train").alias(of))
            out = out.withColumn("key", tail(k - 1)).join(own, "key").drop("key")
        else:
            out = out.crossJoin(grams.agg(F.coalesce(F.sum("train"), F.lit(0)).alias(of)))
        out = out.withColumn(f"p{k}", F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)).withColumn(f"b{k}", bucket(F.col(of)))
    return checkpoint(out.select("gram", "held", *(f"{x}{k}" for k in range(1, ORDER + 1) for x in "pb")))


def learn(table: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weights by order and bucket, base probability). Buckets without held-out counts keep a half; an unseen context has no weight.

    Each round is one pass over the held-out n-grams that sums, by order and bucket, the counts that reach an order and
    those that it takes: a few hundred numbers a batch.
    """
    v = table.select(F.substring("gram", ORDER, 1).alias("c")).distinct().count()
    base = 1.0 / (v + 1)
    weights = np.full((ORDER, BUCKETS), 0.5)
    weights[:, 0] = 0.0
    own = table.where("held > 0")
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            took, reached = np.zeros((ORDER, BUCKETS)), np.zeros((ORDER, BUCKETS))
            for batch in batches:
                p, b = columns(batch)
                _, share = chain(p, b, weights, base)
                reach = np.asarray(batch.column("held")).astype(float)
                for k in reversed(range(ORDER)):
                    part = reach * share[:, k]
                    took[k] += np.bincount(b[:, k], part, BUCKETS)
                    reached[k] += np.bincount(b[:, k], reach, BUCKETS)
                    reach = reach - part
            at = np.flatnonzero(reached)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(took.ravel()[at]), pa.array(reached.ravel()[at])], ["at", "took", "reached"])

        weights = weights.copy()
        for r in own.mapInArrow(expect, "at int, took double, reached double").groupBy("at").agg(F.sum("took").alias("took"), F.sum("reached").alias("reached")).collect():
            if r.at % BUCKETS:
                weights[divmod(r.at, BUCKETS)] = min(max(r.took / r.reached, 1e-6), 1 - 1e-6)
    return weights, base


def hashed(cp: np.ndarray) -> np.ndarray:
    """A hash of the ORDER code points that end at each place from ORDER - 1 on."""
    h = np.zeros(len(cp) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        h = h * BASE + cp[k : len(cp) - ORDER + 1 + k]
    return mix(h)


def score(docs: DataFrame, broadcast_grams: int = BROADCAST_GRAMS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_chars, log_prob, bits_per_char) of each row under a model of all of them.

    Whole texts are scored. Null text has null in all but doc_id; an empty one has no characters, log_prob 0 and null
    bits_per_char. A row with a null doc_id is counted and scored like others; repeated rows are, each. Other columns
    aren't read.
    """
    table = estimates(docs)
    weights, base = learn(table, rounds)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cp = np.frombuffer("".join(batch.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
            keys = np.zeros(len(cp), np.uint64)
            for k in range(ORDER):
                keys = keys * BASE + cp[:, k]
            yield pa.RecordBatch.from_arrays([pa.array(mix(keys).view(np.int64)), pa.array(np.log(chain(*columns(batch), weights, base)[0]))], ["gram", "log"])

    logs = table.mapInArrow(finish, "gram long, log double")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = table.count()
    scored = _by_broadcast(own, logs) if n <= broadcast_grams else _by_join(own, logs)
    return scored.withColumn("bits_per_char", F.when(F.col("n_chars") > 0, -F.col("log_prob") / F.col("n_chars") / F.lit(float(np.log(2)))))


def _by_broadcast(docs: DataFrame, logs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = logs.toArrow()
    shared = spark.sparkContext.broadcast((np.asarray(rows["gram"]).view(np.uint64), np.asarray(rows["log"])))
    tag = f"{spark.sparkContext.applicationId}:{shared._jbroadcast.id()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _models:
            _models.clear()
            keys, values = shared.value
            _models[tag] = (Hashed(keys, 2), values)
        table, values = _models[tag]
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo)
                cp, place, offsets = characters(texts)
                got = values[table.find(hashed(cp)[place - ORDER + 1])] if len(place) else np.zeros(0)
                null = np.asarray(texts.is_null())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets), pa.int64(), mask=null), pa.array(sums(got, offsets), mask=null)], ["doc_id", "n_chars", "log_prob"])

    return docs.mapInArrow(run, "doc_id long, n_chars long, log_prob double")


_models: dict[str, tuple[Hashed, np.ndarray]] = {}


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, txt, hash of an n-gram, n) of each text's distinct n-grams; txt is a hash of the text."""
    for batch in batches:
        for lo, hi in slices(batch.column(2)):
            cp, place, offsets = characters(batch.column(2).slice(lo, hi - lo))
            row, gram = np.repeat(np.arange(lo, hi), np.diff(offsets)), hashed(cp)[place - ORDER + 1].view(np.int64)
            order = np.lexsort((gram, row))
            row, gram = row[order], gram[order]
            starts = run_starts(row, gram)
            n = np.diff(np.append(starts, len(row)))
            for first in range(0, len(starts), 50_000):
                some = starts[first : first + 50_000]
                at = pa.array(row[some])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(gram[some]), pa.array(n[first : first + 50_000])], ["doc", "txt", "gram", "n"])


def _by_join(docs: DataFrame, logs: DataFrame) -> DataFrame:
    """The same as _by_broadcast, by joins and sums; the way of a model too large for a worker."""
    own = docs.withColumn("txt", F.xxhash64("text"))
    grams = own.select("doc_id", "txt", "text").distinct().where("text <> ''").mapInArrow(_grams, "doc long, txt long, gram long, n long")
    total = grams.join(logs, "gram").groupBy("doc", "txt").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("log")).alias("sum"))
    both = own.withColumnRenamed("txt", "t").join(total, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("t") == F.col("txt")), "left")
    some = F.col("text").isNotNull()
    return both.select("doc_id", F.when(some, F.coalesce("n", F.lit(0))).alias("n_chars"), F.when(some, F.coalesce("sum", F.lit(0.0))).alias("log_prob"))
