"""Quality rules whose thresholds keep the share of falsely rejected documents under control.

Each rule rejects a document whose feature exceeds a cutoff. For each stratum and rule, cutoffs from a fixed grid are
tried from the mildest on: a cutoff passes if, with the good documents of the labelled holdout that it rejects, an
exact binomial test refutes that it rejects more than alpha / rules of all good ones. The first cutoff that doesn't pass
ends the sequence, so that within it no correction is due; across rules and strata the level is divided (Bonferroni).
With probability 1 - delta, no stratum loses more than alpha of its good documents to all rules together.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, listed, run_starts, slices, words

ALPHA, DELTA = 0.02, 0.1
#: Rows of thresholds up to which they are broadcast; beyond, they are joined by shuffles.
BROADCAST_STRATA = 10_000
#: Cutoffs of each rule, from the mildest; they don't depend on any data.
_SHARES = [*np.linspace(0.98, 0.2, 40).round(4).tolist(), *np.linspace(0.19, 0.01, 37).round(4).tolist()]
RULES: dict[str, list[float]] = {
    "symbols": _SHARES,  #: share of characters that are neither letters, digits, white space nor plain punctuation
    "uppercase": _SHARES,  #: share of letters
    "digits": _SHARES,  #: share of characters
    "wordless": _SHARES,  #: share of tokens without a letter
    "repetition": _SHARES,  #: share of tokens that equal the one before
    "top_token": _SHARES,  #: share of the most frequent token, of texts with 20 tokens or more
    "long_tokens": _SHARES,  #: share of tokens of more than 30 characters
    "marked_tokens": _SHARES,  #: share of tokens that end with more than one character other than letters and digits
}
PLAIN = set(".,;:!?'\"()-–—’‘“”«»…¿¡/")


def _table() -> np.ndarray:
    """Of every code point below 0x3000: 1 letter, 2 upper-case letter, 3 digit, 4 white space, 5 plain punctuation, 0 other."""
    out = np.zeros(0x3001, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        out[c] = 2 if ch.isupper() else 1 if ch.isalpha() else 3 if ch.isdigit() else 4 if ch.isspace() else 5 if ch in PLAIN else 0
    out[0x3000] = 1  # scripts above are taken as letters
    return out


def measure(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """A row for each text, a column for each rule; 0 for null and empty texts."""
    own = [t or "" for t in texts.to_pylist()]
    size = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.concatenate([[0], np.cumsum(size)])
    kind = table[np.minimum(np.frombuffer("".join(own).encode("utf-32-le"), np.uint32), 0x3000)]
    count = lambda k: np.diff(np.concatenate([[0], np.cumsum(kind == k)])[ends])
    upper, digits, other = count(2), count(3), count(0)
    letters = count(1) + upper
    codes, offsets, distinct = words(texts)
    tokens = listed(distinct)
    blank = np.array([not t for t in tokens] + [True])
    keep = ~blank[codes]
    doc = np.repeat(np.arange(len(own)), np.diff(offsets))[keep]
    code = codes[keep]
    n = np.bincount(doc, minlength=len(own))

    def trail(t: str) -> int:
        k = len(t)
        while k and not t[k - 1].isalnum():
            k -= 1
        return len(t) - k

    marks = np.array([[not any(map(str.isalpha, t)), len(t) > 30, 1 < trail(t) < len(t)] for t in tokens] + [[False] * 3])[code]
    tally = [np.bincount(doc, marks[:, k], len(own)) for k in range(3)]
    again = np.zeros(len(code))
    again[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    key = np.sort((doc << 32) | code)
    starts = run_starts(key)
    top = np.zeros(len(own))
    np.maximum.at(top, key[starts] >> 32, np.diff(np.append(starts, len(key))))
    some = np.maximum(n, 1)
    chars = np.maximum(size, 1)
    return np.stack([other / chars, upper / np.maximum(letters, 1), digits / chars, tally[0] / some, np.bincount(doc, again, len(own)) / some, np.where(n >= 20, top / some, 0), tally[1] / some, tally[2] / some], axis=1)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, txt, f) of each row, f the values of the rules; stratum is lang, "" if null or absent; txt a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        for batch in batches:
            for lo, hi in slices(batch.column(3)):
                f = measure(batch.column(3).slice(lo, hi - lo), table)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.ListArray.from_arrays(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32), f.ravel())], ["doc_id", "stratum", "txt", "f"])

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("stratum"), F.xxhash64(F.col("text").cast("string")).alias("txt"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, stratum string, txt long, f array<double>")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of X ~ Binomial(n, p): the p-value of a share of at least p with k seen of n."""
    total, at = 0.0, n * log1p(-p)
    for i in range(k + 1):
        term = exp(at)
        total += term
        if i > n * p and term < total * 1e-17:
            break
        at += log((n - i) / (i + 1)) + log(p) - log1p(-p) if i < n else 0
    return min(1.0, total)


def choose(histogram: dict[tuple[str, str], np.ndarray], alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """{stratum: {rule: cutoff}}. histogram: of the good documents, how many exceed exactly the first so many cutoffs of the reversed grid."""
    strata = sorted({s for s, _ in histogram})
    level = delta / max(1, len(strata) * len(RULES))
    found: dict[str, dict[str, float]] = {s: {} for s in strata}
    for (stratum, rule), n in histogram.items():
        whole = int(n.sum())
        for i, cutoff in enumerate(RULES[rule]):
            rejected = int(n[len(RULES[rule]) - i :].sum())
            if binomial_tail(rejected, whole, alpha / len(RULES)) > level:
                break
            found[stratum][rule] = cutoff
    return found


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """Cutoffs from the labelled documents of features().

    Copies of a text are one draw, as the binomial test needs independent ones: a text is good if all labels of all its
    documents, null ones aside, say quality 1.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(F.col("quality").cast("int")).alias("good"))
    own = measured.join(good, F.col("doc_id") == F.col("id")).groupBy("stratum", "txt").agg(F.min("good").alias("good"), F.first("f").alias("f")).where("good = 1")

    def exceeded(k: int, rule: str):
        return F.size(F.filter(F.array(*map(F.lit, RULES[rule])), lambda c: F.col("f")[k] > c))

    over = F.array(*(F.struct(F.lit(r).alias("rule"), exceeded(k, r).alias("over")) for k, r in enumerate(RULES)))
    rows = own.select("stratum", F.explode(over).alias("o")).groupBy("stratum", "o.rule", "o.over").count().collect()
    histogram: dict[tuple[str, str], np.ndarray] = {}
    for r in rows:
        histogram.setdefault((r.stratum, r.rule), np.zeros(len(RULES[r.rule]) + 1, np.int64))[r.over] += r["count"]
    return choose(histogram, alpha, delta)


def apply(measured: DataFrame, cutoffs: dict[str, dict[str, float]]) -> DataFrame:
    """(doc_id, stratum, rejected_by, keep) of each row of features(). A stratum without cutoffs rejects nothing."""
    spark = measured.sparkSession
    rows = [(s, [c.get(r) for r in RULES]) for s, c in sorted(cutoffs.items())]
    bars = spark.createDataFrame(rows, "s string, cutoffs array<double>")
    if len(rows) <= BROADCAST_STRATA:
        bars = F.broadcast(bars)
    names = F.array(*map(F.lit, RULES))
    hit = F.filter(F.transform(names, lambda r, i: F.when(F.get("f", i) > F.get("cutoffs", i), r)), lambda r: r.isNotNull())
    return measured.join(bars, F.col("stratum") == F.col("s"), "left").select("doc_id", "stratum", F.coalesce(hit, F.array().cast("array<string>")).alias("rejected_by")).withColumn("keep", F.size("rejected_by") == 0)


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, stratum, rejected_by, keep) of every document.

    Null and empty texts have no feature above 0 and are kept; a row with a null doc_id is judged but never part of the
    holdout; repeated rows are judged each. Without labels nothing is rejected. Texts are measured whole.
    """
    measured = checkpoint(features(docs))  # used for the holdout, then for all: measured once
    return apply(measured, calibrate(measured, labels, alpha, delta))
