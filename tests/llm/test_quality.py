import random
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import quality as Q


def text(seed, junk):
    r = random.Random(seed)
    own = ["".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(r.randrange(20, 60))]
    return " ".join(w + r.choice(["%%%", "$$$", "###"]) for w in own) if junk else " ".join(own).capitalize() + "."


def test_binomial_tail():
    for n, p in ((10, 0.3), (200, 0.02), (5, 0.5)):
        for k in (0, 1, 3, 5, min(n, 40), n):
            assert Q.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert Q.binomial_tail(0, 10**6, 0.01) == pytest.approx(0)


def test_features_against_plain_counts():
    texts = [text(1, False), text(2, True), "AB cd 12! x x x", "", None, "a" * 40 + " %% 漢字"]
    got = Q.measure(pa.array(texts, pa.string()), Q._table())
    for t, f in zip(texts, got):
        t = t or ""
        tokens = t.split()
        n = max(1, len(tokens))
        letters = [c for c in t if c.isalpha()]
        want = [sum(not (c.isalnum() or c.isspace() or c in Q.PLAIN) for c in t) / max(1, len(t)), sum(c.isupper() for c in letters) / max(1, len(letters)), sum(c.isdigit() for c in t) / max(1, len(t)), sum(not any(c.isalpha() for c in w) for w in tokens) / n, sum(a == b for a, b in zip(tokens, tokens[1:])) / n, max(map(tokens.count, tokens)) / n if len(tokens) >= 20 else 0, sum(len(w) > 30 for w in tokens) / n]
        assert f[:7].tolist() == pytest.approx(want)
        assert f[7] == pytest.approx(sum(w != (s := w.rstrip("%$#!.")) and s != "" and len(w) - len(s) > 1 for w in tokens) / n)


def test_risk_is_controlled(spark, docs):
    n = 6000
    rows = [(i, text(i, i % 10 == 0)) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(0, n, 2)], "doc_id long, quality int, toxic int")
    got = Q.judge(docs(rows), labels, alpha=0.04).collect()
    assert len(got) == n
    good, bad = [r for r in got if r.doc_id % 10], [r for r in got if r.doc_id % 10 == 0]
    assert sum(not r.keep for r in good) <= 0.04 * len(good)
    assert sum(not r.keep for r in bad) >= 0.95 * len(bad)
    assert {"marked_tokens"} <= {x for r in bad for x in r.rejected_by}


def test_choice_is_valid_over_draws():
    """Over many holdouts, cutoffs that reject more than the share are chosen no oftener than delta."""
    r = np.random.default_rng(1)
    wrong = 0
    for _ in range(200):
        values = r.random(3000) ** 3
        histogram = {("s", rule): np.bincount((values[:, None] > np.array(Q.RULES[rule])).sum(axis=1), minlength=len(Q.RULES[rule]) + 1) for rule in Q.RULES}
        cut = Q.choose(histogram, alpha=0.1, delta=0.1)["s"]
        wrong += any(1 - c ** (1 / 3) > 0.1 / len(Q.RULES) for c in cut.values())
    assert wrong <= 20


def test_copies_are_one_draw(spark, docs):
    """A text that a thousand labelled rows share counts once; one bad label makes it bad."""
    rows = [(i, text(i, False)) for i in range(40)] + [(1000 + i, text(7, False)) for i in range(1000)] + [(5000 + i, text(9000, True)) for i in range(3)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows[:-1]] + [(5002, 0, 0)], "doc_id long, quality int, toxic int")
    df = docs(rows)
    once = Q.calibrate(Q.features(df.where("doc_id < 40")), labels)
    assert Q.calibrate(Q.features(df), labels) == once  # forty good texts are too few to prove anything
    assert once == {"en": {}} and Q.choose({("en", r): np.bincount([0] * 4000, minlength=len(c) + 1) for r, c in Q.RULES.items()})["en"]


def test_edge_cases(spark, docs):
    rows = [(1, None), (2, ""), (None, "x"), (3, "%% " * 40), (3, "%% " * 40), (4, "a b c " * 80_000)]
    df = docs(rows, f=F.lit(1), stratum=F.lit("q"), keep=F.lit(False))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.keep and r.rejected_by == [] for r in Q.judge(df, none).collect())
    out = Q.apply(Q.features(df.withColumn("lang", F.lit(None).cast("string"))), {"": {"wordless": 0.5}, "en": {"wordless": 0.0}})
    assert sorted((str(r.doc_id), r.keep) for r in out.collect()) == [("1", True), ("2", True), ("3", False), ("3", False), ("4", True), ("None", True)]
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert Q.calibrate(Q.features(df), labels) == {}
    assert Q.judge(docs([]), none).count() == 0
