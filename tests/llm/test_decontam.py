import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontam as D

R = random.Random(5)
COMMON = [f"c{i}" for i in range(20)]
VOCAB = ["".join(R.choices("abcdefghij", k=6)) for _ in range(2000)]


def sentence(r, n):
    return " ".join(r.choice(COMMON) if r.random() < 0.4 else r.choice(VOCAB) for _ in range(n)).capitalize() + "."


ITEMS = [(i, sentence(R, R.randrange(5, 20)) + " " + sentence(R, R.randrange(3, 12))) for i in range(60)]


def brute_scores(items, query):
    bags = [Counter(D.tokens(t)) for _, t in items]
    n, avg = len(bags), sum(sum(b.values()) for b in bags) / len(bags)
    df = Counter(w for b in bags for w in b)
    out = {}
    for i, b in enumerate(bags):
        w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * sum(b.values()) / avg)) for t, c in b.items()}
        out[i] = sum(x for t, x in w.items() if t in query) / sum(w.values())
    return out


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.6, 0.95])
def test_retrieval_is_exact(threshold):
    (index,) = D.build(ITEMS)
    s = D.Searcher(index, threshold, 0, 0)
    r = random.Random(1)
    windows = [set(r.choices(COMMON + VOCAB, k=40)) | set(D.tokens(ITEMS[r.randrange(60)][1])[: r.randrange(30)]) for _ in range(80)]
    pairs = [(w, index.terms[t]) for w, own in enumerate(windows) for t in own if t in index.terms]
    got = {(w, i): x for w, i, x in zip(*(v.tolist() for v in s.retrieve(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), len(windows))))}
    want = {(w, i): x for w, own in enumerate(windows) for i, x in brute_scores(ITEMS, own).items() if x >= threshold - 1e-9}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_leaks_found_and_clean_left(spark, docs):
    r = random.Random(2)
    texts = [" ".join(sentence(r, 12) for _ in range(r.randrange(1, 40))) for _ in range(60)]
    planted = {}
    for d in range(0, 60, 3):
        cut = r.randrange(len(texts[d]))
        texts[d] = texts[d][:cut] + " " + ITEMS[d][1].upper() + " " + texts[d][cut:]
        planted[d] = d
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.leaks(docs(texts), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == set(planted.items())
    assert all(x.score > 0.99 and x.question_overlap == x.answer_overlap == 1 for x in got)
    kept = D.drop_leaks(docs(texts), bench)
    assert {x.doc_id for x in kept.collect()} == set(range(60)) - planted.keys()


def test_shards_agree(spark, docs, monkeypatch):
    texts = [ITEMS[i][1] + " " + ITEMS[i + 1][1] for i in range(30)]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = list(D.build(ITEMS))
    many = list(D.build(ITEMS, 7))
    assert len(one) == 1 and len(many) == 9
    for s in (D.Searcher(i, 0.6, 0.5, 0.5) for i in many):
        assert s.width == D.Searcher(one[0], 0.6, 0.5, 0.5).width
    want = sorted(map(tuple, D.leaks(docs(texts), bench).collect()))
    found = []
    import pyarrow as pa

    for i in many:
        found += [(d, i.item_ids[k], *x) for d, k, *x in D.Searcher(i, 0.6, 0.5, 0.5).search(pa.array(texts))]
    assert [w[:2] for w in want] == [f[:2] for f in sorted(found)] and len(want) >= 60


def test_answer_must_be_there(spark, docs):
    bench = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda."), (2, "one two three four five six seven eight nine")], "item_id long, text string")
    rows = ["Alpha beta gamma delta epsilon zeta eta theta.", "x alpha beta gamma delta epsilon zeta eta theta iota kappa lambda y", "one two three four five six seven eight nine", "one two three four five six"]
    assert sorted((r.doc_id, r.item_id) for r in D.leaks(docs(rows), bench).collect()) == [(1, 1), (2, 2)]


def test_short_items_and_short_answers(spark, docs):
    """Items of a few words are found in texts of nothing else; a short answer may have a word changed."""
    items = [(1, "the"), (2, "weather report"), (3, "Is it raining?"), (4, "Alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda mu."), (5, "Sum of one and two? Three Ñ.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        "a report on the weather in the north", "The", "is it raining", "is it raining today", "Weather, report!", "weather report weather report",
        "x alpha beta gamma delta epsilon zeta eta theta iota kappa CHANGED mu y", "x alpha beta gamma delta epsilon zeta eta theta y", "sum of one and two three ñ", "one sum and three of two", "three of them and one sum",
    ]
    got = sorted((r.doc_id, r.item_id) for r in D.leaks(docs(rows), bench).collect())
    assert got == [(1, 1), (2, 3), (4, 2), (6, 4), (8, 5)]
    assert sorted(r.doc_id for r in D.drop_leaks(docs(rows), bench).collect()) == [0, 3, 5, 7, 9, 10]


def test_edge_cases(spark, docs):
    bench = spark.createDataFrame([(1, "Alpha beta gamma delta. Epsilon zeta eta."), (1, "Alpha beta gamma delta. Epsilon zeta eta."), (None, "x y z"), (3, None), (4, ""), (5, "...")], "item_id long, text string")
    hit = "alpha beta gamma delta epsilon zeta eta"
    rows = [(1, None), (2, ""), (None, hit), (4, hit), (4, hit), (5, "filler " * 50_000 + hit + " filler" * 50_000), (6, "?")]
    df = docs(rows, item_id=F.lit("q"), score=F.lit(None).cast("int"))
    assert sorted((str(r.doc_id), r.item_id) for r in D.leaks(df, bench).collect()) == [("4", 1), ("4", 1), ("5", 1), ("None", 1)]
    kept = D.drop_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 6]
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(df, none).count() == 0 and D.drop_leaks(df, none).count() == len(rows)
    assert D.leaks(docs([]), bench).count() == 0
