import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import toxicity as T

VOCAB = ["".join(random.Random(i).choices("abcdefgh", k=6)) for i in range(800)]
BAD = ["zorgle", "zorglen", "quxit", "vlimp"]


def text(seed, bad):
    r = random.Random(seed)
    own = [r.choices(VOCAB, k=r.randrange(4, 15)) for _ in range(r.randrange(1, 10))]
    if bad:
        own[r.randrange(len(own))].insert(0, r.choice(BAD))
    return "".join(" ".join(s).capitalize() + r.choice([". ", "!\n", "? "]) for s in own)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab. !?\n\")")), max_size=40), min_size=1, max_size=4))
def test_sentences_both_ways(texts):
    codes, cut, docs, distinct = T.sentences_of(pa.array(texts))
    names = distinct.to_pylist()
    for i, t in enumerate(texts):
        want = [own for *_, own in T.spans(t)]
        got = [[names[c] for c in codes[cut[k] : cut[k + 1]]] for k in range(docs[i], docs[i + 1])]
        assert got == want
        assert all(t[b:e].split() == own for b, e, own in T.spans(t))


def test_gradient_finds_sentences(spark, docs):
    rows = [text(i, i % 4 == 0) for i in range(700)]
    labels = spark.createDataFrame([(i, 1 - i % 2, int(i % 4 == 0)) for i in range(500)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = T.train(docs(rows), labels)
    assert model.bias < 0
    got = {r.doc_id: r for r in T.detect(docs(rows), model).collect()}
    held = range(500, 700)
    assert sum(i in got for i in held if i % 4 == 0) >= 0.95 * 50 and not any(i in got for i in held if i % 4)
    for r in got.values():
        assert all(rows[r.doc_id][s.begin : s.end] == s.text for s in r.sentences)
        assert any(b in s.text.lower() for s in r.sentences for b in BAD)


def test_slopes_are_those_of_the_likelihood():
    """Against the likelihood by plain loops, and its numeric derivatives."""
    r = random.Random(6)
    texts = [text(i, i % 3 == 0) for i in range(12)]
    toxic = [int(i % 3 == 0) for i in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64()), pa.array(range(12), pa.int64()), pa.array(toxic, pa.int32()), pa.array(texts)], ["doc", "txt", "toxic", "text"])
    names = sorted({f for t in texts for *_, own in T.spans(t) for w in own for f in T.features("".join(c for c in w.lower() if c.isalnum()))})
    e = T.gather(pa.Table.from_batches(list(T.encoded(set(names))(iter([batch])))), names)
    w, b = np.array([r.gauss(0, 0.3) for _ in names]), -1.5

    def loss(w, b):
        out, weight = 0.0, dict(zip(names, w))
        for t, y in zip(texts, toxic):
            clean = 1.0
            for *_, own in T.spans(t):
                z = b + sum(weight[f] for x in own for f in T.features("".join(c for c in x.lower() if c.isalnum())))
                clean *= 1 - 1 / (1 + np.exp(-z))
            out -= np.log(1 - clean if y else clean)
        return out

    got, gw, gb = T.slopes(w, b, e)
    assert got == pytest.approx(loss(w, b))
    assert gb == pytest.approx((loss(w, b + 1e-5) - loss(w, b - 1e-5)) / 2e-5, abs=1e-4)
    for k in r.sample(range(len(names)), 15):
        step = np.eye(len(names))[k] * 1e-5
        assert gw[k] == pytest.approx((loss(w + step, b) - loss(w - step, b)) / 2e-5, abs=1e-4)


def test_sample_is_bounded_by_characters(spark, docs):
    rows = [text(i, i % 4 == 0) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    assert T.train(docs(rows), labels, chars=0) == T.Model({}, -30.0)
    assert T.train(docs(rows), labels, chars=10**9) == T.train(docs(rows).repartition(7), labels)


def test_noisy_or(spark, docs):
    model = T.Model({"bad": 3.0, "wor*": 2.0}, -4.0)
    (r,) = T.detect(docs(["So bad. Words bad worse! fine.", "bad", "all well. here"]), model).collect()
    p = [1 / (1 + np.exp(4 - z)) for z in (3.0, 3 + 2 + 2, 0.0)]
    assert r.doc_id == 0 and r.score == pytest.approx(1 - np.prod([1 - x for x in p]))
    assert [s.text for s in r.sentences] == ["Words bad worse!"]


def test_edge_cases(spark, docs):
    model = T.Model({"bad": 9.0}, -4.0)
    rows = [(1, None), (2, ""), (None, "bad"), (3, "bad"), (3, "bad"), (4, "fine. " * 60_000 + "bad"), (5, "...\n\n")]
    df = docs(rows, score=F.lit("x"), sentences=F.lit(None).cast("int"))
    got = T.detect(df, model).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "4", "None"]
    assert [len(r.sentences) for r in got if r.doc_id == 3] == [1, 1]
    assert T.detect(docs([]), model).count() == 0
    none = T.train(docs([]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert T.detect(docs(["a b. c"]), none).count() == 0
