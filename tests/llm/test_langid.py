import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import langid as L

PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "c", "▁ab", "cc", "bb"]


def brute(word, p):
    """Sum over all segmentations of ▁word."""
    word = "▁" + word
    place = {x: i for i, x in enumerate(PIECES)}

    def rest(i):
        if i == len(word):
            return np.ones(p.shape[1])
        total = np.zeros(p.shape[1])
        for j in range(i + 1, len(word) + 1):
            k = place.get(word[i:j], len(PIECES) if j == i + 1 else None)
            if k is not None:
                total = total + p[k] * rest(j)
        return total

    return np.log(rest(0))


def test_forward_sums_all_segmentations():
    r = random.Random(1)
    p = np.random.default_rng(1).random((len(PIECES) + 1, 3))
    forms = ["", "a", "z"] + ["".join(r.choices("abcz", k=r.randrange(1, 12))) for _ in range(60)]
    got = L.forward(*L.Lattice(PIECES).of(forms), p)
    assert np.allclose(got, [brute(f, p) for f in forms])


def test_long_words_dont_underflow():
    p = np.full((len(PIECES) + 1, 2), 1e-6)
    got = L.forward(*L.Lattice(PIECES).of(["ab" * 5000, "a"]), p)
    assert np.isfinite(got).all() and got[0, 0] < -5000


def test_em_raises_likelihood():
    counts = {"x": {"abab": 5, "aba": 3, "cc": 2}, "y": {"bb": 4, "c": 9}}
    likelihood = []
    for rounds in (1, 3, 8):
        m = L.fit(counts, PIECES, rounds)
        lx = L.forward(*L.Lattice(PIECES).of(list(counts["x"])), m.p)[:, m.langs.index("x")]
        likelihood.append(float(lx @ list(counts["x"].values())))
        assert m.p[:-1].sum(axis=0) == pytest.approx([1, 1], abs=1e-3)
    assert likelihood == sorted(likelihood)


WORDS = {lang: ["".join(random.Random(f"{lang}{i}").choices(s, k=3)).replace(" ", "") for i in range(200)] for lang, s in {"en": ["th", "er", "on", "an", "re", "he"], "de": ["sch", "en", "ch", "ei", "ung", "ü"], "fr": ["eau", "ou", "é", "ai", "que", "eux"]}.items()}


def corpus(n=120):
    out = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        out.append((i, lang, " ".join(random.Random(i).choices(WORDS[lang], k=5 + i % 40))))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(600)
    make = lambda some: spark.createDataFrame(some, "doc_id long, lang string, text string")
    model = L.train(make(rows[:300]), per_language=60)
    got = L.identify(make(rows[300:]), model).collect()
    want = {i: lang for i, lang, _ in rows[300:]}
    assert sum(r.predicted == want[r.doc_id] for r in got) >= 0.98 * len(want)
    assert all(r.accepted for r in got)


def test_scores_match_brute_force(spark):
    rows = corpus(60)
    model = L.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    scorer = L.Scorer(model)
    lattice = L.Lattice(model.pieces)
    for _, _, text in rows[:10]:
        want = sum(L.forward(*lattice.of([w]), model.p)[0] for w in text.split())
        assert np.allclose(scorer.score(pa.array([text + " 123 x9 !!"]))[0, :-2], want)


def test_edge_cases(spark, docs):
    model = L.train(spark.createDataFrame(corpus(90) + [(None, "en", "x"), (1, None, "y"), (2, "en", None)], "doc_id long, lang string, text string"))
    good = " ".join(WORDS["en"][:20])
    rows = [(1, None), (2, ""), (3, "1234 !!"), (4, good), (4, good), (None, good), (5, good * 3000), (6, "漢字仮名 " * 5), (7, "qzxjkqwv xqjzkvw zzqxk")]
    df = docs(rows, predicted=F.lit(1), accepted=F.lit("no"))
    got = {(r.doc_id): r for r in L.identify(df, model).collect()}
    assert {k for k, r in got.items() if r.accepted} == {4, None, 5}
    assert got[1].predicted is None and got[3].posterior is None and got[4].predicted == "en"
    assert math.isclose(got[4].posterior, 1, abs_tol=0.01)
    kept = L.keep_identified(df, model)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "5", "None"]
    nothing = L.train(docs([]))
    assert L.identify(df, nothing).where("accepted").count() == 0 and L.identify(docs([]), model).count() == 0
