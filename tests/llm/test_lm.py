import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import lm


def prepared(t):
    return "\x02" * 4 + "".join("0" if c in "0123456789" else c for c in t.lower())


def brute(rows, held_ids):
    """{doc: log probability} with the same model, by dictionaries."""
    train, held = Counter(), Counter()
    for d, t in rows:
        s = prepared(t)
        for i in range(4, len(s)):
            (held if d in held_ids else train)[s[i - 4 : i + 1]] += 1
    every = {*train, *held}
    n = [Counter() for _ in range(6)]
    of = [Counter() for _ in range(6)]
    for g, c in train.items():
        for k in range(1, 6):
            n[k][g[5 - k :]] += c
            of[k][g[5 - k : 4]] += c
    base = 1 / (len({g[4] for g in every}) + 1)
    weights = [[0.0] + [0.5] * 23 for _ in range(5)]
    place = lambda c: 0 if not c else min(int(math.log2(c)) + 1, 23)

    def chain(g):
        p, out = base, []
        for k in range(1, 6):
            c = of[k][g[5 - k : 4]]
            b = place(c)
            own = weights[k - 1][b] * (n[k][g[5 - k :]] / c if c else 0)
            p = own + (1 - weights[k - 1][b]) * p
            out.append((own / p, b, p))
        return out

    for _ in range(lm.ROUNDS):
        took, reached = Counter(), Counter()
        for g, c in held.items():
            reach = float(c)
            for k in range(5, 0, -1):
                share, b, _ = chain(g)[k - 1]
                took[k, b] += reach * share
                reached[k, b] += reach
                reach -= reach * share
        for (k, b), r in reached.items():
            if b and r > 0:
                weights[k - 1][b] = min(max(took[k, b] / r, 1e-6), 1 - 1e-6)
    return {d: sum(math.log(chain(s[i - 4 : i + 1])[4][2]) for s in [prepared(t)] for i in range(4, len(s))) for d, t in rows}


def corpus(n=60):
    r = random.Random(1)
    vocab = ["".join(r.choices("abcde", k=r.randrange(2, 6))) for _ in range(40)]
    return [(i, " ".join(r.choices(vocab, k=r.randrange(1, 50))).capitalize() + f". {i}") for i in range(n)]


@pytest.mark.parametrize("most", [10**9, 0])
def test_against_brute_force(spark, docs, most):
    rows = corpus()
    df = docs(rows)
    held = {r.doc_id for r in df.where(F.pmod(F.xxhash64("text"), F.lit(lm.HELD_OUT)) == 0).collect()}
    want = brute(rows, held)
    got = {r.doc_id: r for r in lm.score(df, most).collect()}
    assert len(got) == len(rows) and 1 < len(held) < 20
    for d, t in rows:
        assert got[d].n_chars == len(t)
        assert got[d].log_prob == pytest.approx(want[d], rel=1e-9)
        assert got[d].bits_per_char == pytest.approx(-want[d] / len(t) / math.log(2), rel=1e-9)


def test_both_ways_give_the_same(spark, docs):
    rows = [*corpus(40), (100, "漢字 \U0001F600 " * 300), (101, "x"), (102, corpus(1)[0][1])]
    one, two = ({r.doc_id: r.log_prob for r in lm.score(docs(rows), most).collect()} for most in (10**9, 0))
    assert one.keys() == two.keys() and all(one[d] == pytest.approx(two[d], rel=1e-12) for d in one)


def test_copies_are_held_out_together(spark, docs):
    """All copies of a text are on one side, so weights aren't learnt on texts that were counted."""
    rows = [(i, f"text number {i % 30} of thirty") for i in range(300)]
    table = lm.estimates(docs(rows)).where("held > 0 and p5 > 0").collect()
    held = {r.t for r in docs(rows).where(F.pmod(F.xxhash64("text"), F.lit(lm.HELD_OUT)) == 0).select(F.col("text").alias("t")).distinct().collect()}
    assert 0 < len(held) < 30 and all(r.held % 10 == 0 for r in table)


def test_junk_scores_worse(spark, docs):
    rows = corpus(200) + [(1000, "".join(random.Random(3).choices("abcde ", k=200)))]
    got = {r.doc_id: r.bits_per_char for r in lm.score(docs(rows)).collect()}
    assert got[1000] > np.percentile([got[i] for i in range(200)], 90)


def test_many_symbols_and_flushes(monkeypatch):
    import pyarrow as pa

    texts = ["".join(chr(0x4E00 + (i * 7 + k) % 9000) for k in range(6000)) for i in range(2)] + ["abc abc"]
    want = Counter()
    for t in texts:
        s = prepared(t)
        want.update(s[i - 4 : i + 1] for i in range(4, len(s)))
    for flush in (3_000_000, 1000):
        monkeypatch.setattr(lm, "FLUSH", flush)
        got = Counter()
        for b in lm.count(iter([pa.RecordBatch.from_arrays([pa.array([0, 1, 0]), pa.array(texts)], ["out", "text"])])):
            for g, a, h in zip(*(c.to_pylist() for c in b.columns)):
                got[g] += a + h
        assert got == want


@pytest.mark.parametrize("most", [10**9, 0])
def test_edge_cases(spark, docs, most):
    rows = [(1, None), (2, ""), (None, "abc abd"), (3, "abc abd"), (3, "abc abd"), (4, "ab c" * 50_000), (5, "\x00\x02")]
    df = docs(rows, gram=F.lit(1), held=F.lit("x"), log=F.lit(None).cast("int"))
    got = lm.score(df, most).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_chars is None and by[1].log_prob is None and by[2].n_chars == 0 and by[2].log_prob == 0 and by[2].bits_per_char is None
    assert by[4].n_chars == 200_000 and len({r.log_prob for r in got if r.doc_id in (3, None)}) == 1
    assert lm.score(docs([]), most).count() == 0
