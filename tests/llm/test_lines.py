import random
from collections import Counter
from functools import cache

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import lines as L
from spanloom.llm.queries import op2_line_dedup

VOCAB = ["".join(random.Random(i).choices("abcdefgh", k=5)) for i in range(2000)]


def line(seed, n=40):
    return " ".join(random.Random(seed).choices(VOCAB, k=n))


def plain(t):
    return [x for x in ("".join(c for c in w.lower() if c.isalnum()) for w in t.split()) if x]


def brute_distance(a, b):
    @cache
    def d(i, j):
        if not i or not j:
            return i + j
        return min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    return d(len(a), len(b))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_similarity_is_edit_similarity(a, b):
    want = 1 - brute_distance(tuple(a), tuple(b)) / max(len(a), len(b), 1)
    assert L.similarity(a, b) == pytest.approx(want)
    for least in (0.5, 0.8, 0.9):
        got = L.similarity(a, b, least)
        assert got == pytest.approx(want) if want >= least else got < least


def brute(rows, least=L.MIN_SIMILARITY):
    """{row: text} that is left, by comparing all lines."""
    own = [(d, k, plain(x)) for d, t in rows for k, x in enumerate(t.split("\n")) if plain(x)]
    root = list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            if L.similarity(own[i][2], own[j][2], least) >= least:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    gone = {own[i][:2] for i in range(len(own)) if find(i) != i}
    return gone, {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows if any((d, k) not in gone for k in range(len(t.split("\n"))))}


def corpus():
    r = random.Random(3)
    rows = []
    for d in range(120):
        own = [line(1000 * d + k, r.randrange(8, 70)) for k in range(r.randrange(1, 6))] + [f"Short line {d}."]
        if d % 3 == 0 and d:
            pick = r.choice(rows[r.randrange(d)][1].split("\n"))
            own.insert(0, pick.upper() + "!")
        if d % 4 == 0 and d:
            pick = r.choice(rows[r.randrange(d)][1].split("\n")).split()
            for _ in range(len(pick) // 30):
                pick[r.randrange(len(pick))] = r.choice(VOCAB)
            own.append(" ".join(pick))
        rows.append((d, "\n".join(own)))
    rows.append((120, rows[5][1]))
    return rows


def test_against_brute_force(spark, docs):
    rows = corpus()
    gone, left = brute(rows)
    got = {(r.doc, r.line) for r in L.repeated_lines(docs(rows)).collect()}
    assert got <= gone and len(got) >= 0.95 * len(gone) and len(gone) > 40
    out = {r.doc_id: (r.text, r.n_chars) for r in L.dedup_lines(docs(rows)).collect()}
    assert all(len(t) == n for t, n in out.values())
    assert sum(out.get(d, ("",))[0] == t for d, t in left.items()) >= 0.97 * len(left)
    assert 120 not in out if got == gone else True


def test_recall_of_candidates(spark, docs):
    """Of pairs with the similarity, at least 0.9 are found, each pair on its own."""
    r = random.Random(9)
    rows, n = [], 300
    for i in range(n):
        own = line(50_000 + i, r.randrange(25, 80)).split()
        other = list(own)
        for _ in range(r.randrange(1, max(2, len(own) // 20))):
            other[r.randrange(len(own))] = r.choice(VOCAB)
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
    got = {x.doc for x in L.repeated_lines(docs(rows)).collect()}
    want = {2 * i + 1 for i in range(n) if L.similarity(plain(rows[2 * i][1]), plain(rows[2 * i + 1][1])) >= L.MIN_SIMILARITY}
    assert got <= want and len(got) >= 0.9 * len(want) > 200


def test_edge_cases(spark, docs):
    a, b, c = line(1), line(2), line(3, 30_000)
    rows = [(1, f"{a}\n{b}\n{a}"), (2, None), (3, ""), (4, a), (None, b), (5, f"{b}\nx"), (1, f"{a}\n{b}\n{a}"), (6, c), (7, c + " y"), (8, "\n\n"), (1, f"z\n{a}"), (9, "...")]
    df = docs(rows, doc=F.lit("q"), line=F.lit(1), txt=F.lit(None).cast("string"), __lines=F.lit(0))
    out = L.dedup_lines(df)
    assert out.columns == df.columns
    first = "z\n" + a  # of the rows with doc_id 1 the order is that of a hash; whichever comes first keeps the line
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    ones = [t for d, t in got if d == "1"]
    assert sorted(ones) in ([a, a, "z"], ["z\n" + a]) or ones == [first]
    assert [g for g in got if g[0] != "1"] == [("2", None), ("3", ""), ("5", "x"), ("6", c), ("8", "\n\n"), ("9", "..."), ("None", b)]
    assert L.dedup_lines(docs([])).collect() == []


def test_identical_rows_stay_alike(spark, docs):
    """Rows with the same doc_id and text don't take each other's lines, whether they are read at once or apart."""
    a, b, c = line(11), line(12), line(13)
    rows = [(1, f"{a}\n{b}\nYes."), (1, f"{a}\n{b}\nYes."), (2, f"{b}\n{c}"), (1, f"{a}\n{b}\nYes."), (None, c), (None, c)]
    want = [("1", rows[0][1])] * 3 + [("None", c)] * 2
    for n in (1, 6):
        assert sorted((str(r.doc_id), r.text) for r in L.dedup_lines(docs(rows).repartition(n)).collect()) == want


def test_form_that_is_everywhere_is_spread(spark, docs):
    """Of a line that all documents have, texts that are read at once send one occurrence to the task of its form."""
    n = pa.array(range(500), pa.int64())
    batch = pa.RecordBatch.from_arrays([n, n, pa.array(["All rights reserved here by all of the authors."] * 500)], ["doc", "txt", "text"])
    (got,) = L.normal_lines(0.9, 1)(iter([batch]))
    again = got.column("again").to_pylist()
    assert again == [False] + [True] * 499 and got.column("sig").null_count == 499 and len(set(got.column("h1").to_pylist())) == 500
    out = L.dedup_lines(docs(["All rights reserved here."] * 300 + [f"x{i}\nAll RIGHTS reserved here" for i in range(300)])).collect()
    assert sorted(r.text for r in out) == sorted(["All rights reserved here.", *(f"x{i}" for i in range(300))])


def test_buckets_flow_over_batches():
    """All pairs of a bucket are found wherever batches end."""
    keys = [k for k in range(3000) for _ in range(k % 7)]
    n = len(keys)
    cols = [pa.array(keys, pa.int64()), pa.array(range(n), pa.int64()), pa.array([20] * n, pa.int32()), pa.array([7] * n, pa.int64())]
    for size in (1000, 50_000, 10**6):
        batches = [pa.RecordBatch.from_arrays([c.slice(lo, size) for c in cols], ["key", "id", "n", "odd"]) for lo in range(0, n, size)] * 1
        out = pa.Table.from_batches(list(L.partners(0.9)(iter(batches)))).to_pylist()
        hot = {r["key"] for r in out if r["key"] >= 0}
        got = {(r["a"], r["b"]) for r in out if r["key"] < 0}
        assert got == {(i, j) for i in range(n) for j in range(i + 1, min(n, i + 7)) if keys[i] == keys[j] and keys[i] not in hot}
        assert all(sum(r["key"] == k for r in out) == keys.count(k) for k in list(hot)[:20])


def test_copies_of_one_line_that_are_far_from_each_other(spark, docs):
    """Each copy is near the base and few are near each other: a copy mustn't take the base out of a bucket."""
    r = random.Random(4)
    rows = []
    for group, size in enumerate((10, 30, 100, 1000)):
        base = line(90_000 + group, 60).split()
        rows.append((10_000 * group + 5000, " ".join(base)))
        for k in range(size):
            own = list(base)
            for at in r.sample(range(60), 5):
                own[at] = f"w{r.randrange(10**9)}"
            rows.append((10_000 * group + (k if k < size // 2 else 5001 + k), " ".join(own)))
    got = Counter(x.doc // 10_000 for x in L.repeated_lines(docs(rows)).collect())
    want = {0: 10, 1: 30, 2: 100, 3: 1000}  # all but one of each, as all are near the base
    assert all(0.9 * n <= got[g] <= n for g, n in want.items())


@pytest.mark.parametrize("words, changed", [(10, 1), (12, 1), (20, 2), (30, 3), (40, 3), (60, 5), (100, 10)])
def test_recall_of_pairs_just_above_the_similarity(words, changed):
    r = random.Random(words)
    rows = []
    for i in range(400):
        own = line(70_000 + i, words).split()
        rows.append(" ".join(own))
        for at in r.sample(range(words), changed):
            own[at] = f"w{r.randrange(10**9)}"
        rows.append(" ".join(own))
    n = pa.array(range(len(rows)), pa.int64())
    lines = pa.Table.from_batches(L.normal_lines(0.9, 1)(iter([pa.RecordBatch.from_arrays([n, n, pa.array(rows)], ["doc", "txt", "text"])])))
    spread = L.spread(iter(lines.select(["doc", "n", "sig"]).combine_chunks().to_batches()))
    buckets = pa.Table.from_batches(list(spread)).sort_by([("key", "ascending"), ("id", "ascending")]).combine_chunks()
    met = pa.Table.from_batches(list(L.partners(0.9)(iter(buckets.to_batches()))))
    got = {(min(a, b), max(a, b)) for k, a, b in zip(*(met[c].to_pylist() for c in ("key", "a", "b"))) if k < 0}
    want = {(2 * i, 2 * i + 1) for i in range(400) if L.similarity(plain(rows[2 * i]), plain(rows[2 * i + 1])) >= 0.9}
    assert len(want) == 400 and len(want & got) >= 0.93 * len(want)


def test_short_lines_and_scripts_without_spaces(spark, docs, tmp_path):
    """The query removes exact repeats of any length, and near copies where white space doesn't part words."""
    han = "".join(chr(0x4E00 + random.Random(7).randrange(9000) + k) for k in range(40))
    thai = "".join(chr(0x0E01 + k) for k in random.Random(8).choices(range(40), k=30))
    rows = [f"All rights reserved.\na0\n{han}", f"ALL RIGHTS RESERVED\na1\n{han[:20]}一{han[21:]}", f"a2\n...\n{thai}", f"a3\n...\n\nHome\n{thai}", "Home\na4\nAll rights"]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: rows[0], 1: "a1", 2: rows[2], 3: "a3\n...\n\nHome", 4: "a4\nAll rights"}
