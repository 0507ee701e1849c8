import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import simhash
from spanloom.llm.common import GOLDEN, stars

VOCAB = ["".join(random.Random(i).choices("abcdefgh", k=5)) for i in range(3000)]


def text(seed, n=80):
    return " ".join(random.Random(seed).choices(VOCAB, k=n))


def changed(t, seed, share=0.04):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) if r.random() < share else w for w in t.split())


def brute_signature(t):
    ws = {"".join(c for c in w.lower() if c.isalnum()) for w in t.split()} - {""}
    v = np.zeros(512, int)
    for w in ws:
        x = np.uint64(xxhash.xxh3_64_intdigest(w))
        out = []
        for i in range(1, 9):
            y = x + np.uint64(i * GOLDEN % 2**64)
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                y = (y ^ (y >> np.uint64(shift))) * np.uint64(by)
            out.append((y ^ (y >> np.uint64(31))) & np.uint64(2**54 - 1))
        v += np.unpackbits(np.array(out).view(np.uint8), bitorder="little")
    return np.packbits(v * 2 > len(ws), bitorder="little").view(np.uint64)


def brute_groups(rows, k=simhash.MAX_DISTANCE):
    sigs = [(i, brute_signature(t)) for i, t in rows if i is not None and t and any(c.isalnum() for c in t)]
    root = {i: i for i, _ in sigs}

    def find(i):
        return i if root[i] == i else find(root[i])

    for x, (i, a) in enumerate(sigs):
        for j, b in sigs[:x]:
            if np.bitwise_count(a ^ b).sum() <= k:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root if find(i) != i}


def test_signatures_match_brute_force():
    texts = [text(i, 1 + i * 9) for i in range(40)] + ["", "?!", "a", "A a. a"]
    got, some = simhash.signatures(pa.array(texts))
    for t, g, s in zip(texts, got, some):
        assert s == any(c.isalnum() for c in t)
        if s:
            assert (brute_signature(t) == g).all()


def test_groups_against_brute_force(spark, docs):
    rows = [(i, text(i, 20 + i % 90)) for i in range(150)]
    for i in range(150, 300):
        rows.append((i, changed(rows[i % 60][1], i)))
    rows += [(300 + i, rows[7][1].upper() + "!") for i in range(25)]
    got = {r.doc_id: r.kept_doc_id for r in simhash.near_duplicates(docs(rows)).collect()}
    want = brute_groups(rows)
    assert set(got.items()) <= set(want.items()) or all(i in want for i in got)
    assert sum(i in got for i in want) >= 0.9 * len(want)
    assert sum(got.get(i) == want[i] for i in want) >= 0.9 * len(want)


def test_pairs_recall(spark):
    """Of all pairs within the distance, at least 0.9 share a bucket and pass the chain there."""
    base = [text(i, 100) for i in range(200)]
    a, _ = simhash.signatures(pa.array(base))
    b, _ = simhash.signatures(pa.array([changed(t, i, 0.06) for i, t in enumerate(base)]))
    near = np.bitwise_count(a ^ b).sum(axis=1) <= simhash.MAX_DISTANCE
    hit = np.zeros(len(a), bool)
    for j in range(simhash.SEGMENTS):
        same = simhash.segment(a, j) == simhash.segment(b, j)
        hit |= same & simhash.within(a, b, np.full(len(a), j))
    assert near.sum() > 150 and not (hit & ~near).any()
    assert hit.sum() >= 0.9 * near.sum()


def test_edge_cases(spark, docs):
    long = text(5, 60_000)
    rows = [(1, None), (2, ""), (3, "..."), (4, None), (5, long), (6, long), (None, long), (7, "solo unique words here"), (7, "solo unique words here"), (9, "")]
    df = docs(rows, sig=F.lit(1), id=F.lit("x"), key=F.lit(None).cast("string"), a=F.lit(2), __key=F.lit(0))
    assert [tuple(r) for r in simhash.near_duplicates(df).collect()] == [(6, 5)]
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert kept.count() == len(rows) - 1
    assert simhash.near_duplicates(docs([])).collect() == []


def test_long_buckets_flow_over_batches():
    t = text(1)
    sigs, _ = simhash.signatures(pa.array([t, text(2)] * 2))
    rows = [pa.RecordBatch.from_arrays([pa.array([5] * 60_000, pa.int32()), pa.array(range(lo, lo + 60_000), pa.int64()), simhash.binary(simhash.packed(np.repeat(sigs[:1], 60_000, axis=0)))], ["key", "id", "sig"]) for lo in range(0, 240_000, 60_000)]
    pairs = pa.Table.from_batches(list(simhash.link(72, 6)(iter(rows))))
    assert pairs.num_rows == 239_999 and set(pairs["a"].to_pylist()) == {0}


def test_stars(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (None, 3)]
    near = defaultdict(set)
    for a, b in edges:
        if a is not None:
            near[a].add(b)
            near[b].add(a)
    want, seen = {}, set()
    for s in sorted(near):
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                want[x] = s
                todo += near[x]
    got = {x.node: x.root for x in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k != v}


@pytest.mark.parametrize("share", [0.08, 0.1, 0.12, 0.14])
@pytest.mark.parametrize("n", [100, 400])
def test_pairs_recall_of_more_changes(share, n):
    """Of all pairs within the distance, at least 0.9 are linked, whatever the share of changed words."""
    base = [text(i, n) for i in range(300)]
    rows = base + [changed(t, i, share) for i, t in enumerate(base)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(rows)], ["id", "text"])
    signed = pa.Table.from_batches(list(simhash.sign(iter([batch])))).combine_chunks()
    sigs = simhash.unpacked(signed["sig"])
    near = np.bitwise_count(sigs[:300] ^ sigs[300:]).sum(axis=1) <= simhash.MAX_DISTANCE
    buckets = pa.Table.from_batches(list(simhash.spread(iter(signed.to_batches())))).sort_by([("key", "ascending"), ("id", "ascending")]).combine_chunks()
    linked = pa.Table.from_batches(list(simhash.link(simhash.MAX_DISTANCE, simhash.CHAIN)(iter(buckets.to_batches()))))
    got = set(zip(linked["a"].to_pylist(), linked["b"].to_pylist()))
    hit = np.array([(i, i + 300) in got for i in range(300)])
    print(share, n, near.sum(), hit.sum() / near.sum())
    assert near.sum() > 100 and not (hit & ~near).any()
    assert hit.sum() >= 0.9 * near.sum()
