import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import bpe

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
WANT = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load())


def check(encoder, texts):
    ids, begin, offsets, _ = encoder.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        own = ids[offsets[i] : offsets[i + 1]].tolist()
        assert own == WANT.encode_ordinary(t or ""), t
        raw = (t or "").encode()
        for k, b in zip(own, begin[offsets[i] : offsets[i + 1]].tolist()):
            assert raw[b : b + len(encoder.v.tokens[k])] == encoder.v.tokens[k]


def test_known_shapes(encoder):
    check(encoder, ["", "a", " ", "  ", "Hello world", "it's we're I'll they've I'd 'm don''t", "x  y\n\n z \t", "\n", "\n\n's", " 's", "a\n 's", "!'s", "1's '", "'", "''", "  'll", "é ñ 漢字 🙂🙂", " x　 y", "12 34a5", "=" * 500, "ab" * 300 + " " * 77, "a'S b'T", "\x1cx\x1f y\x85z"])


def test_machine_matches_at_row_borders(encoder):
    r = random.Random(4)
    check(encoder, ["".join(r.choices(list("ab1 .'\nstrevlmd é\t"), k=n)) for n in (255, 256, 257, 511, 512, 513, 3000, 20_000)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list("ab'stmdrelv 1.\n\t")), st.characters(exclude_categories=["Cs", "Cn", "Co"], max_codepoint=0xFFFF)), max_size=60), min_size=1, max_size=5))
def test_any_text(texts):
    check(_own(), texts)


def _own(held=[]):
    if not held:
        held.append(bpe.Encoder(bpe.load()))
    return held[0]


def test_vector_merge_is_heap_merge(encoder):
    r = random.Random(6)
    own = [bytes(r.choices(b"abcdeilnorst", k=r.randrange(1, 40))) for _ in range(500)]
    ids, n = encoder.merge(own)
    assert np.split(ids, np.cumsum(n)[:-1])[-1] is not None
    for o, got in zip(own, np.split(ids, np.cumsum(n)[:-1])):
        assert got.tolist() == encoder.merge_one(o)


def test_begins_anew_without_change(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    check(encoder, ["one two three four five six"])
    check(encoder, ["one two seven"])


def test_round_trip_and_edge_cases(spark, docs):
    long = "".join(random.Random(1).choices("abc de.\n", k=300_000))
    rows = [(1, "Hello, it's me"), (2, None), (3, ""), (None, "x"), (1, "Hello, it's me"), (5, long), (6, "漢字🙂\n")]
    df = docs(rows, token_ids=F.lit(1), n_tokens=F.lit("a"))
    got = bpe.encode(df)
    out = got.collect()
    assert [r.round_trip for r in out] == [True, None, True, True, True, True, True]
    assert out[1].token_ids is None and out[2].token_ids == [] and out[0].token_ids == out[4].token_ids == WANT.encode_ordinary(rows[0][1])
    assert [(r.doc_id, r.text) for r in bpe.decode(got).collect()] == rows
    assert bpe.encode(docs([])).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [70_000])], "doc_id long, token_ids array<int>")).collect()
