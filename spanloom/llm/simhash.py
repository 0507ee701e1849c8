"""SimHash near-duplicates of whole documents, candidates pruned by the pigeonring principle.

A document's signature has 432 bits, in 8 words of 3 segments of 18 bits, from the set of its words (lower case, letters
and digits only). Of m = 24 segments on a ring, a pair of signatures at a distance of at most k has a start from
which every run of l segments differs in at most l * k / m bits. Documents meet in the buckets of the segments that
they share bit by bit; there, the runs that begin with the shared segment are held against that budget, and only
pairs that stay within it get the full Hamming check.

A start without any difference isn't certain when k >= m: with words changed in about 4 per cent of places, a segment is
shared with a probability of 0.15 to 0.25, and one of 24 by more than 0.95 of pairs, but at 14 per cent by 0.7. So
documents also meet in the buckets of 8 bands, each of 5 least hashes of the set of words; there, pairs get the full
Hamming check at once. A pair with a Jaccard similarity of 0.75 shares a band with a probability of 0.88. The search stays
approximate.
In a bucket each signature is compared with the leaders (those that matched none before) instead of with all others:
work in a bucket of copies is linear in its size. Random meetings grow with the square of
the number of distinct signatures over 2 ** SEGMENT.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, binary, checkpoint, fixed, mix, plain, run_starts, semi, slices, stars, words

WORDS, PER_WORD, SEGMENT = 8, 3, 18
SEGMENTS = WORDS * PER_WORD
BYTES = -(-PER_WORD * SEGMENT // 8)  #: of a word that segments are in
USED = np.uint64((1 << PER_WORD * SEGMENT) - 1)
PART = np.uint64((1 << SEGMENT) - 1)
MAX_DISTANCE, CHAIN = 72, 6
BANDS, ROWS, BAND_BITS = 8, 5, 27  #: bands of least hashes; their keys begin above those of segments
FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(GOLDEN)).reshape(BANDS, ROWS) | np.uint64(1)
SEEDS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(GOLDEN)


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of 8 words, whether the text has any word). Ties between ones and zeros count as zero."""
    sigs, _, some = signed(texts)
    return sigs, some


def signed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of 8 words, rows of BANDS keys, whether the text has any word)."""
    codes, offsets, distinct = words(texts)
    of, forms = plain(distinct)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    word = of[codes]
    every = hashed(forms)
    sigs, n = sketch(doc[word >= 0], word[word >= 0], len(offsets) - 1, every, WORDS, USED)
    return sigs, bands(doc[word >= 0], word[word >= 0], len(offsets) - 1, every), n > 0


def bands(doc: np.ndarray, word: np.ndarray, docs: int, base: np.ndarray) -> np.ndarray:
    """Keys of BANDS buckets for each text, from pairs of a text and one of its words, sorted by text; 0 if it has none."""
    out = np.zeros((docs, BANDS), np.int32)
    begin = run_starts(doc)
    if len(begin):
        for j in range(BANDS):
            key = np.full(len(begin), j + 1, np.uint64)
            for factor in FACTORS[j]:
                key = mix(key ^ np.minimum.reduceat((base * factor)[word], begin))
            out[doc[begin], j] = (key >> np.uint64(64 - BAND_BITS)).astype(np.int32) | np.int32(j + 1 << BAND_BITS)
    return out


def hashed(forms: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, forms), np.uint64, len(forms))


def sketch(doc: np.ndarray, word: np.ndarray, docs: int, base: np.ndarray, width: int, used: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(rows of width words of signature, distinct words of each text) from pairs of a text and one of its words; base: the hash of each word."""
    lanes = np.unpackbits((mix(base[:, None] + SEEDS[None, :width]) & used).view(np.uint8).reshape(len(base), width * 8), axis=1, bitorder="little").view(np.uint64)
    key = np.sort((doc << 32) | word)
    key = key[run_starts(key)]
    doc, word = key >> 32, key & 0xFFFFFFFF
    n = np.bincount(doc, minlength=docs)
    ends = np.concatenate([[0], np.cumsum(n)])
    # eight counters of a byte share a word, so at most 255 rows are added before they are widened
    cuts = np.unique(np.concatenate([ends, np.arange(0, len(word), 255)]))
    few = np.zeros((max(0, len(cuts) - 1), width * 8), np.uint64)
    for i, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        np.add.reduce(lanes.take(word[lo:hi], axis=0), axis=0, out=few[i])
    few = few.view(np.uint8).reshape(-1, width * 64)
    at = np.searchsorted(cuts, ends)
    bits = np.zeros((docs, width * 64), bool)
    one = np.flatnonzero(np.diff(at) == 1)
    bits[one] = few[at[one]] > (n[one] // 2)[:, None].astype(np.uint8)
    many = np.flatnonzero(np.diff(at) > 1)
    for row in many.tolist():
        bits[row] = few[at[row] : at[row + 1]].sum(axis=0, dtype=np.int32) * 2 > n[row]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1, width), n


def segment(sigs: np.ndarray, j: np.ndarray | int) -> np.ndarray:
    """The j-th segment of each signature."""
    j = np.broadcast_to(np.asarray(j) % SEGMENTS, len(sigs))
    return (sigs[np.arange(len(sigs)), j // PER_WORD] >> (j % PER_WORD * SEGMENT).astype(np.uint64)) & PART


def within(a: np.ndarray, b: np.ndarray, start: np.ndarray, k: int = MAX_DISTANCE, chain: int = CHAIN) -> np.ndarray:
    """Which pairs pass: the budget of every run from start, up to chain segments, then the Hamming check."""
    x = a ^ b
    ok = np.arange(len(x))
    used = np.zeros(len(x), np.int64)
    for step in range(chain):
        used = used + np.bitwise_count(segment(x[ok], start[ok] + step))
        keep = used <= (step + 1) * k // SEGMENTS
        ok, used = ok[keep], used[keep]
    out = np.zeros(len(x), bool)
    out[ok] = np.bitwise_count(x[ok] & USED).sum(axis=1) <= k
    return out


def linked(key: np.ndarray, ids: np.ndarray, sigs: np.ndarray, k: int, chain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leader, member) of rows sorted by key, then id; and the rows that are leaders."""
    left, right, leaders = [], [], []
    active = np.arange(len(key))
    while len(active):
        starts = run_starts(key[active])
        lead = active[starts]
        leaders.append(lead)
        of = np.repeat(lead, np.diff(np.append(starts, len(active))))
        rest = np.ones(len(active), bool)
        rest[starts] = False
        of, member = of[rest], active[rest]
        ring = key[of] < 1 << BAND_BITS
        hit = np.zeros(len(of), bool)
        hit[ring] = within(sigs[of[ring]], sigs[member[ring]], key[of[ring]] >> SEGMENT, k, chain)
        hit[~ring] = np.bitwise_count((sigs[of[~ring]] ^ sigs[member[~ring]]) & USED).sum(axis=1) <= k
        left.append(ids[of[hit]])
        right.append(ids[member[hit]])
        active = member[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), np.sort(np.concatenate([none, *leaders]))


def packed(sigs: np.ndarray) -> np.ndarray:
    """Rows of bytes, without the byte of each word that has no segment."""
    return np.ascontiguousarray(sigs).view(np.uint8).reshape(len(sigs), WORDS, 8)[:, :, :BYTES].reshape(len(sigs), WORDS * BYTES)


def unpacked(column: pa.Array) -> np.ndarray:
    out = np.zeros((len(column), WORDS, 8), np.uint8)
    out[:, :, :BYTES] = fixed(column, WORDS * BYTES).reshape(-1, WORDS, BYTES)
    return out.view(np.uint64).reshape(-1, WORDS)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            sigs, keys, some = signed(batch.column(1).slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).filter(pa.array(some)), binary(packed(sigs[some])), binary(keys[some].view(np.uint8))], ["id", "sig", "bands"])


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment, whose place on the ring and bits are the key of a bucket, and for each band."""
    for batch in batches:
        sigs = unpacked(batch.column(1))
        own = fixed(batch.column(2), 4 * BANDS).view(np.int32)
        keys = np.concatenate([np.stack([segment(sigs, j).astype(np.int32) | np.int32(j << SEGMENT) for j in range(SEGMENTS)], axis=1), own], axis=1).ravel() if len(sigs) else np.zeros(0, np.int32)
        at = pa.array(np.repeat(np.arange(len(sigs)), SEGMENTS + BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], ["key", "id", "sig"])


def link(k: int, chain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(last: bool):
            key, ids, sigs = (np.concatenate(x) for x in zip(*held))
            a, b, leaders = linked(key, ids, sigs, k, chain)
            held.clear()
            if not last:  # of the bucket that may go on, only the leaders are needed
                go = leaders[key[leaders] == key[-1]]
                held.append((key[go], ids[go], sigs[go]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append((np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1)), unpacked(batch.column(2))))
                size += batch.num_rows
                if size >= 100_000:
                    yield flush(False)
                    size = 0
        if held:
            yield flush(True)

    return run


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, chain: int = CHAIN) -> DataFrame:
    """(doc_id, kept_doc_id) of every document but one of each group of exact and near copies.

    Groups are the connected ones of the pairs within max_distance; the least doc_id of a group is kept. Rows with
    null doc_id or text, and texts without a letter or digit, are in no group. Rows that share a doc_id are one
    document. A text in which everything else is the same, but for case, punctuation or the order of words, is an
    exact copy. No table yields no rows; other columns aren't read.
    """
    # the signatures are used twice, as groups and as members of them: computed once
    sigs = checkpoint(docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null").mapInArrow(sign, "id long, sig binary, bands binary"))
    first = sigs.groupBy("sig", "bands").agg(F.min("id").alias("first"))
    same = sigs.join(first, ["sig", "bands"]).where("id <> first").select("first", "id")
    buckets = first.select(F.col("first").alias("id"), "sig", "bands").mapInArrow(spread, "key int, id long, sig binary")
    near = buckets.repartition("key").sortWithinPartitions("key", "id").mapInArrow(link(max_distance, chain), "a long, b long")
    return stars(near.union(same)).select(F.col("node").alias("doc_id"), F.col("root").alias("kept_doc_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents without those that near_duplicates lists, all columns as they are."""
    return semi(docs, "doc_id", near_duplicates(docs).select("doc_id"), "left_anti")
