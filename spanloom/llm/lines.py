"""Fuzzy line dedup: MinHash of normalised lines, bands of least hashes, edit similarity, one occurrence of each group.

A line's words (lower case, letters and digits only; single letters in scripts without spaces, as Chinese or Thai) are its
normal form. Lines of the same form are one; of those, the first stands for all. Counted words (the second place of a word is an element of its own) of two lines with an edit
similarity of 0.9 have a Jaccard similarity of 9/11 at least. A signature has 8 bands, each of 5 least hashes, so such a
pair shares one with a probability of 1 - (1 - (9/11) ** 5) ** 8 = 0.97, whatever the length. Lines meet in the buckets of
the bands that they share, where all pairs are held against bounds that lose none. Those within fetch their words and
stay if the edit similarity over words is high enough; in a hot bucket, lines fetch their words once for all pairs.
Of a connected group, the first occurrence in the order of doc_id and line stays.

SimHash isn't used here: one word of ten changes a seventh of its bits, so that no number of pigeonhole blocks that a line
can be sent to finds nine in ten of such pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, M1, binary, checkpoint, fixed, fresh, mix, plain, run_starts, slices, stars, sums, words, written
from .simhash import hashed

MIN_SIMILARITY = 0.9
BANDS, ROWS, BAND_BYTES = 8, 5, 5
FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(GOLDEN)).reshape(BANDS, ROWS) | np.uint64(1)
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
HOT = 64  #: members of a bucket, above which its pairs are found with the words at hand
LINE = "doc long, txt long, line int"


def normal_lines(least: float, min_words: int):
    """(h1, h2, doc, txt, line, n, again, sig) for each line of enough words of (doc, txt, text); no sig if only the same form can match.

    A line whose form a line before it has, in the order of (doc, txt, line) and among the texts that are read at once, is
    there again whatever comes: it needs no sig, and gets a hash of its own for h1, so that a form that is everywhere
    doesn't go to one task with all its occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                rows = pc.split_pattern(batch.column(2).slice(lo, hi - lo), "\n")
                ends = np.asarray(rows.offsets).astype(np.int64)
                lines = rows.flatten()
                line, word, forms = tokens(lines)
                n = np.bincount(line, minlength=len(lines))
                begin = np.concatenate([[0], np.cumsum(n)])
                place = (np.arange(len(word)) - begin[line]).astype(np.uint64) * np.uint64(GOLDEN)
                every = hashed(forms)
                base = every[word]
                keep = np.flatnonzero(n >= max(1, min_words))
                if not len(keep):
                    continue
                h1, h2 = (sums(mix(base + place + np.uint64(seed)), begin).view(np.int64)[keep] for seed in (1, 2**40 + 1))
                row = (np.searchsorted(ends - ends[0], keep, side="right") - 1).astype(np.int64)
                nth = (keep - (ends - ends[0])[row]).astype(np.int32)
                doc, txt = (np.asarray(pc.fill_null(batch.column(i).slice(lo, hi - lo), -(2**63)))[row] for i in (0, 1))
                order = np.lexsort((nth, txt, doc, h2, h1))
                own = np.zeros((len(keep), 2), bool)  # the first with its place, the first with its form
                own[order[run_starts(*(x[order] for x in (h1, h2, doc, txt, nth)))], 0] = True
                own[order[run_starts(h1[order], h2[order])], 1] = True
                own, first = own[own[:, 0], 1], own[:, 0]  # of identical rows, one
                keep, row, nth, h1, h2, doc, txt = (x[first] for x in (keep, row, nth, h1, h2, doc, txt))
                h1 = np.where(own, h1, mix(doc.view(np.uint64) + mix(txt.view(np.uint64) + nth.astype(np.uint64))).view(np.int64))
                fuzzy = np.zeros(len(lines), bool)
                fuzzy[keep[own]] = edits(n[keep[own]] + 1, least) >= 1
                new = np.cumsum(fuzzy) - 1
                sigs = signed(new[line[fuzzy[line]]], word[fuzzy[line]], int(fuzzy.sum()), every)
                at = pa.array(row + lo)
                columns = [pa.array(h1), pa.array(h2), batch.column(0).take(at), batch.column(1).take(at), pa.array(nth), pa.array(n[keep].astype(np.int32)), pa.array(~own), binary(sigs).take(pa.array(new[keep], mask=~fuzzy[keep]))]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc", "txt", "line", "n", "again", "sig"])

    return run


def tokens(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(line of each word, the word's place among the forms, the forms)."""
    codes, offsets, distinct = words(spaced(lines))
    of, forms = plain(distinct)
    word = of[codes]
    return np.repeat(np.arange(len(lines)), np.diff(offsets))[word >= 0], word[word >= 0], forms


def spaced(lines: pa.Array) -> pa.Array:
    """The lines with each letter of a script that doesn't put spaces between words as a word of its own."""
    if isinstance(lines, pa.ChunkedArray):
        lines = lines.combine_chunks()
    if not len(lines):
        return lines
    wide = pc.fill_null(pc.not_equal(pc.binary_length(lines), pc.utf8_length(lines)), False)
    if not pc.any(wide).as_py():
        return lines
    return pc.replace_with_mask(lines, wide, pc.replace_substring_regex(lines.filter(wide), UNSPACED, r" \0 "))


def edits(n: np.ndarray, least: float) -> np.ndarray:
    """The edits that a pair may have whose longer line has n words."""
    return ((1 - least) * n + 1e-9).astype(np.int64)


def counted(line: np.ndarray, word: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of a line's words as a set: the second, third... place of a word is an element of its own. Sorted by line."""
    key = np.sort((line << 32) | word)
    starts = run_starts(key)
    again = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    return key >> 32, mix(every[key & 0xFFFFFFFF] + again.astype(np.uint64) * M1)


def parities(element: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64 bits of each set: of the elements with that place, is the number odd? Sets that differ in x elements differ in at most x bits."""
    return np.bitwise_xor.reduceat(np.uint64(1) << (element >> np.uint64(58)), begin[:-1]) if len(element) else np.zeros(len(begin) - 1, np.uint64)


def possible(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of lines of n and m words, with parities a and b, may have the similarity: loses none that has it.

    A replaced word changes two elements, a word more or less changes one.
    """
    most, gap = edits(np.maximum(n, m), least), np.abs(n - m)
    return (gap <= most) & (np.bitwise_count(a ^ b).astype(np.int64) <= 2 * most - gap)


def signed(line: np.ndarray, word: np.ndarray, n: int, every: np.ndarray) -> np.ndarray:
    """Rows of bytes, for n lines that all have words: BAND_BYTES of each band, eight of parities."""
    of, element = counted(line, word, every)
    begin = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
    keys = bands(element, begin).view(np.uint8).reshape(n, BANDS, 8)[:, :, :BAND_BYTES]
    return np.concatenate([keys.reshape(n, BANDS * BAND_BYTES), parities(element, begin).view(np.uint8).reshape(n, 8)], axis=1)


def bands(element: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rows of BANDS hashes, each of ROWS least hashes of a set. No set may be empty."""
    out = np.zeros((len(begin) - 1, BANDS), np.uint64)
    if len(element):
        for j in range(BANDS):
            key = np.full(len(out), j + 1, np.uint64)
            for k in range(ROWS):
                key = mix(key ^ np.minimum.reduceat(element * FACTORS[j, k], begin[:-1]))
            out[:, j] = key
    return out


def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash, doc, txt and line get the number of the first with their hash; only that keeps its signature. Of identical rows one stays."""
    from pyspark import TaskContext

    number = (TaskContext.get().partitionId() << 36) - 1
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h = [np.asarray(c) for c in (batch.column(0), batch.column(1), pc.fill_null(batch.column(2), -(2**63)), batch.column(3), batch.column(4))]
        first, new = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
        first[run_starts(*h[:2])] = True
        new[run_starts(*h)] = True
        if last:
            first[0], new[0] = last[:2] != (h[0][0], h[1][0]), last != tuple(x[0] for x in h)
        last = tuple(x[-1] for x in h)
        ids = number + np.cumsum(first)
        number = int(ids[-1])
        first &= ~np.asarray(batch.column(6))
        sig = pc.if_else(pa.array(first), batch.column(7), pa.scalar(None, pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array(ids), *batch.columns[2:6], pa.array(first), sig], ["id", "doc", "txt", "line", "n", "first", "sig"]).filter(pa.array(new))


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of (id, n, sig): bucket, id, number of words, parities."""
    for batch in batches:
        sigs = fixed(batch.column(2), BANDS * BAND_BYTES + 8)
        keys = np.zeros((len(sigs), BANDS, 8), np.uint8)
        keys[:, :, :BAND_BYTES] = sigs[:, : BANDS * BAND_BYTES].reshape(-1, BANDS, BAND_BYTES)
        keys[:, :, BAND_BYTES] = np.arange(BANDS)
        odd = np.ascontiguousarray(sigs[:, BANDS * BAND_BYTES :]).view(np.int64).ravel()
        at = np.repeat(np.arange(len(sigs)), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), *(pa.array(np.asarray(x)[at]) for x in (batch.column(0), batch.column(1), odd))], ["key", "id", "n", "odd"])


def partners(least: float):
    """Rows sorted by bucket: (-1, a, b) of the pairs that may be similar, or (bucket, id, -1) of the members of hot buckets.

    A bucket is hot if it has many members or many such pairs; there, settle() looks at the words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        hot = -1

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal hot
            bucket, ids, n, odd = own = tuple(np.concatenate(c) for c in zip(*held))
            held.clear()
            n, odd = n.astype(np.int64), odd.view(np.uint64)
            starts = run_starts(bucket)
            sizes = np.diff(np.append(starts, len(bucket)))
            large = sizes > HOT
            large[0] |= bucket[0] == hot
            hot = int(bucket[-1]) if large[-1] else -1
            if not last and not large[-1]:  # the bucket may go on
                held.append(tuple(c[starts[-1] :] for c in own))
                sizes[-1] = 0
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(bucket))))
            end = (starts + sizes)[of]
            row = np.flatnonzero(~large[of])
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            step = 1
            while len(row := row[row + step < end[row]]):
                hit = row[possible(n[row], n[row + step], odd[row], odd[row + step], least)]
                left.append(hit)
                right.append(hit + step)
                step += 1
            a, b = np.concatenate(left), np.concatenate(right)
            many = np.bincount(of[a], minlength=len(starts)) > 2 * sizes
            inner = np.zeros(len(bucket), bool)
            inner[a[many[of[a]]]] = inner[b[many[of[b]]]] = True
            inner |= large[of]
            a, b = a[~many[of[a]]], b[~many[of[b]]]
            none = np.full(int(inner.sum()), -1)
            columns = (np.full(len(a), -1), bucket[inner]), (ids[a], ids[inner]), (ids[b], none)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["key", "a", "b"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(tuple(np.asarray(c) for c in batch.columns))
                size += batch.num_rows
                if size >= 100_000:
                    yield flush(False)
                    size = 0
        if held:
            yield flush(True)

    return run


def settle(least: float):
    """Similar pairs (a, b) that connect what is connected in each bucket, from its lines (key, id, words) sorted by key.

    Every pair is looked at but those that are connected already.
    """

    def one(ids: list[int], texts: pa.Array) -> Iterator[tuple[int, int]]:
        line, word, forms = tokens(texts)
        n = np.bincount(line, minlength=len(ids))
        begin = np.concatenate([[0], np.cumsum(n)])
        own = [word[lo:hi].tolist() for lo, hi in zip(begin[:-1], begin[1:])]
        _, element = counted(line, word, hashed(forms))
        odd = parities(element, begin)
        group = np.arange(len(ids))
        for i in range(len(ids) - 1):
            other = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
            for j in other[possible(n[i], n[other], odd[i], odd[other], least)].tolist():
                if group[j] != group[i] and similarity(own[i], own[j], least) >= least:
                    group[group == group[j]] = group[i]
                    yield ids[i], ids[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            key = np.asarray(rows["key"])
            starts = run_starts(key).tolist()
            pairs: list[tuple[int, int]] = []
            for lo, hi in zip(starts, [*starts[1:], len(key)]):
                if hi == len(key) and not last:
                    held.extend(rows.slice(lo).to_batches())
                else:
                    part = rows.slice(lo, hi - lo).combine_chunks()
                    pairs += one(part["id"].to_pylist(), pa.concat_arrays(part["words"].chunks))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                goes_on = held and batch.column(0)[-1].as_py() == held[0].column(0)[0].as_py()
                held.append(batch)
                if not goes_on:
                    yield flush(False)
        if held:
            yield flush(True)

    return run


def similarity(a: list[str], b: list[str], least: float = 0.0) -> float:
    """1 - edit distance over words / length of the longer; 0 as soon as it can't be least. Bit-parallel, a bit a word."""
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    budget = int((1 - least) * longest + 1e-9)
    if abs(len(a) - len(b)) > budget:
        return 0.0
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return 1 - max(len(a), len(b)) / longest
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full, top, distance = (1 << len(b)) - 1, 1 << len(b) - 1, len(b)
    up, down = full, 0
    for left, w in enumerate(a, 1 - len(a)):
        same = places.get(w, 0)
        cross = (((same & up) + up) ^ up) | same | down
        plus = down | (full & ~(cross | up))
        minus = up & cross
        distance += bool(plus & top) - bool(minus & top)
        if distance + left > budget:  # the rest can take off at most one each
            return 0.0
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | (full & ~((same | down) | plus)), plus & (same | down)
    return 1 - distance / longest


def verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for column in (batch.column(2), batch.column(3)):
                line, word, forms = tokens(column)
                cuts = np.searchsorted(line, np.arange(len(column) + 1))
                names = np.array([*forms, ""], object)
                own.append([names[word[x:y]].tolist() for x, y in zip(cuts[:-1], cuts[1:])])
            ok = pa.array([similarity(a, b, least) >= least for a, b in zip(*own)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(ok)

    return run


def repeated_lines(docs: DataFrame, min_similarity: float = MIN_SIMILARITY, min_words: int = 1) -> DataFrame:
    """(doc, txt, line) of every occurrence to be removed: doc_id, hash of the text, number of the line from 0."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("txt"), "text").where("text is not null")
    lines = own.mapInArrow(normal_lines(min_similarity, min_words), f"h1 long, h2 long, {LINE}, n int, again boolean, sig binary")
    lines = written(lines.repartition("h1").sortWithinPartitions("h1", "h2", "doc", "txt", "line").mapInArrow(firsts, f"id long, {LINE}, n int, first boolean, sig binary"))
    first = lines.where("first")
    buckets = first.where("sig is not null").select("id", "n", "sig").mapInArrow(spread, "key long, id long, n int, odd long")
    met = checkpoint(buckets.repartition("key").sortWithinPartitions("key", "id").mapInArrow(partners(min_similarity), "key long, a long, b long").distinct())
    pairs, hot = met.where("key < 0").select("a", "b"), met.where("key >= 0").select("key", "a")
    ends = checkpoint(first.select("id", "doc", "txt", "line").join(met.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "id", "left_semi"))
    wanted = ends.groupBy("doc", "txt").agg(F.collect_list(F.struct("line", "id")).alias("lines"))
    texts = own.join(wanted.toDF("d", "t", "lines"), own.doc.eqNullSafe(F.col("d")) & (F.col("txt") == F.col("t"))).select(F.split("text", "\n").alias("all"), F.explode("lines").alias("x")).select(F.col("x.id").alias("id"), F.get("all", F.col("x.line")).alias("words")).groupBy("id").agg(F.first("words").alias("words"))
    near = pairs.join(texts.toDF("a", "wa"), "a").join(texts.toDF("b", "wb"), "b").select("a", "b", "wa", "wb").mapInArrow(verify(min_similarity), "a long, b long")
    inner = hot.join(texts.toDF("a", "words"), "a").select("key", F.col("a").alias("id"), "words")
    near = near.union(inner.repartition("key").sortWithinPartitions("key", "id").mapInArrow(settle(min_similarity), "a long, b long"))
    groups = stars(near)
    members = checkpoint(groups.union(groups.select("root", "root").distinct()).toDF("id", "root").join(ends, "id"))
    kept = members.groupBy("root").agg(F.min(F.struct("doc", "txt", "line")).alias("kept"))
    lost = members.join(kept, "root").where(F.struct("doc", "txt", "line") != F.col("kept"))
    return lines.where("not first").select("doc", "txt", "line").union(lost.select("doc", "txt", "line"))


def dedup_lines(docs: DataFrame, min_similarity: float = MIN_SIMILARITY, min_words: int = 1) -> DataFrame:
    """The documents, all columns, text without repeated lines; n_chars, if there, is the length of the new text.

    Lines without any letter or digit stay, and so do those of fewer than min_words words if asked for. Lines too short for an edit
    (fewer than 9 words at 0.9) are repeats if their normal form is the same. A document that loses all its lines goes: another has them. Null and
    empty texts stay as they are. Identical rows, with the same doc_id and text, are one document and stay alike; rows
    with the same doc_id and other texts are documents of their own, and so are rows with a null doc_id, which come
    before all others. A line that comes again within a document is removed there too.
    """
    gone = repeated_lines(docs, min_similarity, min_words).groupBy("doc", "txt").agg(F.collect_set("line").alias("lines"))
    d, t, lines = (fresh(docs, n) for n in ("__doc", "__txt", "__lines"))
    both = docs.join(gone.toDF(d, t, lines), docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(t)), "left")
    left = F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(F.col(lines), i))
    both = both.where(F.col(lines).isNull() | (F.size(left) > 0))
    text = F.when(F.col(lines).isNull(), docs["text"]).otherwise(F.array_join(left, "\n"))
    new = {"text": text} | ({"n_chars": F.when(F.col(lines).isNull(), docs["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return both.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns))
