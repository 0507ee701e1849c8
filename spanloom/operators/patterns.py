"""Patterns over tagged tokens.

    pattern = { item }
    item    = ( terminal | "." | "(" pattern ")" | "[" TAG pattern "]" ) [ "*" | "+" | "?" ]
    terminal = [ [ word "_" ] pos "_" ] lemma         each a regular expression that must match all, or "*"

A phrase in brackets begins where a chunk does and ends where one does; "." in it must have its tag. An item of the
pattern that can be empty lets a whole phrase be absent. Parts are split at spaces, "\\ " and "\\_" stand for themselves.

A pattern is compiled to a program for a machine with threads by priority; a state (instruction, token, begin of the
phrase) that failed once isn't gone on from again, so that a sentence takes time in proportion to its states, whatever is nested.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tagging


def lex(pattern: str) -> list[str]:
    """Parts between single spaces that no odd number of backslashes escapes; empty ones are left out."""
    return [p for p in re.findall(r"(?:\\.|[^ \\])+", pattern) if p]


@dataclass
class Item:
    kind: str  #: token, any, group or phrase
    quantity: str = ""
    tests: tuple = ()
    tag: str = ""
    items: list[Item] = field(default_factory=list)
    group: int = -1


def terminal(part: str) -> Item:
    own = re.split(r"(?<!\\)(?:\\\\)*_", part)
    if len(own) > 3 or not own[-1]:
        raise ValueError(f"{part!r} isn't [[word_]pos_]lemma")
    names = ("text", "pos", "stem")[-len(own) :]
    return Item("token", tests=tuple((n, re.compile(x.replace(r"\_", "_").replace(r"\ ", " "))) for n, x in zip(names, own) if x not in ("*", "")))


@lru_cache(1000)
def compile_pattern(pattern: str) -> tuple[list[Item], int]:
    """(items, number of groups)."""
    parts, groups = lex(pattern), 0

    def parse(at: int, closer: str, phrase: bool) -> tuple[list[Item], int]:
        nonlocal groups
        items: list[Item] = []
        while at < len(parts) and parts[at] != closer:
            p = parts[at]
            at += 1
            if p in ("*", "+", "?") and items and not items[-1].quantity:
                items[-1].quantity = p
                continue
            if p == "(":
                item, groups = Item("group", group=groups), groups + 1
                item.items, at = parse(at, ")", phrase)
            elif p == "[":
                if phrase:
                    raise ValueError("phrases can't be in phrases")
                item = Item("phrase", tag=parts[at] if at < len(parts) else "")
                item.items, at = parse(at + 1, "]", True)
            elif p in (")", "]"):
                raise ValueError(f"{p!r} closes nothing")
            else:
                item = Item("any") if p == "." else terminal(p)
            items.append(item)
        if closer:
            if at >= len(parts):
                raise ValueError(f"{closer!r} is missing")
            at += 1
        return items, at

    return parse(0, "", False)[0], groups


@lru_cache(1000)
def program(pattern: str) -> tuple[list[tuple], list[tuple], int]:
    """(instructions, tests of the named tokens, number of groups).

    (test, k), (any, tag), (split, whether more comes first at any rate, more, rest), (start, slot), (end, slot), (phrase,),
    (closed,), (done,): each goes on at the next, split at one of two.
    """
    items, groups = compile_pattern(pattern)
    code: list[tuple] = []
    tests: list[tuple] = []

    def single(item: Item, tag: str) -> None:
        if item.kind == "group":
            code.append(("start", 2 * item.group))
            every(item.items, tag)
            code.append(("end", 2 * item.group + 1))
        elif item.kind == "phrase":
            code.append(("phrase",))
            every(item.items, item.tag)
            code.append(("closed",))
        elif item.kind == "any" or not item.tests:
            code.append(("any", tag))
        else:
            code.append(("test", len(tests)))
            tests.append(item.tests)

    def every(own: list[Item], tag: str) -> None:
        for item in own:
            first = item.kind == "token"  # what is named is taken wherever it is
            at = len(code)
            if item.quantity in ("*", "?"):
                code.append(())
            single(item, tag)
            if item.quantity == "?":
                code[at] = ("split", first, at + 1, len(code))
            elif item.quantity == "*":
                code.append(("jump", at))
                code[at] = ("split", first, at + 1, len(code))
            elif item.quantity == "+":
                code.append(("split", first, at, len(code) + 1))

    every(items, "")
    return [*code, ("done",)], tests, groups


@lru_cache(1000)
def openings(pattern: str) -> list[tuple[int, bool]] | None:
    """(instruction, whether a phrase begins there) that can take the first token of a match; None if a match can be empty."""
    code, found, seen, stack = program(pattern)[0], [], set(), [(0, False)]
    while stack:
        at, phrase = stack.pop()
        if (at, phrase) in seen:
            continue
        seen.add((at, phrase))
        kind = code[at][0]
        if kind == "done":
            return None
        if kind in ("test", "any"):
            found.append((at, phrase))
        elif kind == "split":
            stack += [(code[at][2], phrase), (code[at][3], phrase)]
        elif kind == "jump":
            stack.append((code[at][1], phrase))
        else:
            stack.append((at + 1, phrase if kind in ("start", "end") else kind == "phrase"))
    return found


class Tokens:
    """Tokens of a sentence by column. combos: a number for each (text, pos, stem); known: for tests, what they said of a number. starts: by pattern, the places where alone a match can begin."""

    def __init__(self, chunk: list, begins: list, ends: list, combos: list[int], names: list[tuple], known: dict[tuple[str, int], dict[int, bool]], starts: dict[str, list[int]] | None = None):
        self.chunk, self.begins, self.ends, self.combos, self.names, self.known, self.starts = chunk, begins, ends, combos, names, known, starts

    def __len__(self) -> int:
        return len(self.combos)


def tokens_of(rows: list[dict]) -> Tokens:
    places: dict[tuple, int] = {}
    combos = [places.setdefault((t.get("text"), t.get("pos"), t.get("stem")), len(places)) for t in rows]
    return Tokens(*([t.get(c) for t in rows] for c in ("chunk", "chunk_begin", "chunk_end")), combos, list(places), {})


_FIELDS = {"text": 0, "pos": 1, "stem": 2}


def passes(name: tuple, tests: tuple) -> bool:
    return all(name[_FIELDS[f]] is not None and rx.fullmatch(name[_FIELDS[f]]) for f, rx in tests)


def _run(pattern: str, tokens: Tokens, start: int, greedy: bool, failed: set[int]) -> tuple[int, tuple] | None:
    """failed: states at splits, where alone a way can meet another or itself."""
    code, tests, groups = program(pattern)
    n, begins, ends, chunk, combos = len(tokens.combos), tokens.begins, tokens.ends, tokens.chunk, tokens.combos
    stack = [(0, start, -1, (None,) * (2 * groups))]
    while stack:
        pc, i, phrase, slots = stack.pop()
        while True:
            op = code[pc]
            kind = op[0]
            if kind == "any":
                if i >= n or (i == phrase and not begins[i]) or (op[1] and chunk[i] != op[1]):
                    break
                i += 1
            elif kind == "split":
                state = (pc * (n + 2) + i) * (n + 2) + phrase
                if state in failed:
                    break
                failed.add(state)
                _, first, more, rest = op
                if not (first or greedy):
                    more, rest = rest, more
                stack.append((rest, i, phrase, slots))
                pc = more
                continue
            elif kind == "test":
                if i >= n or (i == phrase and not begins[i]):
                    break
                known, combo = tokens.known.setdefault((pattern, op[1]), {}), combos[i]
                if combo not in known:
                    known[combo] = passes(tokens.names[combo], tests[op[1]])
                if not known[combo]:
                    break
                i += 1
            elif kind == "jump":
                pc = op[1]
                continue
            elif kind == "closed":
                if i > phrase and not ends[i - 1]:
                    break
                phrase = -1
            elif kind == "phrase":
                phrase = i
            elif kind == "done":
                return i, slots
            else:
                slots = (*slots[: op[1]], i, *slots[op[1] + 1 :])
            pc += 1
    return None


def _spans(slots: tuple) -> dict[int, tuple[int, int]]:
    return {k // 2: (slots[k], slots[k + 1]) for k in range(0, len(slots), 2) if slots[k + 1] is not None}


def match_at(pattern: str, tokens: list[dict] | Tokens, i: int, greedy: bool = False) -> tuple[int, dict[int, tuple[int, int]]] | None:
    """(end, spans of the groups) of the best match that begins at token i."""
    m = _run(pattern, tokens if isinstance(tokens, Tokens) else tokens_of(tokens), i, greedy, set())
    return m and (m[0], _spans(m[1]))


def find(pattern: str, tokens: list[dict] | Tokens, start: int = 0, greedy: bool = False) -> tuple[int, int, dict[int, tuple[int, int]]] | None:
    own = tokens if isinstance(tokens, Tokens) else tokens_of(tokens)
    failed: set[int] = set()  # of all beginnings: what failed from one fails from the next
    if own.starts is None or (places := own.starts.get(pattern)) is None:
        candidates = range(start, len(own) + 1)
    else:
        candidates = places[bisect_left(places, start) :]
    for i in candidates:
        if m := _run(pattern, own, i, greedy, failed):
            return i, m[0], _spans(m[1])
    return None


def find_all(pattern: str, tokens: list[dict] | Tokens) -> list[tuple[int, int, dict[int, tuple[int, int]]]]:
    """Matches, each by a greedy and, if different, a reluctant reading; the next begins after the first's leading chunk, or at its reluctant end."""
    own = tokens if isinstance(tokens, Tokens) else tokens_of(tokens)
    out, at = [], 0
    while at <= len(own) and (long := find(pattern, own, at, True)):
        i = long[0]
        short = (i, *match_at(pattern, own, i, False))
        out += [m for m in ([long] if long == short or long[2] == short[2] else [long, short]) if m[1] > m[0]]
        if i < len(own) and own.chunk[i]:
            at = i + 1
            while at < len(own) and not own.ends[at - 1]:
                at += 1
        else:
            at = max(short[1], i + 1)
    return out


class Batch:
    """Tokens of many sentences by column: what differs in text, tag and stem is looked at once."""

    def __init__(self, flat: pa.StructArray):
        coded = [flat.field(c).dictionary_encode() for c in ("text", "pos", "stem")]
        ids = [np.asarray(pc.fill_null(c.indices, -1)).astype(np.int64) + 1 for c in coded]
        values = [[None, *c.dictionary.to_pylist()] for c in coded]
        unique, combos = np.unique((ids[0] * len(values[1]) + ids[1]) * len(values[2]) + ids[2], return_inverse=True)
        two = np.divmod(unique, len(values[2]))
        one = np.divmod(two[0], len(values[1]))
        self.names = [(values[0][a], values[1][b], values[2][c]) for a, b, c in zip(one[0].tolist(), one[1].tolist(), two[1].tolist())]
        self.index, self.known = combos.reshape(-1), {}
        self.chunks = flat.field("chunk")
        coded = self.chunks.dictionary_encode()
        kinds = [*coded.dictionary.to_pylist(), None]  # null is the last
        self.begin_mask, end_mask = (np.asarray(pc.fill_null(flat.field(c), False), bool) for c in ("chunk_begin", "chunk_end"))
        self.combos, self.chunk = self.index.tolist(), [kinds[k] for k in np.asarray(pc.fill_null(coded.indices, -1)).tolist()]
        self.begins, self.ends = self.begin_mask.tolist(), end_mask.tolist()

    def starts(self, pattern: str) -> np.ndarray | None:
        """The places where a match can begin, of all tokens; None: anywhere."""
        code, tests, _ = program(pattern)
        ways = openings(pattern)
        if ways is None:
            return None
        mask = np.zeros(len(self.index), bool)
        for at, phrase in ways:
            if code[at][0] == "test":
                known = self.known.setdefault((pattern, code[at][1]), {})
                for i, name in enumerate(self.names):
                    known[i] = passes(name, tests[code[at][1]])
                own = np.fromiter((known[i] for i in range(len(self.names))), bool, len(self.names))[self.index]
            else:
                own = np.asarray(pc.fill_null(pc.equal(self.chunks, code[at][1]), False), bool) if code[at][1] else np.ones(len(mask), bool)
            mask |= own & self.begin_mask if phrase else own
        return np.flatnonzero(mask)

    def tokens(self, lo: int, hi: int, starts: dict[str, list[int]]) -> Tokens:
        return Tokens(self.chunk[lo:hi], self.begins[lo:hi], self.ends[lo:hi], self.combos[lo:hi], self.names, self.known, starts)


def annotate(sentences: DataFrame, resource: list[tuple[str, list[tuple[str, str]]]], tagger: tagging.Tagger | None = None) -> DataFrame:
    """(doc_id, sent_no, pattern, match_no, begin, end, namespace, identifier, part) of the patterns in sentences (doc_id, sent_no, tokens).

    resource: patterns with (namespace, identifier) pairs: one for the whole match, or the first for the relation and one for
    each group; with no pair for the relation (an empty first one) the groups alone. part is -1 for the whole.
    Tokens are structs of text, pos, stem, chunk, chunk_begin, chunk_end, begin and end. With a tagger, sentences have text
    (doc_id, sent_no, begin, end, text) instead and are tagged on the way, so that tokens never leave Python.
    """
    for pattern, _ in resource:
        program(pattern)

    def matched(ids: list[pa.Array], lists: pa.ListArray) -> pa.RecordBatch | None:
        flat, n = lists.flatten(), np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        own = Batch(flat)
        cuts, rows = np.concatenate([[0], np.cumsum(n)]), []
        b, e = (np.asarray(pc.fill_null(flat.field(c), 0)) for c in ("begin", "end"))
        for k, (pattern, pairs) in enumerate(resource):
            at = own.starts(pattern)
            bounds = None if at is None else np.searchsorted(at, cuts).tolist()
            where = cuts.tolist()
            for row in range(len(n)) if at is None else np.unique(np.searchsorted(cuts, at, "right") - 1).tolist():
                lo, hi = where[row], where[row + 1]
                starts = {} if at is None else {pattern: (at[bounds[row] : bounds[row + 1]] - lo).tolist()}
                for m, (i, j, groups) in enumerate(find_all(pattern, own.tokens(lo, hi, starts))):
                    spans = {-1: (i, j), **groups}
                    for part, (ns, name) in enumerate(pairs, -1):
                        x, y = spans.get(part, (0, 0))
                        if y > x and (ns or name):
                            rows.append((row, k, m, int(b[lo + x]), int(e[lo + y - 1]), ns, name, part))
        if not rows:
            return None
        at, *more = zip(*rows)
        kinds = [pa.int32()] * 4 + [pa.string()] * 2 + [pa.int32()]
        return pa.RecordBatch.from_arrays([*(x.take(pa.array(at)) for x in ids), *map(pa.array, more, kinds)], ["doc_id", "sent_no", "pattern", "match_no", "begin", "end", "namespace", "identifier", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in tagging.tagged_batches(batches, tagger) if tagger else batches:
            for lo in range(0, whole.num_rows, tagging.STEP_ROWS):
                batch = whole.slice(lo, tagging.STEP_ROWS)
                if (out := matched(batch.columns[:2], batch.column(batch.num_columns - 1))) is not None:
                    yield out

    own = tagging.as_sentences(sentences) if tagger else sentences.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("sent_no").cast("int").alias("sent_no"), "tokens")
    return own.mapInArrow(run, "doc_id long, sent_no int, pattern int, match_no int, begin int, end int, namespace string, identifier string, part int")


def hits(annotated: DataFrame) -> DataFrame:
    """(pattern, n): how many matches each pattern of annotate() has."""
    return annotated.select("doc_id", "sent_no", "pattern", "match_no").distinct().groupBy("pattern").agg(F.count("*").alias("n"))
