"""Part-of-speech tags, chunks, lemmas and constituents: a rule tagger, external taggers by lines, parse trees."""

from __future__ import annotations

import re
import subprocess
import threading
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+(?:[-'’]\w+)*|[^\w\s]")
KINDS = "array<struct<text: string, pos: string, stem: string, chunk: string, chunk_begin: boolean, chunk_end: boolean, begin: int, end: int, ner: string>>"
_CLOSED = {**dict.fromkeys("the a an this that these those le la les un une der die das ein eine el los las una".split(), "DT"), **dict.fromkeys("of in on at by for with from to as de du des dans par pour von mit im zu en con del".split(), "IN"), **dict.fromkeys("and or but et ou und oder y o".split(), "CC"), **dict.fromkeys("is are was were be been has have had est ist sind es".split(), "VBZ"), **dict.fromkeys("he she it they we you i".split(), "PRP"), "not": "RB"}
_LEMMAS = {"is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "has": "have", "had": "have", "better": "well", "best": "well"}

Tagger = Callable[[str], list[dict]]


@lru_cache(200_000)
def pos_of(word: str) -> str:
    low = word.lower()
    if not any(c.isalnum() for c in word):
        return word[0]
    if low in _CLOSED:
        return _CLOSED[low]
    if low[0].isdigit():
        return "CD"
    for end, tag in (("ly", "RB"), ("ing", "VBG"), ("ed", "VBD"), ("ous", "JJ"), ("ful", "JJ"), ("ive", "JJ"), ("able", "JJ"), ("al", "JJ")):
        if low.endswith(end) and len(low) > len(end) + 2:
            return tag
    return "NNS" if low.endswith("s") and not low.endswith("ss") and len(low) > 3 else "NN"


def lemma(word: str, pos: str | None, lexicon: dict[str, dict[str, str]] | None = None) -> str:
    """By the lexicon: of the tag, else of the only other tag, else by rules; always small."""
    low = word.lower()
    own = (lexicon or {}).get(low)
    if own:
        if pos in own:
            return own[pos].lower()
        if len(set(own.values())) == 1:
            return next(iter(own.values())).lower()
    if low in _LEMMAS:
        return _LEMMAS[low]
    if pos == "NNS":
        return low[:-3] + "y" if low.endswith("ies") else low[:-1]
    if pos in ("VBG", "VBD"):
        stem = low[:-3] if pos == "VBG" else low[:-2]
        return stem[:-1] if len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] not in "lsz" else stem
    return low


_CHUNKS = {"DT": "NP", "JJ": "NP", "NN": "NP", "NNS": "NP", "CD": "NP", "PRP": "NP", "IN": "PP", "VBZ": "VP", "VBG": "VP", "VBD": "VP", "RB": "ADVP"}


@lru_cache(200_000)
def _word(word: str) -> tuple[str, str, str | None]:
    pos = pos_of(word)
    return pos, lemma(word, pos), _CHUNKS.get(pos)


_TOKEN = pa.struct([("text", pa.string()), ("pos", pa.string()), ("stem", pa.string()), ("chunk", pa.string()), ("chunk_begin", pa.bool_()), ("chunk_end", pa.bool_()), ("begin", pa.int32()), ("end", pa.int32()), ("ner", pa.string())])
_TILES = re.compile(f"({TOKEN.pattern})")


class RuleTagger:
    """Tokens with tags, chunks and lemmas by closed lists and endings; deterministic, no model. entity: the entity tag of a word."""

    def __init__(self, entity: Callable[[str], str | None] = lambda word: None):
        self.entity = entity

    def __call__(self, sentence: str) -> list[dict]:
        out: list[dict] = []
        last = None
        for m in TOKEN.finditer(sentence):
            pos, stem, chunk = _word(m[0])
            begin = bool(chunk) and (last is None or last["chunk"] != chunk or pos in ("DT", "IN", "PRP"))
            if last and last["chunk"]:
                last["chunk_end"] = begin or chunk != last["chunk"]
            last = {"text": m[0], "pos": pos, "stem": stem, "chunk": chunk, "chunk_begin": begin, "chunk_end": bool(chunk), "begin": m.start(), "end": m.end(), "ner": self.entity(m[0])}
            out.append(last)
        return out

    def columns(self, texts: list[str], begins: list[int]) -> tuple[np.ndarray, pa.StructArray]:
        """The numbers of tokens of texts, and all tokens, each as above, at their places in documents. Words are looked at once a call, tokens as arrays."""
        parts = _TILES.split("\n".join(texts))  # a line feed is in no token
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        b, e = ends[0:-1:2], ends[1::2]
        words = pa.array(parts[1::2], pa.string())
        coded = words.dictionary_encode()
        at, known = np.asarray(coded.indices), coded.dictionary.to_pylist()
        found = [_word(w) for w in known]
        pos, stem, chunk = (pa.array([x[k] for x in found], pa.string()) for k in range(3))
        kinds = {c: i for i, c in enumerate(sorted(set(_CHUNKS.values())))}
        kind = np.array([kinds.get(x[2], -1) for x in found], np.int8)[at] if known else np.zeros(0, np.int8)
        opens = np.array([x[0] in ("DT", "IN", "PRP") for x in found], bool)[at] if known else np.zeros(0, bool)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        starts = np.cumsum(size) - size
        row = np.searchsorted(starts, b, "right") - 1
        new = np.ones(len(b), bool)  # the first of its sentence, or of another kind than the last
        new[1:] = (row[1:] != row[:-1]) | (kind[1:] != kind[:-1])
        begin = (kind >= 0) & (new | opens)
        end = kind >= 0
        end[:-1] &= new[1:] | begin[1:]
        shift = np.asarray(begins, np.int64) - starts
        base = shift[row] if len(row) else np.zeros(0, np.int64)
        ner = pa.array([self.entity(w) for w in known], pa.string())
        take = lambda a: a.take(coded.indices)
        cols = [words, take(pos), take(stem), take(chunk), pa.array(begin), pa.array(end), pa.array((b + base).astype(np.int32)), pa.array((e + base).astype(np.int32)), take(ner)]
        return np.bincount(row, minlength=len(texts)), pa.StructArray.from_arrays(cols, fields=list(_TOKEN))


rule_tagger = RuleTagger()


def aligned(sentence: str, rows: list[list[str]]) -> list[dict]:
    """Tokens of a tagger's lines (word, stem, pos, chunk tag, entity tag), each found from where the last ended."""
    out, at = [], 0
    for word, stem, pos, chunk, *ner in rows:
        word = '"' if word in ("``", "''") and word not in sentence[at:] else word
        b = sentence.find(word, at)
        if b < 0:
            raise ValueError(f"{word!r} isn't in the rest of the sentence")
        at = b + len(word)
        tag = chunk[2:] if chunk[:2] in ("B-", "I-") else None
        if out and out[-1]["chunk"]:
            out[-1]["chunk_end"] = not chunk.startswith("I")
        out.append({"text": word, "pos": pos, "stem": stem, "chunk": tag, "chunk_begin": chunk.startswith("B"), "chunk_end": bool(tag), "begin": b, "end": at, "ner": ner[0] if ner else "O"})
    return out


class LineProcess:
    """A program that reads a sentence a line and answers with lines up to an empty one; started anew if it ended.

    One that doesn't answer within timeout seconds is killed, which is an error of that sentence alone. What it writes to
    its standard error goes to the log of the worker.
    """

    def __init__(self, command: list[str], timeout: float = 30):
        self.command, self.timeout, self.process = command, timeout, None

    def ask(self, line: str) -> list[str]:
        if self.process is None or self.process.poll() is not None:
            self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1)
        late = threading.Event()

        def kill() -> None:
            late.set()
            self.process.kill()

        timer = threading.Timer(self.timeout, kill)
        timer.start()
        try:
            self.process.stdin.write(line.replace("\n", " ") + "\n")
            self.process.stdin.flush()
            out = []
            while (got := self.process.stdout.readline()) and got.strip():
                out.append(got.rstrip("\n"))
        finally:
            timer.cancel()
            if late.is_set():
                self.process.wait()
                self.process = None
        if late.is_set():
            raise TimeoutError(f"no answer within {self.timeout} seconds")
        return out

    def close(self) -> None:
        if self.process:
            self.process.kill()


def process_tagger(command: list[str], timeout: float = 30, most_chars: int | None = None) -> Tagger:
    """A tagger whose program answers with tab-separated word, stem, pos, chunk and entity tags. most_chars: for a program that can't take longer sentences; they fail."""
    held: list[LineProcess] = []

    def tag(sentence: str) -> list[dict]:
        if most_chars and len(sentence) > most_chars:
            raise ValueError(f"a sentence of more than {most_chars} characters")
        if not held:
            held.append(LineProcess(command, timeout))
        return aligned(sentence, [x.split("\t") for x in held[0].ask(sentence)])

    return tag


#: Characters, and sentences, that are tagged at a time: memory doesn't grow with batches.
STEP_CHARS, STEP_ROWS = 1_000_000, 4096


def _each(tagger: Tagger, texts: list[str | None], begins: list[int]) -> tuple[list[int | None], pa.StructArray]:
    sizes: list[int | None] = []
    flat: dict[str, list] = {f.name: [] for f in _TOKEN}
    for b, text in zip(begins, texts):
        try:
            tokens = None if text is None else tagger(text)
        except (ValueError, OSError):
            tokens = None
        sizes.append(None if tokens is None else len(tokens))
        for name, own in flat.items():
            if name in ("begin", "end"):
                own.extend([t[name] + b for t in tokens or ()])
            else:
                own.extend([t[name] for t in tokens or ()])
    return sizes, pa.StructArray.from_arrays([pa.array(flat[f.name], f.type) for f in _TOKEN], fields=list(_TOKEN))


def tagged_batches(batches: Iterator[pa.RecordBatch], tagger: Tagger) -> Iterator[pa.RecordBatch]:
    """Of batches of (doc_id, sent_no, begin, end, text), those of (doc_id, sent_no, begin, end, tokens)."""
    for whole in batches:
        chars = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(whole.column(4)), 0)), dtype=np.int64)
        lo = 0
        while lo < whole.num_rows:
            before = int(chars[lo - 1]) if lo else 0
            hi = min(max(int(np.searchsorted(chars, before + STEP_CHARS, "right")), lo + 1), lo + STEP_ROWS, whole.num_rows)
            batch = whole.slice(lo, hi - lo)
            lo = hi
            begins, texts = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            if isinstance(tagger, RuleTagger):
                n, values = tagger.columns([t or "" for t in texts], [b or 0 for b in begins])
                sizes = [None if t is None else k for t, k in zip(texts, n.tolist())]
            else:
                sizes, values = _each(tagger, texts, begins)
            null = pa.array([n is None for n in sizes], pa.bool_())
            offsets = np.concatenate([[0], np.cumsum([n or 0 for n in sizes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(pa.array(offsets), values, mask=null)], ["doc_id", "sent_no", "begin", "end", "tokens"])


def as_sentences(sentences: DataFrame) -> DataFrame:
    """The columns that tagged_batches() takes."""
    return sentences.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("sent_no").cast("int").alias("sent_no"), F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"), "text")


def tag_sentences(sentences: DataFrame, tagger: Tagger = rule_tagger) -> DataFrame:
    """(doc_id, sent_no, begin, end, tokens): offsets of tokens are those of the document.

    Sentences of any length are tagged. Those that the tagger fails on, and those without text, stay, with null tokens:
    failed() lists them.
    """
    return as_sentences(sentences).mapInArrow(lambda batches: tagged_batches(batches, tagger), f"doc_id long, sent_no int, begin int, end int, tokens {KINDS}")


def failed(tagged: DataFrame) -> DataFrame:
    """(doc_id, sent_no, begin, end) of the sentences that couldn't be tagged."""
    return tagged.where("tokens is null").drop("tokens")


def token_rows(tagged: DataFrame) -> DataFrame:
    return tagged.select("doc_id", "sent_no", F.posexplode("tokens").alias("tok_no", "t")).select("doc_id", "sent_no", "tok_no", "t.*")


def parsed(sentence: str, parse: Callable[[str], str | None], most: int = 200) -> list[tuple[int, int, str]]:
    """constituents() of what parse says of the sentence; if that is nothing and the sentence has more than most characters, those of its parts at ";", then at ","."""
    tree = parse(sentence)
    if tree:
        return constituents(tree, sentence)
    for cut in ";,":
        if len(sentence) > most and cut in sentence:
            found, at = [], 0
            for part in sentence.split(cut):
                found += [(at + b, at + e, t) for b, e, t in parsed(part, parse, most)]
                at += len(part) + 1
            return found
    return []


def constituents(tree: str, sentence: str) -> list[tuple[int, int, str]]:
    """(begin, end, tag) of the phrases of a bracketed parse; the innermost of equal spans, none of the whole sentence."""
    found: dict[tuple[int, int], str] = {}
    stack: list[list] = []
    at, first, last = 0, None, 0
    for part in re.findall(r"\(|\)|[^\s()]+", tree):
        if part == "(":
            stack.append([None, None])
        elif part == ")":
            tag, b = stack.pop()
            if b is not None and (b, last) not in found:
                found[b, last] = tag
        elif stack and stack[-1][0] is None:
            stack[-1][0] = part
        else:
            b = sentence.find(part, at)
            if b < 0:
                continue
            at = last = b + len(part)
            first = b if first is None else first
            for frame in stack:
                frame[1] = b if frame[1] is None else frame[1]
    return sorted((b, e, t) for (b, e), t in found.items() if (b, e) != (first, last))


def relation_patterns(sentence: str, entities: list[tuple[int, int, str]], phrases: list[tuple[int, int, str]] = (), most: int = 0) -> list[str]:
    """Texts between entities with these as [[name]], for every choice of one mention a name, plain and with the noun phrases around entities shortened to them."""
    names: dict[str, list[tuple[int, int]]] = {}
    for b, e, name in entities:
        names.setdefault(name, []).append((b, e))
    choices: list[list[tuple[int, int, str]]] = [[]]
    for name, places in names.items():
        choices = [[*c, (b, e, name)] for c in choices for b, e in places]
    out = []
    for own in choices:
        own.sort()
        if len(own) < 2 or any(x[1] > y[0] for x, y in zip(own, own[1:])):
            continue
        around = [next(((b, e) for b, e, t in sorted(phrases, key=lambda p: p[1] - p[0]) if t == "NP" and b <= x[0] and x[1] <= e and (b, e) != x[:2] and not any(y is not x and b < y[1] and y[0] < e for y in own)), x[:2]) for x in own]
        for spans in ([x[:2] for x in own], around):
            text, at = [], spans[0][0]
            for (b, e), x in zip(spans, own):
                text += [sentence[at:b], f"[[{x[2]}]]"]
                at = e
            line = re.sub(r"\s+", " ", "".join(text)).strip()
            line = re.sub(r"(?: ?[.,])+$", "", re.sub(r",(?: ?,)+", ",", line))
            if not most or len(line) <= most:
                out.append(line)
    return sorted(set(out))
