"""HTML extraction with a recurrent block labeller.

A page is cut into the text blocks of its leaves. A bidirectional LSTM reads the blocks in order, each as the mean of
vectors of its hashed words and of its hashed tag path and a few numbers, and labels every block as content or not with
the whole page as context. It learns from pages that say where their content is (article, main) and what isn't
(nav, header, footer, aside, advertising classes); in half of them these tags are hidden, so that it must do without.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, slices, sums, words

#: About how many pages the fit reads, chosen by a hash of page_id, and about how many characters they have together.
TRAIN_PAGES, TRAIN_CHARS = 500, 20_000_000
#: Names of a block's tag path that its vector is the mean of: the innermost ones, so that deep nesting stays linear.
PATH = 32
EPOCHS, SEED = 10, 7
WORD_ROWS, TAG_ROWS, D, H = 4096, 512, 24, 16

#: Every alternative that begins to match ends with a match, at the end of the page at the latest: the scan is linear. Quotes
#: count after "=" only; one that isn't closed takes the rest, as in browsers.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}} | {f"h{i}": {"p"} for i in range(1, 7)} | dict.fromkeys(("article", "aside", "blockquote", "div", "dl", "footer", "form", "header", "main", "nav", "ol", "pre", "section", "table", "ul"), {"p"})
CONTENT, REST = {"article", "main"}, {"nav", "header", "footer", "aside", "ad", "ads", "advert", "advertisement", "sidebar", "menu", "banner", "cookie"}
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int  #: characters in links


def blocks(html: str) -> tuple[str, list[Block]]:
    """(title, blocks). Unclosed and unopened tags, comments, scripts and a cut end are taken as browsers take them, roughly."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked, links, title = 0, 0, ""

    def flush() -> None:
        nonlocal linked, title
        own = SPACE.sub(" ", unescape("".join(text))).strip()
        text.clear()
        if own:
            if opened["title"]:
                title = title or own
            elif not opened["head"]:
                found.append(Block(own, tuple(n for _, names in stack[-PATH:] for n in names)[-PATH:], linked))
        linked = 0

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            text.append(html[at : m.start()])
            linked += (m.start() - at) if links else 0
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "a":
            links = 0 if m[2] else 1
        if tag in INLINE:
            continue
        flush()
        if m[2]:
            if opened[tag]:
                while pop() != tag:
                    pass
        elif tag not in VOID and not m[4].rstrip().endswith("/"):
            if tag == "body":
                stack = [s for s in stack if s[0] not in ("head", "title")]
                opened["head"] = opened["title"] = 0
            for_ = CLOSES.get(tag, ())
            while stack and stack[-1][0] in for_:
                pop()
            names = [n for x in NAMED.finditer(m[4]) for n in (x[1] or x[2] or x[3] or "").lower().split()]
            stack.append((tag, (tag, *names)))
            opened[tag] += 1
    text.append(html[at:])
    flush()
    return title, found


def weak_label(path: tuple[str, ...]) -> int:
    """1 in a container of content, 0 in one of the rest, -1 in neither; the innermost counts."""
    for name in reversed(path):
        if name in REST:
            return 0
        if name in CONTENT:
            return 1
    return -1


def numbers(own: list[Block], first: np.ndarray, n: np.ndarray) -> np.ndarray:
    size = np.array([len(b.text) for b in own], float)
    return np.stack([np.log1p(size) / 8, np.array([b.linked for b in own]) / np.maximum(size, 1), np.array([sum(map(b.text.count, ".,;:!?")) for b in own]) / np.maximum(size, 1) * 10, np.array([b.text[-1] in ".!?:" for b in own], float), first / np.maximum(n, 1), np.array([len(b.path) for b in own]) / 8], axis=1)


class Features:
    """Of all blocks of some pages: hashed words and hashed tag paths, as rows of the two tables of vectors, and numbers."""

    def __init__(self, pages: list[list[Block]], hide: np.ndarray | None = None):
        own = [b for p in pages for b in p]
        n = np.array([len(p) for p in pages], np.int64)
        self.pages = np.concatenate([[0], np.cumsum(n)])
        codes, offsets, distinct = words(pa.array([b.text for b in own], pa.string()))
        of, forms = plain(distinct)
        rows = np.array([xxhash.xxh3_64_intdigest(f) % WORD_ROWS for f in forms] + [0], np.int64)[of][codes] if len(distinct) else np.zeros(0, np.int64)
        keep = of[codes] >= 0
        self.words = rows[keep]
        self.word_ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
        paths = [[t for t in b.path if t not in CONTENT | REST] if hide is not None and h else b.path for b, h in zip(own, np.repeat(hide, n) if hide is not None else np.zeros(len(own)))]
        rows = {t: xxhash.xxh3_64_intdigest(t) % TAG_ROWS for t in set().union(*paths)}
        self.tags = np.fromiter((rows[t] for p in paths for t in p), np.int64)
        self.tag_ends = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int64)
        self.numbers = numbers(own, np.arange(len(own)) - np.repeat(self.pages[:-1], n), np.repeat(n, n)) if own else np.zeros((0, 6))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Labeller:
    def __init__(self, params: dict[str, np.ndarray] | None = None):
        r = np.random.default_rng(SEED)
        self.p = params or {
            "word": r.normal(0, 0.1, (WORD_ROWS, D)), "tag": r.normal(0, 0.3, (TAG_ROWS, D)), "number": r.normal(0, 0.5, (6, D)),
            **{f"{d}{k}": v for d in "fb" for k, v in {"x": r.normal(0, D**-0.5, (D, 4 * H)), "h": r.normal(0, H**-0.5, (H, 4 * H)), "b": np.repeat([0.0, 1.0, 0.0, 0.0], H)}.items()},
            "out": r.normal(0, H**-0.5, 2 * H), "bias": np.zeros(1),
        }

    def vectors(self, f: Features) -> np.ndarray:
        w, t = np.diff(f.word_ends), np.diff(f.tag_ends)
        x = f.numbers @ self.p["number"]
        for lo in range(0, len(w), 2000):  # some blocks at a time, for memory
            a, b = f.word_ends[lo], f.word_ends[min(lo + 2000, len(w))]
            x[lo : lo + 2000] += sums(self.p["word"][f.words[a:b]], f.word_ends[lo : lo + 2001] - a) / np.maximum(w[lo : lo + 2000], 1)[:, None]
        return x + sums(self.p["tag"][f.tags], f.tag_ends) / np.maximum(t, 1)[:, None]

    def lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: steps, pages, D. States of all steps; what the way back needs if keep."""
        steps, n, _ = x.shape
        z = x @ self.p[d + "x"] + self.p[d + "b"]
        h, c = np.zeros((n, H)), np.zeros((n, H))
        out, kept = np.empty((steps, n, H)), []
        for t in range(steps):
            a = z[t] + h @ self.p[d + "h"]
            i, f, o, g = sigmoid(a[:, :H]), sigmoid(a[:, H : 2 * H]), sigmoid(a[:, 2 * H : 3 * H]), np.tanh(a[:, 3 * H :])
            if keep:
                kept.append((i, f, o, g, c, h))
            c = f * c + i * g
            h = o * np.tanh(c)
            out[t] = h
        return out, kept

    def back(self, x: np.ndarray, d: str, kept: list, grad: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
        dx = np.empty_like(x)
        dh, dc = np.zeros(grad.shape[1:]), np.zeros(grad.shape[1:])
        for t in reversed(range(len(x))):
            i, f, o, u, c0, h0 = kept[t]
            c = np.tanh(f * c0 + i * u)
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - c * c)
            da = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * c * o * (1 - o), dc * i * (1 - u * u)], axis=1)
            g[d + "x"] += x[t].T @ da
            g[d + "h"] += h0.T @ da
            g[d + "b"] += da.sum(axis=0)
            dx[t] = da @ self.p[d + "x"].T
            dh, dc = da @ self.p[d + "h"].T, dc * f
        return dx

    def layout(self, f: Features, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block at each step of each page forwards, the same backwards, whether there is one)."""
        n = np.diff(f.pages)[pages]
        t = np.arange(n.max(initial=0))[:, None]
        there = t < n
        return np.where(there, f.pages[pages] + t, 0), np.where(there, f.pages[pages] + n - 1 - t, 0), there

    def score(self, f: Features) -> np.ndarray:
        """Probability of content of every block; pages of like length run side by side."""
        x, out = self.vectors(f), np.zeros(f.pages[-1])
        n = np.diff(f.pages)
        for some in np.array_split(np.argsort(n, kind="stable"), max(1, len(n) // 128)):
            some = some[n[some] > 0]
            if len(some):
                ahead, behind, there = self.layout(f, some)
                for at, d, w in ((ahead, "f", self.p["out"][:H]), (behind, "b", self.p["out"][H:])):
                    out[at[there]] += (self.lstm(x[at], d, False)[0] @ w)[there]
        return sigmoid(out + self.p["bias"])

    def fit(self, pages: list[list[Block]], epochs: int = EPOCHS, batch: int = 16, rate: float = 0.01) -> Labeller:
        r = np.random.default_rng(SEED)
        y = [np.array([weak_label(b.path) for b in p]) for p in pages]
        pages, y = [p for p, v in zip(pages, y) if (v >= 0).any()], [v for v in y if (v >= 0).any()]
        m, v, step = {k: np.zeros_like(p) for k, p in self.p.items()}, {k: np.zeros_like(p) for k, p in self.p.items()}, 0
        for _ in range(epochs):
            for some in np.array_split(r.permutation(len(pages)), max(1, len(pages) // batch)) if pages else []:
                f = Features([pages[i] for i in some], r.random(len(some)) < 0.5)
                label = np.concatenate([y[i] for i in some])
                x = self.vectors(f)
                ahead, behind, there = self.layout(f, np.arange(len(some)))
                runs = [(at, d, *self.lstm(x[at], d, True), self.p["out"][o : o + H]) for at, d, o in ((ahead, "f", 0), (behind, "b", H))]
                logit = np.zeros(len(label)) + self.p["bias"]
                for at, _, h, _, w in runs:
                    logit[at[there]] += (h @ w)[there]
                error = np.where(label >= 0, sigmoid(logit) - label, 0.0) / max(1, (label >= 0).sum())
                g = {k: np.zeros_like(p) for k, p in self.p.items()}
                g["bias"][0] = error.sum()
                dx = np.zeros_like(x)
                for (at, d, h, kept, w), o in zip(runs, (0, H)):
                    e = np.where(there, error[at], 0.0)
                    g["out"][o : o + H] = np.einsum("tn,tnh->h", e, h)
                    np.add.at(dx, at[there], self.back(x[at], d, kept, e[:, :, None] * w, g)[there])
                g["number"] = f.numbers.T @ dx
                for name, rows, ends in (("word", f.words, f.word_ends), ("tag", f.tags, f.tag_ends)):
                    n = np.diff(ends)
                    np.add.at(g[name], rows, np.repeat(dx / np.maximum(n, 1)[:, None], n, axis=0))
                step += 1
                for k, p in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        if not pages:
            self.p["out"][:], self.p["bias"][0] = 0, 10.0  # nothing to learn from: every block counts as content
        return self


def train(pages: DataFrame, sample: int = TRAIN_PAGES, chars: int = TRAIN_CHARS) -> Labeller:
    """Fits to about sample pages of about chars characters at most, drawn whatever their length. Rows with a null page_id or html don't count."""
    have = pages.where("page_id is not null and html is not null").select(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)).alias("at"), "html")
    n, size = have.agg(F.count("*"), F.coalesce(F.sum(F.length("html")), F.lit(0))).first()
    rows = have.where(F.col("at") < int((1 << 30) * min(1.0, sample / max(n, 1), chars / max(size, 1)))).collect()
    return Labeller().fit([blocks(r.html)[1] for r in sorted(rows)])


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """(page_id, title, text, n_blocks, n_content) for each row: the content blocks in their order, an empty line between.

    Null html has null in all columns but page_id; a page without text, or with no block of content, has an empty one.
    Rows are independent: repeated ones, those with a null page_id and pages of any length are read like others.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(labeller.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(shared.value)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                html = batch.column(1).slice(lo, hi - lo).to_pylist()
                titles, found = zip(*(blocks(x or "") for x in html))
                f = Features(list(found))
                content = model.score(f) >= 0.5
                text = ["\n\n".join(b.text for b, c in zip(own, content[at:]) if c) for own, at in zip(found, f.pages.tolist())]
                null = np.array([x is None for x in html])
                keep = sums(content.astype(np.int64), f.pages)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(titles, pa.string(), mask=null), pa.array(text, pa.string(), mask=null), pa.array(np.diff(f.pages).astype(np.int32), mask=null), pa.array(keep.astype(np.int32), mask=null)],
                    ["page_id", "title", "text", "n_blocks", "n_content"],
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, title string, text string, n_blocks int, n_content int")
