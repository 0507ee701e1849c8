"""String distances and similarities that Spark lacks, over Arrow batches: all pairs of a batch side by side, by numpy."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .text import GREEK

_LATIN = {"α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "t", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "p", "χ": "c", "ψ": "p", "ω": "o"}


def _matrix(strings: list[str], pad: int) -> np.ndarray:
    """A row of code points for each string, filled up by pad."""
    out = np.full((len(strings), max(map(len, strings), default=0)), pad, np.int32)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _groups(a: list[str], b: list[str], cells: int = 1 << 22) -> Iterator[np.ndarray]:
    """Places of pairs of like length, a bounded number of cells at a time."""
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    order = np.lexsort((m, n))
    lo = 0
    while lo < len(order):
        widest, hi = 1, lo
        while hi < len(order) and (hi - lo + 1) * max(widest, int(m[order[hi]]) + 1, int(n[order[hi]]) + 1) <= cells or hi == lo:
            widest = max(widest, int(m[order[hi]]) + 1, int(n[order[hi]]) + 1)
            hi += 1
        yield order[lo:hi]
        lo = hi


def _edits(a: list[str], b: list[str], cost, unit: int, swaps: bool = False) -> np.ndarray:
    """Distances of the pairs by rows of the usual table, all pairs side by side. cost: of two columns of characters."""
    out = np.zeros(len(a), np.int64)
    for own in _groups(a, b):
        x, y = [a[i] for i in own.tolist()], [b[i] for i in own.tolist()]
        n, m = (np.fromiter(map(len, z), np.int64, len(z)) for z in (x, y))
        p, q = _matrix(x, -1), _matrix(y, -2)
        row = np.tile(np.arange(q.shape[1] + 1) * unit, (len(own), 1))
        every, before = np.arange(len(own)), None
        result = row[every, m].copy()
        for i in range(p.shape[1]):
            last, row, two = row, np.empty_like(row), before
            row[:, 0] = unit * (i + 1)
            free = cost(p[:, i : i + 1], q)
            for j in range(q.shape[1]):
                row[:, j + 1] = np.minimum(np.minimum(last[:, j + 1], row[:, j]) + unit, last[:, j] + free[:, j])
                if swaps and i and j:
                    ok = (p[:, i] == q[:, j - 1]) & (p[:, i - 1] == q[:, j])
                    row[:, j + 1] = np.where(ok, np.minimum(row[:, j + 1], two[:, j - 1] + 1), row[:, j + 1])
            before = last
            done = n == i + 1
            result[done] = row[every[done], m[done]]
        out[own] = result
    return out


def _case_costs(a: list[str], b: list[str]):
    """0 for equal characters, 1 for those that differ by case, or a Greek letter and its Latin one, else 2."""
    chars = sorted(set("".join(a)) | set("".join(b)))
    low: dict[str, int] = {}
    small = [low.setdefault(c.lower(), len(low)) for c in chars]
    latin = [low.get(_LATIN.get(c.lower(), ""), -1) for c in chars]
    codes = np.array([ord(c) for c in chars] or [0])
    small, latin = np.array(small or [0]), np.array(latin or [0])

    def cost(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        i, j = (np.minimum(np.searchsorted(codes, z), len(codes) - 1) for z in (x, y))
        near = (small[i] == small[j]) | (latin[i] == small[j]) | (latin[j] == small[i])
        return np.where(x == y, 0, np.where(near, 1, 2))

    return cost


def case_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Insertion, deletion and substitution cost 2; a substitution by case or between alphabets 1."""
    return _edits(a, b, _case_costs(a, b), 2)


def osa_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Optimal string alignment: a transposition costs 1, no part is edited twice."""
    return _edits(a, b, lambda x, y: (x != y).astype(np.int64), 1, swaps=True)


def _ratios(distances: np.ndarray, a: list[str], b: list[str], unit: int) -> np.ndarray:
    longest = np.array([max(len(x), len(y), 1) for x, y in zip(a, b)])
    some = np.array([bool(x and y) for x, y in zip(a, b)], bool)
    return np.where([x == y for x, y in zip(a, b)], 1.0, np.where(some, 1 - distances / (unit * longest), 0.0))


def case_similarities(a: list[str], b: list[str]) -> np.ndarray:
    return _ratios(case_distances(a, b), a, b, 2)


def osa_similarities(a: list[str], b: list[str]) -> np.ndarray:
    return _ratios(osa_distances(a, b), a, b, 1)


def jaros(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros(len(a))
    for own in _groups(a, b):
        x, y = [a[i] for i in own.tolist()], [b[i] for i in own.tolist()]
        n, m = (np.fromiter(map(len, z), np.int64, len(z)) for z in (x, y))
        window = np.maximum(0, np.maximum(n, m) // 2 - 1)
        p, q = _matrix(x, -1), _matrix(y, -2)
        mine, used = np.zeros(p.shape, bool), np.zeros(q.shape, bool)
        for i in range(p.shape[1]):
            for j in range(max(0, i - int(window.max())), min(q.shape[1], i + int(window.max()) + 1)):
                hit = ~mine[:, i] & ~used[:, j] & (p[:, i] == q[:, j]) & (abs(i - j) <= window)
                mine[:, i] |= hit
                used[:, j] |= hit
        both = mine.sum(axis=1)
        order = [np.take_along_axis(z, np.argsort(~k, axis=1, kind="stable"), axis=1)[:, : both.max(initial=0)] for z, k in ((p, mine), (q, used))]
        swaps = ((order[0] != order[1]) & (np.arange(order[0].shape[1]) < both[:, None])).sum(axis=1) // 2
        some = np.maximum(both, 1)
        out[own] = np.where(both > 0, (both / np.maximum(n, 1) + both / np.maximum(m, 1) + (both - swaps) / some) / 3, 0.0)
    return np.where([x == y for x, y in zip(a, b)], 1.0, out)


def jaro_winklers(a: list[str], b: list[str], weight: float = 0.1, longest: int = 4) -> np.ndarray:
    """Boosted by the common prefix whatever the Jaro similarity."""
    base = jaros(a, b)
    n = np.array([len(os.path.commonprefix([x[:longest], y[:longest]])) for x, y in zip(a, b)])
    return base + n * weight * (1 - base)


FUNCTIONS: dict[str, tuple[Callable, str]] = {
    "case_distance": (case_distances, "int"), "case_similarity": (case_similarities, "double"), "osa_distance": (osa_distances, "int"), "osa_similarity": (osa_similarities, "double"), "jaro": (jaros, "double"), "jaro_winkler": (jaro_winklers, "double"),
}


def of(name: str, a: str, b: str) -> float:
    """The function of that name (FUNCTIONS) for one pair."""
    return FUNCTIONS[name][0]([a], [b])[0].item()


def column(name: str):
    """The function of that name (FUNCTIONS) over two string columns; null where either is. Each distinct pair is worked out once a batch."""
    f, kind = FUNCTIONS[name]

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = [p for p in dict.fromkeys(zip(a, b)) if None not in p]
        found = dict(zip(pairs, f([x for x, _ in pairs], [y for _, y in pairs]).tolist())) if pairs else {}
        return pd.Series([found.get(p) for p in zip(a, b)], dtype="Int64" if kind == "int" else "float64")

    run.__name__ = name
    return F.pandas_udf(run, kind)


assert set(GREEK) <= set(_LATIN)
