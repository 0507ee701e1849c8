import math
import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import html as H


def words(r, n, own="abcdefgh"):
    return " ".join("".join(r.choices(own, k=r.randrange(2, 8))) for _ in range(n))


def page(seed, plain=False):
    """A page and its content; plain ones have div for every container."""
    r = random.Random(seed)
    body = [words(r, r.randrange(4, 60)).capitalize() + "." for _ in range(r.randrange(1, 9))]
    c = ("div", "div", "div") if plain else ("nav", "article", "footer")
    nav = "".join(f"<li><a href=/x>{words(r, 1, 'xyzu')}</a>" for _ in range(r.randrange(3, 8)))
    head = words(r, 5)
    return f"<!DOCTYPE html><html><head><title>{head}</title><script>var t='</p>';</script></head><body><{c[0]}><ul>{nav}</ul></{c[0]}><!-- x --><div class='ad'>{words(r, 4, 'xyzu')}</div><{c[1]}><h1>{head}</h1>" + "".join(f"<p>{b}" for b in body) + f"</{c[1]}><{c[2]}>&copy; {words(r, 3, 'xyzu')}</{c[2]}>" + ("</body></html>" if seed % 2 else ""), "\n\n".join([head, *body])


def test_blocks():
    title, got = H.blocks("<html><head><title>A &amp; B</title><style>p{}</style></head><body class=x><p>one <b>two</b><br>three<p>four <a href='/>'>five</a><script>if (a<b) '</p>'</script><ul><li>x<li>y</ul>tail<!-- no --> end<div")
    assert title == "A & B"
    assert [b.text for b in got] == ["one two", "three", "four five", "x", "y", "tail end"]
    assert got[2].path == ("html", "body", "x", "p") and got[2].linked == 4 and got[3].path[-2:] == ("ul", "li")
    assert H.blocks("") == ("", []) and H.blocks("just text")[1][0].text == "just text"


def test_long_pages_take_linear_time():
    """Quotes that never close, tags that are never closed or never were opened: a megabyte each."""
    for own in ("<a " * 330_000 + '"', '<a b="' * 170_000, "<p class='x" * 90_000, "<div>x" * 170_000, "<div>" * 100_000 + "</p>" * 100_000, "</script" + " " * 10**6, "<" * 10**6, "<script" * 140_000, "<!-- " * 200_000):
        began = time.perf_counter()
        _, got = H.blocks(own)
        H.Features([got])
        assert time.perf_counter() - began < 8
    assert [b.text for b in H.blocks("<p title=it's>it's<p>a \"b\" c<a href='x>y'>d</a><i e=\"f>g")[1]] == ["it's", 'a "b" cd']


def brute_lstm(m, x, d):
    """States of one page, by loops over single numbers."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    h, c, out = [0.0] * H.H, [0.0] * H.H, []
    for row in x:
        a = [sum(row[i] * m.p[d + "x"][i, j] for i in range(H.D)) + sum(h[i] * m.p[d + "h"][i, j] for i in range(H.H)) + m.p[d + "b"][j] for j in range(4 * H.H)]
        c = [sig(a[H.H + j]) * c[j] + sig(a[j]) * math.tanh(a[3 * H.H + j]) for j in range(H.H)]
        h = [sig(a[2 * H.H + j]) * math.tanh(c[j]) for j in range(H.H)]
        out.append(h)
    return out


def test_scores_against_a_plain_network():
    """Whole pages: vectors of hashed words and paths, both directions and the output, one block at a time."""
    pages = [H.blocks(page(i)[0])[1] for i in range(3)] + [[]]
    m = H.Labeller()
    got = m.score(H.Features(pages))
    want = []
    for own in pages:
        x = []
        for k, b in enumerate(own):
            ws = [w for w in ("".join(ch for ch in t.lower() if ch.isalnum()) for t in b.text.split()) if w]
            v = sum((m.p["word"][xxhash.xxh3_64_intdigest(w) % H.WORD_ROWS] for w in ws), np.zeros(H.D)) / max(1, len(ws))
            v = v + sum((m.p["tag"][xxhash.xxh3_64_intdigest(t) % H.TAG_ROWS] for t in b.path), np.zeros(H.D)) / max(1, len(b.path))
            size = len(b.text)
            f = [math.log1p(size) / 8, b.linked / size, sum(ch in ".,;:!?" for ch in b.text) / size * 10, float(b.text[-1] in ".!?:"), k / len(own), len(b.path) / 8]
            x.append(v + sum(n * m.p["number"][i] for i, n in enumerate(f)))
        ahead, behind = brute_lstm(m, x, "f"), brute_lstm(m, x[::-1], "b")[::-1]
        want += [1 / (1 + math.exp(-(np.dot(a, m.p["out"][: H.H]) + np.dot(b, m.p["out"][H.H :]) + m.p["bias"][0]))) for a, b in zip(ahead, behind)]
    assert got.tolist() == pytest.approx(want)


def test_gradients():
    r = random.Random(0)
    pages = [H.blocks(page(i)[0])[1] for i in range(3)]
    m = H.Labeller()
    f = H.Features(pages)
    y = np.concatenate([[H.weak_label(b.path) for b in p] for p in pages])
    ahead, behind, there = m.layout(f, np.arange(3))

    def loss():
        s = np.clip(m.score(f), 1e-12, 1 - 1e-12)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).sum()

    x = m.vectors(f)
    g = {k: np.zeros_like(p) for k, p in m.p.items()}
    error = m.score(f) - y
    for at, d, o in ((ahead, "f", 0), (behind, "b", H.H)):
        _, kept = m.lstm(x[at], d, True)
        m.back(x[at], d, kept, np.where(there, error[at], 0.0)[:, :, None] * m.p["out"][o : o + H.H], g)
    for name in ("fx", "fh", "fb", "bx", "bh", "bb"):
        for _ in range(4):
            k = tuple(r.randrange(n) for n in m.p[name].shape)
            old = m.p[name][k]
            m.p[name][k] = old + 1e-5
            up = loss()
            m.p[name][k] = old - 1e-5
            down = loss()
            m.p[name][k] = old
            assert g[name][k] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_held_out_accuracy(spark):
    rows = [(i, *page(i)) for i in range(200)]
    df = spark.createDataFrame([(i, "u", h) for i, h, _ in rows], "page_id long, url string, html string")
    model = H.train(df.where("page_id < 120"))
    got = {x.page_id: x for x in H.extract(df.where("page_id >= 120"), model).collect()}
    assert sum(got[i].text == t for i, _, t in rows[120:]) >= 0.95 * 80
    hidden = [page(1000 + i, plain=True) for i in range(60)]  # no tag says what the content is
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(hidden)], "page_id long, html string")
    got = {x.page_id: x.text for x in H.extract(df, model).collect()}
    assert sum(got[i] == t for i, (_, t) in enumerate(hidden)) >= 0.9 * 60


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "<p>some text here."), (3, "<script>only"), (4, "<p>" + "word " * 100_000), (5, "<p>x" * 3000), (6, "<<>><a"), (6, "<<>><a")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(3)).withColumn("title", F.lit(None).cast("int"))
    model = H.train(df)
    got = H.extract(df, model).collect()
    assert [r.page_id for r in got] == [r[0] for r in rows] and got[0].text is None and got[1].text == "" and got[1].n_blocks == 0
    assert got[2].text == "some text here." and got[5].n_blocks == 3000 and len(got[4].text) == 499_999
    assert H.extract(df.limit(0), model).count() == 0
