import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.operators import extract as E
from spanloom.operators import patterns as P


def test_html_layout():
    text, spans = E.extract_html("<html><body><p id=1>test</p></body></html>")
    assert text == "test" and [(b, e, t) for b, e, t, _ in spans if t == "p"] == [(0, 4, "p")]
    assert E.extract_html("<p>a<br>b</p><div>c <b>d</b>e</div><ul><li>x<li>y</ul><script>no</script>")[0] == "a\nb\n\nc d e\n\nx\ny"
    assert E.extract_html("<p><a><img alt='email' title='Email'></a>, and <img alt='gamma'>x</p>")[0] == "Email email , and γx"
    assert E.extract_html("<title>t</title><p>  </p>")[0] == ""


def test_xml():
    text, spans = E.extract_layout_xml("<ja:article xmlns:ja='j' xmlns:ce='c'><ce:para>test</ce:para><ce:para>again</ce:para></ja:article>", "elsevier")
    assert text == "test\n\nagain" and [(b, e) for b, e, *_ in spans] == [(0, 11), (0, 4), (6, 11)]
    assert E.extract_xml("<a>x<b>y</b></a>")[0] == "x\n\ty\n"
    assert E.extract_layout_xml("<article><p>a<break/>b</p><kwd>c</kwd><kwd>d</kwd></article>", "pmc")[0] == "a\nb\n\nc\nd"


def test_extract_over_rows(spark):
    df = spark.createDataFrame([(1, "<p>α one</p>", "a.html"), (2, None, "b.html"), (3, "<x>bad", "c.xml"), (4, "plain  text", "d.txt"), (5, "<r><q>z</q></r>", "e.xml")], "doc_id long, raw string, uri string")
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in E.extract(df, kind=E.kind_of(F.col("uri"), F.col("raw")), greek_to_latin=True, namespace="http://x").collect()}
    assert got[1].text == "alpha one" and got[1].structure[0].namespace == "http://x#" and got[2].text is None
    assert got[3].text == "bad" and got[4].text == "plain text" and got[5].text == "\tz\n"
    assert E.structure(E.extract(df.limit(1))).count() == 1


def tagged(*chunks):
    """Tokens of chunks ("NP", "The_DT_the ..."); a tag of None for none."""
    out, at = [], 0
    for tag, words in chunks:
        own = [w.split("_") for w in words.split()]
        for i, (text, pos, stem) in enumerate(own):
            out.append({"text": text, "pos": pos, "stem": stem, "chunk": tag, "chunk_begin": bool(tag) and i == 0, "chunk_end": bool(tag) and i == len(own) - 1, "begin": at, "end": at + len(text)})
            at += len(text) + 1
    return out


ONE = tagged(("NP", "The_DT_the CD5_NN_cd5 factor_NN_factor"), ("VP", "has_VBZ_have been_VBN_be shown_VBN_show to_TO_to bind_VB_bind"), ("PP", "at_IN_at"), ("NP", "the_DT_the XYZ_NN_xyz gene_NN_gene"), ("ADVP", "in_FW_in vivo_FW_vivo"), (None, "._._."))
TWO = tagged(("NP", "A_DT_a INK_NN_ink protein_NN_protein"), ("VP", "was_VBZ_be regulating_VB_regulate"), ("NP", "a_DT_a XYZ_NN_xyz promoter_NN_promoter"), ("ADVP", "in_FW_in vivo_FW_vivo"), (None, "._._."))


def spans(pattern, tokens):
    return [[" ".join(t["text"] for t in tokens[a:b]) for _, (a, b) in sorted(g.items()) if b > a] for _, _, g in P.find_all(pattern, tokens)]


def test_phrases_and_groups():
    p = "( [ NP . + ] ) [ VP . * ( . ) ] [ PP ( . * ) ] ( [ NP . + ] )"
    assert spans(p, ONE) == [["The CD5 factor", "bind", "at", "the XYZ gene"]]
    assert spans(p, TWO) == [["A INK protein", "regulating", "a XYZ promoter"]]
    p = "( [ NP . + ] ) [ VP . * ( bind|regulate ) ] [ PP . * ] [ NP DT_* ? ( . + ) target ? gene|promoter ]"
    assert spans(p, ONE) == [["The CD5 factor", "bind", "XYZ"]] and spans(p, TWO) == [["A INK protein", "regulating", "XYZ"]]


def test_named_tokens_come_first():
    own = tagged(("NP", "The_DT_the ATP/ADP-binding_JJ_atp/adp-binding site_NN_site"), ("PP", "in_IN_in"), ("NP", "the_DT_the Hsp90_NN_hsp90 molecular_JJ_molecular chaperone_NN_chaperone"), (None, "._._."))
    assert spans("[ NP DT_* ? ( . + ) site ] [ VP . * ] [ PP . * IN_* ] [ NP DT_* ? ( . + ) ]", own) == [["ATP/ADP-binding", "Hsp90 molecular chaperone"]]


def test_finding():
    two = [{"text": "x"}, {"text": "y"}]
    assert P.find("", two)[:2] == (0, 0) and P.find(". *", two)[:2] == (0, 0) and P.find(". ?", two)[:2] == (0, 0)
    assert P.find(". +", [])is None and P.find(". +", two)[:2] == (0, 1) and P.find("*_*", two)[:2] == (0, 1) and P.find("( )", two) == (0, 0, {0: (0, 0)})
    assert P.find("[ CHUNK . ]", two) is None
    assert P.find(r"\_a\__*_*", [{"text": "_a_"}])[:2] == (0, 1)
    for bad in ("[ A [ B . ] ]", "( a", "a )", "a_b_", "a_b_c_d"):
        with pytest.raises(ValueError):
            P.compile_pattern(bad)


def test_nested_repetitions_take_linear_time():
    own = [{"text": "a", "pos": "a", "stem": "a"}] * 3000
    began = time.perf_counter()
    assert P.find("( ( a + ) + ) b", own) is None and P.find("( ( . * ) * ) * b", own[:500]) is None
    assert time.perf_counter() - began < 5
    assert P.find("( ( a + ) + ) a", own[:50], 0, True)[:2] == (0, 50) and P.find("( b * ) + a", own)[:2] == (0, 1)


def brute(items, tokens, i, greedy, tag=""):
    """Ends of all matches of items at token i, by priority: plain backtracking."""
    if not items:
        yield i
        return
    first, rest = items[0], items[1:]

    def once(i):
        if first.kind == "group":
            yield from brute(first.items, tokens, i, greedy, tag)
        elif first.kind == "phrase":
            for j in brute(first.items, tokens, i, greedy, first.tag):
                if j == i or (tokens[i]["chunk_begin"] and tokens[j - 1]["chunk_end"]):
                    yield j
        elif i < len(tokens):
            t = tokens[i]
            if all(t[n] and rx.fullmatch(t[n]) for n, rx in first.tests) if first.tests else not tag or t["chunk"] == tag:
                yield i + 1

    def many(i, least):
        more = greedy or first.kind == "token"
        if least <= 0 and not more:
            yield i
        for j in once(i):
            if j > i:
                yield from [j] if first.quantity == "?" else many(j, 0)
            elif least:
                yield j
        if least <= 0 and more:
            yield i

    for j in many(i, first.quantity == "+") if first.quantity else once(i):
        yield from brute(rest, tokens, j, greedy, tag)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", ". *", ". +", "a ?", "b *", "( a b ? )", "( . * )", "[ NP . + ]", "[ NP a * ] ?", "( a ) *", "[ VP . * b ]"]), min_size=1, max_size=4), st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["NP", "VP", None]), st.booleans(), st.booleans()), max_size=6), st.booleans())
def test_machine_is_backtracking(parts, rows, greedy):
    tokens = [{"text": t, "pos": t, "stem": t, "chunk": c, "chunk_begin": b, "chunk_end": e} for t, c, b, e in rows]
    pattern = " ".join(parts)
    for i in range(len(tokens) + 1):
        want = next(brute(P.compile_pattern(pattern)[0], tokens, i, greedy), None)
        got = P.match_at(pattern, tokens, i, greedy)
        assert (got and got[0]) == want


def test_annotate_rows(spark):
    kind = "array<struct<text: string, pos: string, stem: string, chunk: string, chunk_begin: boolean, chunk_end: boolean, begin: int, end: int>>"
    df = spark.createDataFrame([(1, 1, ONE), (1, 2, TWO), (2, 1, [])], f"doc_id long, sent_no int, tokens {kind}")
    pairs = [("rel", "interaction"), ("sem", "actor"), ("sem", "action"), ("sem", "qualifier"), ("sem", "actor")]
    got = P.annotate(df, [("( [ NP . + ] ) [ VP . * ( . ) ] [ PP ( . * ) ] ( [ NP . + ] )", pairs)]).orderBy("sent_no", "part").collect()
    assert [r.identifier for r in got] == ["interaction", "actor", "action", "qualifier", "actor", "interaction", "actor", "action", "actor"]
    assert [tuple(r) for r in P.hits(P.annotate(df, [("( [ NP . + ] )", pairs[:2])])).collect()] == [(0, 4)]  # two noun phrases a sentence


def test_plain_text_is_whole(spark):
    df = spark.createDataFrame([(1, "<head>no</head><body class=x>" + "ab " * 500_000 + "</body> no"), (2, "x")], "doc_id long, raw string")
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in E.extract(df, kind=F.lit("clean")).collect()}
    assert len(got[1].text) == 1_499_999 and got[2].text == "x"
    got = {r.doc_id: r for r in E.extract(df, kind=F.lit("clean"), most_chars=1000).collect()}
    assert len(got[1].text) == 1000 and got[1].cut and not got[2].cut
