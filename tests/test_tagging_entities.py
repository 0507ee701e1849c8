import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.functions import similarity as S
from spanloom.operators import entities as E
from spanloom.operators import gazetteer as G
from spanloom.operators import segment
from spanloom.operators import tagging as T


def test_known_entities(spark):
    text = "The mouse Tumor necrosis factor alpha (Tnf-alpha) gene, TNF ALPHA and tnf."
    found = lambda *names: [text[b:e] for b, e, _ in E.find_entities(text, {("gene", "n", "1"): list(names)})]
    assert found("tumor necrosis factor alpha", "Tnf-alpha") == ["Tnf-alpha"]  # found by case, so not looked for without it
    assert found("tumor necrosis factor alpha", "tnf-alpha") == ["Tumor necrosis factor alpha", "Tnf-alpha", "TNF ALPHA"]
    docs = spark.createDataFrame([(1, "This is an entity mention inside the text.\n"), (2, None)], "doc_id long, text string")
    ents = spark.createDataFrame([(1, "type", "ns", "id"), (2, "type", "ns", "id")], "doc_id long, type string, namespace string, id string")
    known = spark.createDataFrame([("ns", "id", "entity mention")], "namespace string, id string, name string")
    assert [tuple(r) for r in E.known_entities(docs, ents, known).collect()] == [(1, 11, 25, "entity mention", "type", "ns", "id")]


def test_name_pattern():
    p = E.name_pattern(["ab 1", "longer-name"])
    assert p.index("longer") < p.index("ab") and r"longer\W*name" in p and r"ab\W*1" in p


def test_rule_tagger(spark):
    own = T.rule_tagger("The dogs jumped quickly, and slept.")
    assert [t["pos"] for t in own] == ["DT", "NNS", "VBD", "RB", ",", "CC", "NN", "."]
    assert own[0]["chunk_begin"] and own[1]["chunk_end"] and own[1]["stem"] == "dog" and own[2]["stem"] == "jump"
    s = spark.createDataFrame([(1, 1, 5, 14, "The dogs."), (1, 2, 20, 10020, "x " * 5000), (1, 3, 0, 0, ""), (None, 1, 0, 2, None)], "doc_id long, sent_no int, begin int, end int, text string")
    r, long, empty, null = T.tag_sentences(s).collect()
    assert [(t.begin, t.end) for t in r.tokens] == [(5, 8), (9, 13), (13, 14)] and T.token_rows(T.tag_sentences(s)).count() == 5003
    assert len(long.tokens) == 5000 and empty.tokens == [] and null.tokens is None

    def picky(text):
        if "dogs" in text:
            raise ValueError("no dogs")
        return T.rule_tagger(text)

    assert [(r.doc_id, r.sent_no) for r in T.failed(T.tag_sentences(s, picky)).collect()] == [(1, 1), (None, 1)]


def test_process_tagger(spark):
    program = "import sys\nfor l in sys.stdin:\n    for w in l.split(): print(w, w.lower(), 'NN', 'B-NP', 'B-protein', sep='\\t')\n    print(flush=True)"
    tag = T.process_tagger([sys.executable, "-c", program])
    assert [t["stem"] for t in tag("Ab Cd")] == ["ab", "cd"] and [t["begin"] for t in tag("x  y")] == [0, 3]


def test_program_that_stops_answering():
    program = "import sys, time\nfor l in sys.stdin:\n    if 'wait' in l: time.sleep(60)\n    print('x\\tx\\tNN\\tO\\n', flush=True)"
    tag = T.process_tagger([sys.executable, "-c", program], timeout=3, most_chars=10)
    for bad in ("x wait", "x" * 11):
        with pytest.raises((OSError, ValueError)):
            tag(bad)
    assert [t["text"] for t in tag("a x")] == ["x"]


def test_parsing_by_parts():
    parse = lambda s: None if len(s) > 12 else f"(S (NP {s.strip()}))"
    assert T.parsed("one two; three four", parse, most=12) == [] and T.parsed("(", lambda s: None) == []
    parse = lambda s: None if len(s) > 12 else f"(S (NP {s.split()[0]}) (VP {s.split()[1]}))"
    assert T.parsed("one two; three four", parse, most=12) == [(0, 3, "NP"), (4, 7, "VP"), (9, 14, "NP"), (15, 19, "VP")]


def test_lemma():
    lexicon = {"left": {"JJ": "left", "VBD": "leave"}, "mice": {"NNS": "Mouse"}}
    assert T.lemma("Left", "VBD", lexicon) == "leave" and T.lemma("mice", "NN", lexicon) == "mouse" and T.lemma("left", "NN", lexicon) == "left" and T.lemma("are", "VBZ") == "be"


def test_constituents():
    s = "The dog barks"
    assert T.constituents("(S (NP The dog) (VP (V barks)))", s) == [(0, 7, "NP"), (8, 13, "V")]


def test_relation_patterns():
    s = "ENT1, a regulator, interacts with the big ENT2."
    ents = [(0, 4, "e:1"), (42, 46, "e:2")]
    assert T.relation_patterns(s, ents) == ["[[e:1]], a regulator, interacts with the big [[e:2]]"]
    assert "[[e:1]], a regulator, interacts with [[e:2]]" in T.relation_patterns(s, ents, [(34, 46, "NP")])
    assert T.relation_patterns(s, [(0, 4, "a"), (2, 6, "b")]) == []


def test_expansions():
    text = " gene7-9 : gene7/9, proteinB and proteinA-B"
    assert G.expansion(text, 1, 6) == ("n", "gene", 8, 9, 8)
    assert G.expansion(text, 11, 16) == ("=", "gene9", 0, 0, 18)
    assert G.expansion(text, 33, 41) == ("c", "protein", 66, 66, 43) and G.expansion(text, 20, 28) is None


def test_long_lists_are_not_written_out(spark):
    names = [("1", "gene 1"), ("7", "gene 2999999"), ("8", "gene 3000001"), ("9", "gene 007"), ("b", "proteinB"), ("c", "ProteinC"), ("e", "proteinE"), ("g", "Xβ"), ("x", "gene " + "9" * 60)]
    gaz = spark.createDataFrame(names, "id string, name string")
    docs = spark.createDataFrame([(1, "gene 1-3000000 and gene 1-" + "9" * 5000), (2, "proteinA-C, Proteina-c, xα-γ"), (3, None)], "doc_id long, text string")
    hits = spark.createDataFrame([(1, 0, 6), (1, 19, 25), (2, 0, 8), (2, 12, 20), (2, 24, 26), (3, 0, 1)], "doc_id long, begin int, end int")
    got = {(r.doc_id, r.begin, r.id) for r in G.match_expansions(docs, hits, gaz).collect()}
    assert got == {(1, 0, "7"), (1, 19, "7"), (1, 19, "8"), (2, 0, "b"), (2, 0, "c"), (2, 12, "b"), (2, 12, "c"), (2, 24, "g")}
    assert {r.id for r in G.match_expansions(docs, hits, gaz, case_sensitive=True).where("doc_id = 2").collect()} == {"b"}


def test_variants_and_boundaries():
    assert sorted(G.variants("aa aa")) == ["aa aa", "aa-aa"] and sorted(G.variants("bbAA")) == ["bb AA", "bb-AA", "bbAA"]
    assert set(G.variants("ABC 123")) == {"ABC 123", "ABC-123"} and list(G.variants("gene7")) == ["gene7"]
    assert len(set(G.variants("a1b2c3d4e5f"))) == 3**9
    assert [G.is_boundary("ABCdef Ab1", i) for i in range(11)] == [True, False, False, True, False, False, True, True, False, True, True]


def test_names_of_many_gaps(spark):
    """Texts match that are variants of a name, and no others: against all of them written out."""
    gaz = spark.createDataFrame([("1", "a1b2c3d4e5f"), ("2", "IL 2-receptor"), ("3", "bbAA"), ("4", None)], "id string, name string")
    texts = ["a1b2c3d4e5f", "a-1b 2c3-d4 e-5f", "A 1 b 2 c 3 d 4 e 5f", "a1b2c3 d4e5 f", "IL-2 receptor", "il2receptor", "IL 2receptor", "IL  2 receptor", "bb-aa", "b baa", "bbaa, bb aa", "x bbaa y", "bbaax"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id long, text string")
    got = {(r.doc_id, r.match, r.id) for r in G.match_variants(docs, gaz).collect()}
    listed = {(r.doc_id, r.match, r.id) for r in G.match_tokens(docs, G.with_variants(gaz), most_words=None).collect()}
    assert got == listed and {d for d, *_ in got} == {0, 1, 2, 4, 6, 8, 10, 11}
    assert G.match_variants(docs, gaz.where("id = '4'")).count() == 0
    loose = {(r.doc_id, r.match, r.id) for r in G.match_approximate(docs, gaz).collect()}
    assert got <= loose and {d for d, *_ in loose} == {*range(12)} - {9} | {9}


def test_scopes_and_prefixes(spark):
    docs = spark.createDataFrame([(1, "alpha beta alphabet beta alpha"), (2, "alpha"), (2, "no alpha"), (None, "alpha")], "doc_id long, text string")
    gaz = spark.createDataFrame([("1", "alpha"), ("2", "beta")], "id string, name string")
    scopes = spark.createDataFrame([(1, 6, 19), (1, 6, 19), (1, 11, 24), (3, 0, 5)], "doc_id long, begin int, end int")
    got = lambda m: sorted((r.doc_id, r.begin, r.end, r.match) for r in G.in_scope(docs, scopes, m).collect())
    assert got(lambda d: G.match_tokens(d, gaz)) == [(1, 6, 10, "beta"), (1, 20, 24, "beta")]
    assert got(lambda d: G.match_everywhere(d, gaz)) == [(1, 6, 10, "beta"), (1, 11, 16, "alpha"), (1, 20, 24, "beta")]
    keys = spark.createDataFrame([("a", 1), ("alp", 2), ("alpha b", 3), ("b", 4), ("", 5), (None, 6)], "key string, value int")
    own = G.prefixes(docs, keys)
    assert sorted((r.text, r.value) for r in own.where("doc_id = 1").collect()) == [("alpha beta alphabet beta alpha", v) for v in (1, 2, 3)]
    assert G.prefixes(docs, keys.where("key is null")).count() == 0


def test_rows_that_share_an_id(spark):
    """Texts with the same doc_id, or none, are segmented and matched each by itself."""
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "gamma delta"), (None, "x beta"), (None, "beta. Y")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.tok_no, r.begin, r.end, r.text) for r in segment.tokens(docs).collect())
    assert got == sorted([("1", 1, 0, 5, "alpha"), ("1", 2, 6, 10, "beta"), ("1", 1, 0, 5, "gamma"), ("1", 2, 6, 11, "delta"), ("None", 1, 0, 1, "x"), ("None", 2, 2, 6, "beta"), ("None", 1, 0, 4, "beta"), ("None", 2, 6, 7, "Y")])
    assert sorted((r.sent_no, r.begin, r.text) for r in segment.sentences(docs.where("doc_id is null")).collect()) == [(1, 0, "beta."), (1, 0, "x beta"), (2, 6, "Y")]
    gaz = spark.createDataFrame([("1", "beta"), ("2", "x beta")], "id string, name string")
    assert sorted((r.begin, r.id) for r in G.match_tokens(docs, gaz, most_words=None).where("doc_id is null").collect()) == [(0, "1"), (0, "2"), (2, "1")]
    assert "Exchange" not in segment.tokens(docs)._jdf.queryExecution().executedPlan().toString()


def test_matching(spark):
    gaz = spark.createDataFrame([("1", "a name b"), ("1", "name"), ("2", "NAME")], "id string, name string")
    docs = spark.createDataFrame([(1, "x a name b"), (2, "xName1"), (3, "naMex"), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.begin, r.end, r.ids) for r in G.match_everywhere(docs, gaz, boundary=True).collect())
    assert got == [(1, 2, 10, ["1"]), (1, 4, 8, ["1", "2"]), (2, 1, 5, ["1", "2"])]
    assert sorted(r.doc_id for r in G.match_everywhere(docs, gaz, most_keys=1).collect()) == [1, 1, 2, 3]
    assert sorted({(r.begin, r.end) for r in G.match_tokens(docs, gaz, most_words=3).collect()}) == [(2, 10), (4, 8)]
    exp = spark.createDataFrame([("0", "gene7"), ("1", "gene8"), ("2", "gene9")], "id string, name string")
    d = spark.createDataFrame([(1, " gene7-9 : gene7/9")], "doc_id long, text string")
    own = G.match_tokens(d, exp)
    assert sorted((r.begin, r.end, r.id) for r in G.match_expansions(d, own, exp).collect()) == [(1, 8, "1"), (1, 8, "2"), (11, 18, "2")]
    best = G.best_names(own.where("begin = 1"), exp).first()
    assert best.name == "gene7" and best.confidence == 1.0


def test_similarity_goldens():
    assert S.case_distances(*zip(*(("ab", "ba"), ("aa", "AA"), ("a", "b"), ("a", "A"), ("A", "AAAA"), ("B", "AAAA"), ("α", "a"), ("Α", "a"), ("α", "b")))).tolist() == [4, 2, 2, 1, 6, 8, 1, 1, 2]
    assert S.osa_distances(*zip(*(("ab", "ba"), ("aa", "AA"), ("abc", ""), ("bba", "abb"), ("ca", "abc")))).tolist() == [1, 2, 3, 2, 3]
    assert abs(S.of("jaro", "abxcd", "badc") - (3 / 5 + 3 / 4 + 2 / 3) / 3) < 1e-9 and abs(S.of("jaro", "crate", "trace") - 11 / 15) < 1e-9
    assert S.jaro_winklers(*zip(*(("martha", "marhta"), ("dwayne", "duane"), ("dixon", "dicksonx")))).round(3).tolist() == [0.961, 0.84, 0.813]
    assert S.of("case_similarity", "abxcd", "aBcD") == 0.6 and S.of("case_similarity", "", "") == S.of("jaro", "", "") == S.of("osa_similarity", "", "") == 1


def plain_edits(a, b, cost, unit, swaps):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            own = [unit * max(i, j)] if not i or not j else [d[i - 1, j] + unit, d[i, j - 1] + unit, d[i - 1, j - 1] + cost(a[i - 1], b[j - 1])]
            if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                own.append(d[i - 2, j - 2] + 1)
            d[i, j] = min(own)
    return d[len(a), len(b)]


def plain_jaro(a, b):
    if a == b:
        return 1.0
    w, used, mine = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - w), min(len(b), i + w + 1)) if j not in used and b[j] == x), None)
        if j is not None:
            used.add(j)
            mine.append(x)
    if not mine:
        return 0.0
    t, m = sum(x != b[j] for x, j in zip(mine, sorted(used))) // 2, len(mine)
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abABα", max_size=7), st.text("abABα", max_size=9)), min_size=1, max_size=8))
def test_similarities_side_by_side(pairs):
    a, b = map(list, zip(*pairs))
    near = lambda x, y: 0 if x == y else 1 if x.lower() == y.lower() or {x.lower(), y.lower()} == {"α", "a"} else 2
    assert S.case_distances(a, b).tolist() == [plain_edits(x, y, near, 2, False) for x, y in pairs] == S.case_distances(b, a).tolist()
    assert S.osa_distances(a, b).tolist() == [plain_edits(x, y, lambda p, q: p != q, 1, True) for x, y in pairs]
    assert S.jaros(a, b).tolist() == pytest.approx([plain_jaro(x, y) for x, y in pairs])
    for name, (f, kind) in S.FUNCTIONS.items():
        if kind == "double":
            assert ((0 <= f(a, b)) & (f(a, b) <= 1)).all() and (f(a, a) == 1).all()


def test_similarity_columns(spark):
    df = spark.createDataFrame([("ab", "ba"), (None, "a"), ("a", None), ("x", "x")], "a string, b string")
    assert [r.v for r in df.select(S.column("osa_distance")("a", "b").alias("v")).collect()] == [1, None, None, 0]
