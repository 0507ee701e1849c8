"""Steps that grew faster than their input, or than they had to: results by plain loops, and plans without the step at fault."""

import random

import pyarrow as pa

from spanloom.operators import filters, patterns, segment
from spanloom.operators import tagging as T
from spanloom.plans import pipelines as P
from spanloom.sinks import lines


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_targets_meet_by_slots(spark):
    rng = random.Random(1)
    t = [(1, str(k), b, b + rng.randrange(1, 600)) for k in range(60) for b in (rng.randrange(3000), rng.randrange(3000))]
    inner = [(1, b, b + rng.randrange(0, 40)) for b in rng.sample(range(3000), 40)]
    rel = spark.createDataFrame(t, "doc_id long, rel_id string, begin int, end int").selectExpr("doc_id", "rel_id", "struct(begin, end) as t").groupBy("doc_id", "rel_id").agg({"t": "collect_list"}).toDF("doc_id", "rel_id", "targets")
    got = filters.relations_mapped(rel, spark.createDataFrame(inner, "doc_id long, begin int, end int"))
    holds = lambda b, e: any(b <= x and y <= e and (b, e) != (x, y) for _, x, y in inner)
    assert {r.rel_id for r in got.collect()} == {k for k in {x[1] for x in t} if all(holds(b, e) for _, r, b, e in t if r == k)}
    assert "_slot" in plan(got)


def test_utf16_within_the_row(spark):
    texts = [(1, "a 𐀀b 𐀀 c"), (1, "x yz"), (2, "𐀀"), (3, None), (None, "q r")]
    got = segment.utf16_begins(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted((r.begin, r.utf16) for r in got.collect()) == sorted([(0, 0), (2, 2), (5, 6), (7, 9), (0, 0), (2, 2), (0, 0), (0, 0), (2, 2)])
    assert "Join" not in plan(got)


def test_running_sums_need_little_memory():
    n = 2_000_000
    lists = pa.array([[3] * (n // 1000)] * 1000, pa.list_(pa.int32()))
    import tracemalloc

    tracemalloc.start()
    own = segment.running(lists)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert own[999].as_py() == [3 * i for i in range(n // 1000)] and peak < 3 * 4 * n
    assert segment.running(pa.array([[1, 2], None, [], [5, 6, 7]], pa.list_(pa.int32()))[1:]).to_pylist() == [None, [], [0, 5, 11]]


def test_tagger_by_columns_is_the_one_by_sentence():
    rng = random.Random(2)
    parts = ["the", "dogs", " ", "\n", "-", "'", "running", "of", ".", "é", "𐀀", "9", "_", "\r", "he", "quickly"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(500)]
    for tagger in (T.rule_tagger, T.RuleTagger(lambda w: "B-X" if len(w) > 3 else "O")):
        sizes, want = T._each(lambda t: tagger(t), texts, list(range(500)))
        n, got = tagger.columns(texts, list(range(500)))
        assert n.tolist() == sizes and got.equals(want)


def test_patterns_begin_where_they_can():
    n, flat = T.rule_tagger.columns(["The dog of the old house slept.", "It is a sign of rain", "of"], [0, 0, 0])
    own = patterns.Batch(flat)
    rows = flat.to_pylist()[: n[0]]
    for pattern in ("( [ NP DT_* . + ] ) [ PP IN_* ] ( [ NP . + ] )", "[ NP . * ] IN_* ?", "( [ NP . + ] ) *"):
        at = own.starts(pattern)
        starts = {} if at is None else {pattern: [x for x in at.tolist() if x < n[0]]}
        assert patterns.find_all(pattern, own.tokens(0, int(n[0]), starts)) == patterns.find_all(pattern, rows)
    assert len(own.starts("( [ NP DT_* . + ] ) [ PP IN_* ] ( [ NP . + ] )")) < 4 and own.starts("[ NP . * ]") is None


def test_pipelines_without_shuffles_of_tokens(spark):
    d = spark.createDataFrame([(1, "The dog of a house slept. It rained."), (2, "")], "doc_id long, text string")
    tagged = P.preprocess(d)
    got = P.tag(d)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lines.tagged_lines(T.token_rows(tagged), tagged).collect()))
    assert "Join" not in plan(got) and "Aggregate" not in plan(got)
    fused, apart = (patterns.annotate(x, [("( [ NP DT_* . + ] )", [("r", "x"), ("s", "y")])], t) for x, t in ((P.split(d), T.rule_tagger), (tagged, None)))
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, apart.collect())) != []
    grex = P.regulations(d, [("( [ NP . + ] )", [("rel", "any"), ("sem", "head")])], {"head": spark.createDataFrame([("1", "t", "dog")], "id string, taxon string, name string")})
    assert [(r.doc_id, r.rel_id) for r in grex.collect()] == [(1, "1:0:0")] and plan(grex).count("MapInArrow") == 1


def test_spans_of_entities_from_few_rows(spark):
    words = {"B": "B-X", "I": "I-X"}
    o = P.Options(newlines="single", tagger=T.RuleTagger(lambda w: words.get(w, "O")))
    d = spark.createDataFrame([(1, "B I o o I B.\nI o B\nI I o o o I"), (2, "o\nI B o I")], "doc_id long, text string")
    got = {(r.doc_id, r.begin, r.end) for r in P.entity_spans(d, o).collect()}
    rows = T.token_rows(P.preprocess(d, o)).orderBy("doc_id", "sent_no", "tok_no").collect()
    want, last = set(), None
    for r in rows:
        if r.ner == "B-X":
            want.add(last := (r.doc_id, r.begin, r.end))
        elif r.ner == "I-X" and last and last[0] == r.doc_id:
            want.remove(last)
            want.add(last := (*last[:2], r.end))
        else:
            last = None
    assert got == want
    assert "filter(tokens" in plan(P.entity_spans(d, o))


def test_surroundings_by_one_join(spark):
    from spanloom.operators import joins

    rng = random.Random(3)
    tok, at = [], 0
    for _ in range(300):
        e = at + rng.choice([1, 3, 6, 9, 150])
        tok.append((1, at, e, f"w{at}"))
        at = e + rng.choice([1, 1, 2, 9, 10, 12])
    spans = {(1, b, b + rng.randrange(1, 300)) for b in rng.sample(range(at), 150)} | {(1, b, e) for _, b, e, _ in tok[::7]}
    t = spark.createDataFrame(tok, "doc_id long, begin int, end int, text string")
    s = spark.createDataFrame([*spans, (None, 0, 4)], "doc_id long, begin int, end int")
    got = {(r.doc_id, r.begin, r.end): (r.before, r.prefix, r.suffix, r.after) for r in joins.surroundings(s, t).collect()}
    near = {(r.doc_id, r.begin, r.end): (r.before, r.after) for r in joins.neighbours(s, t).collect()}
    assert len(got) == len(near) == len(spans) + 1 and near[None, 0, 4] == (None, None)
    for _, b, e in spans:
        before = max(((y, x, w) for _, x, y, w in tok if y <= b and b - y < 10), default=None)
        after = min(((x, y, w) for _, x, y, w in tok if x >= e and x - e < 10), default=None)
        own = sorted((x, y, w) for _, x, y, w in tok if (x <= b and y >= e) or (b <= x and y <= e))
        first, last = (own[0], own[-1]) if own else (None, None)
        if len(own) == 1:
            p = s_ = first if first[0] <= b and first[1] >= e else None
        else:
            p, s_ = (first if own and first[0] <= b else None), (last if own and last[1] >= e else None)
        prefix, suffix = p and p[2][: b - p[0]], s_ and s_[2][len(s_[2]) - (s_[1] - e) :] if s_ and s_[1] - e <= len(s_[2]) else s_ and s_[2]
        assert near[1, b, e] == (before and before[2], after and after[2])
        assert (got[1, b, e][0], got[1, b, e][3]) == near[1, b, e] and (got[1, b, e][1] is None, got[1, b, e][2] is None) == (prefix is None, suffix is None)
    assert plan(joins.surroundings(s, t)).count("Join") == 1


def test_sentence_words_are_tokens_within(spark):
    from pyspark.sql import functions as F

    from spanloom.plans import catalogue

    d = spark.createDataFrame([(1, "A b, c.\nD e! f 9g h\n\n ... i."), (2, None), (3, ""), (4, "...")], "doc_id long, text string")
    tok = segment.chunk_flags(segment.tokens(d), F.expr(catalogue.TAG)).withColumns({"pos": F.lit("X"), "stem": F.lit(None).cast("string")})
    want = sorted(map(tuple, lines.tagged_lines(tok, segment.sentences(d, "single")).collect()))
    got = lines.lines_of_words(segment.sentence_words(d, "single"), catalogue._tag, "X")
    assert sorted(map(tuple, got.collect())) == want and len(want) == 4
    assert "Join" not in plan(got) and "Window" not in plan(got)


def test_matches_are_computed_once(spark):
    from spanloom.operators import gazetteer

    d = spark.createDataFrame([(1, "the Dog and dog-house")], "doc_id long, text string")
    g = spark.createDataFrame([("1", "t", "dog")], "id string, taxon string, name string")
    assert not gazetteer.with_gaps(g) and gazetteer.with_gaps(spark.createDataFrame([("1", "t", "dog house")], g.schema))
    own = P.normalize(d, g)
    assert sorted((r.begin, r.match, r.name) for r in own.collect()) == [(4, "Dog", "dog"), (12, "dog", "dog")]
    assert "regexp_extract_all" not in plan(own)
