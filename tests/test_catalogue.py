"""Queries against their SQL on the smallest tables; operators against plain Python."""

import os

import duckdb
import pytest

from spanloom.functions import offsets, text
from spanloom.operators import filters, joins, learn, segment
from spanloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("nation", "region", "supplier", "part", "lineitem", "documents", "pages", "benchmark", "labels", "conversations")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", ["seg_sentences_single", "seg_gap_text", "win_bio_spans", "join_asof_before_after", "flt_property_select", "flt_token_context", "flt_relationship", "rel_cooccurrence", "rel_known_subset", "rank_topk", "learn_filter_tokens", "agg_run_collapse", "gaz_taxon_semi", "snk_annotation_line", "sql_name_union"])
def test_query_is_its_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = c.execute(catalogue.ORACLES[name])
    names = [x[0] for x in cur.description]
    want = sorted(repr(r) for r in cur.fetchall())
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want and want


def test_segmentation_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "A b.\n\nC d! e"), (4, "...")], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in segment.sentences(d, "successive").orderBy("doc_id", "sent_no").collect()] == [(3, "A b."), (3, "C d!"), (3, "e"), (4, "...")]
    assert [(r.begin, r.end, r.text) for r in segment.tokens(d).orderBy("begin").collect()] == [(0, 1, "A"), (2, 3, "b"), (6, 7, "C"), (8, 9, "d"), (11, 12, "e")]
    one = spark.createDataFrame([(1, "This\tis\n\none sentence\nwritten\nover\tseveral\n\n\nlines.")], "doc_id long, text string")
    assert [segment.sentences(one, m).count() for m in ("ignore", "successive", "single")] == [1, 3, 5]


def test_surroundings(spark):
    t = spark.createDataFrame([(1, 0, 3, "the"), (1, 4, 12, "pre-gene"), (1, 13, 16, "now"), (1, 40, 43, "far")], "doc_id long, begin int, end int, text string")
    s = spark.createDataFrame([(1, 8, 12), (1, 13, 16), (1, 4, 16)], "doc_id long, begin int, end int")
    got = {(r.begin, r.end): (r.before, r.prefix, r.suffix, r.after) for r in joins.surroundings(s, t).collect()}
    assert got[8, 12] == ("the", "pre-", "", "now") and got[13, 16] == ("pre-gene", "", "", None) and got[4, 16] == ("the", "", "", None)
    kept = filters.by_context(s, joins.surroundings(s, t), sets={"before": ["the"]}).collect()
    assert [(r.begin, r.end) for r in kept] == [(13, 16)]
    assert {(r.begin, r.end) for r in filters.by_context(s, joins.surroundings(s, t), sets={"before": ["the"]}, whitelist=True).collect()} == {(8, 12), (4, 16)}


def test_learning(spark):
    rows = [(True, "a", "x", "g"), (False, "b", "x", "g"), (False, "b", "x", "h"), (True, "a", "y", "h")]
    j = spark.createDataFrame(rows, "hit boolean, before string, after string, token string").selectExpr("*", "'' as prefix", "'' as suffix")
    learnt = {(r.field, r.value) for r in learn.learn_filters(j).collect()}
    assert ("before", "b") in learnt and ("token", "h") not in learnt and ("before", "a") not in learnt
    left = learn.apply_filters(j, spark.createDataFrame(sorted(learnt), "field string, value string"))
    assert all(r.hit for r in left.collect())
    f = spark.createDataFrame([("d", "1"), ("d", "2")], "article string, item string")
    g = spark.createDataFrame([("d", "1"), ("e", "1")], "article string, item string")
    assert tuple(learn.precision_recall(f, g).first()) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert learn.recall(g, f, ["article", "item"]).first().recall == 50.0


def test_strings(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a  b\n c d\n\ne", "TGF-β and ß", "𐀀ab", "http://x/y/z.tar.gz", 'n "q')], "a string, b string, c string, d string, e string")
    r = df.select(
        text.join_newlines(F.col("a")), text.greek_to_latin(F.col("b")), offsets.to_utf16_offset(F.col("c"), F.lit(2)), text.base_name(F.col("d")), text.base_name(F.col("d"), False), text.quoted_property(F.col("e"), F.lit("v")),
        text.clean_pattern(F.lit("a - - - b, , c .")), text.latin_to_greek(F.lit("IL-1beta Gamma")),
    ).first()
    assert tuple(r) == ("a  b c d\n\ne", "TGF-beta and beta", 3, "z.tar.gz", "z.tar", '"n \\"q"="v"', "a - b, c", "IL-1β Γ")
