import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from spanloom.operators import filters, joins, rank, segment
from spanloom.sinks import lines
from spanloom.sources import files


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_documents(spark, tmp_path):
    put(tmp_path, "a.html", "<p>x</p>")
    put(tmp_path, "b.txt", "é")
    got = {r.uri.split("/")[-1]: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert got["a.html"].mime == "text/html" and got["b.txt"].raw == "é"
    assert files.documents(spark, [str(tmp_path / "b.txt")], mime="x/y").first().mime == "x/y"
    with pytest.raises(FileNotFoundError):
        files.documents(spark, [str(tmp_path / "none")])


def test_keyed_lines(spark, tmp_path):
    two = put(tmp_path, "two", "a\tx\n\n b\ty \na\tz\na\tx\n")
    assert {r.key: r.value for r in files.string_map(spark, two).collect()} == {"a": "x", "b": "y"}
    assert {r.key: r["values"] for r in files.string_sets(spark, two).collect()} == {"a": ["x", "z"], "b": ["y"]}
    n = put(tmp_path, "n", "a\t1\nb\t2\n")
    assert {r.key: r.n for r in files.counters(spark, n).collect()} == {"a": 1, "b": 2}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.counters(spark, two).collect()
    with pytest.raises(Exception, match="must have 2 fields"):
        files.string_map(spark, put(tmp_path, "bad", "a\tb\tc\n")).collect()
    three = put(tmp_path, "three", "g\ts\t1\ng\tt\t2\n")
    assert files.nested_counters(spark, three).first().counts == {"s": 1, "t": 2}
    assert [r.item for r in files.items(spark, n).collect()] == ["a\t1", "b\t2"]
    assert [tuple(r) for r in files.gazetteer(spark, put(tmp_path, "g", "1\ta\tb\n2\tc\n")).orderBy("id").collect()] == [("1", "a\tb"), ("2", "c")]
    assert files.rows(spark, put(tmp_path, "r", "a\\\tb\tc\n")).first().cols == ["a\\\tb", "c"]


def test_relations(spark, tmp_path):
    p = put(tmp_path, "rel", "d\tt\tn\t1\tt\tn\t2\nd\tt\tn\t1\tt\tn\t1\n")
    r = files.relations(spark, p)
    assert [[tuple(e) for e in x] for x in r.first().relations] == [[("t", "n", "1"), ("t", "n", "2")], [("t", "n", "1")]]
    assert sorted(tuple(x) for x in files.relation_entities(r).collect()) == [("d", "t", "n", "1"), ("d", "t", "n", "2")]
    assert len(files.entities(spark, put(tmp_path, "e", "d\tt\tn\t1\nd\tt\tn\t2\tmore\n")).first().entities) == 2
    with pytest.raises(Exception, match="1 \\+ 3n"):
        files.relations(spark, put(tmp_path, "bad", "d\tt\tn\n")).collect()


def test_jdbc_gazetteer(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([(1, 9606, "abc"), (2, 10090, "ABC")], "id int, taxon int, name string").write.format("jdbc").option("url", url).option("dbtable", "names").save()
    assert sorted(tuple(r) for r in files.jdbc_gazetteer(spark, url, 'SELECT "id", "name" FROM names').collect()) == [("1", "abc"), ("2", "ABC")]
    assert files.jdbc_gazetteer(spark, url, 'SELECT "id", "taxon", "name" FROM names').columns == ["id", "taxon", "name"]


def test_sentence_lines(spark, tmp_path):
    docs = spark.createDataFrame([(1, "  This is\na sentence.  -- This is\nanother one.  ")], "doc_id long, text string")
    own = segment.sentences(docs, "ignore")
    assert [r.line for r in lines.sentence_lines(own, docs).orderBy("line_no").collect()] == ["This is a sentence.", "-- This is another one."]
    assert [r.line for r in lines.sentence_lines(own, docs, newlines=True).collect()][:2] == ["This is", "a sentence."]
    lines.write_lines(lines.sentence_lines(own, docs), f"{tmp_path}/out", ["line_no"])
    assert spark.read.text(f"{tmp_path}/out").count() == 2


def test_other_lines(spark):
    tok = spark.createDataFrame([(1, 0, 3, "The", "DT", None, "NP", True, False), (1, 4, 7, "a_b", "NN", "dog", "NP", False, True)], "doc_id long, begin int, end int, text string, pos string, stem string, chunk string, chunk_begin boolean, chunk_end boolean")
    sent = spark.createDataFrame([(1, 1, 0, 8)], "doc_id long, sent_no int, begin int, end int")
    assert lines.tagged_lines(tok, sent).first().line == "[ NP The_DT_the a␣b_NN_dog ]"
    ann = spark.createDataFrame([(1, 4, 7, "a_b", "u", "ns", "id", 1.0, [("name", 'x"y')])], "doc_id long, begin int, end int, match string, annotator string, namespace string, identifier string, confidence double, properties array<struct<name: string, value: string>>")
    assert lines.annotation_lines(ann, tok, pos=True, annotator=True).first().line == 'The\t\ta_b\t\t\tNN\t4:7\tu@ns:id\t1.00000\tname="x\\"y"'
    assert lines.annotation_lines(ann, namespace=False, identifier=False).first().line == 'a_b\t4:7\t1.00000\tname="x\\"y"'
    assert lines.semantic_lines(ann, "|").first().line == "ns|id|4:7|a_b"
    rel = ann.select("doc_id", F.lit(1).alias("sent_no"), F.array(F.struct(F.lit(0).alias("begin"), F.lit(8).alias("end"))).alias("sources"), F.array(F.struct("begin", "end", "namespace", "identifier")).alias("targets"))
    docs = spark.createDataFrame([(1, "The a_b. More")], "doc_id long, text string")
    assert lines.evidence_lines(rel, docs).first().line == 'The <e ns="ns" id="id">a_b</e>.'
    assert lines.relation_lines(rel, "r", "x").first().line == "r:x#c=1.00000\tns/id#c=1.00000"


def test_mime_by_content_and_encodings(spark, tmp_path):
    (tmp_path / "a").write_bytes("<!DOCTYPE html><p>é".encode("latin-1"))
    (tmp_path / "b").write_bytes(b" <?xml version='1.0'?><r/>")
    (tmp_path / "c").write_bytes(b"%PDF-1.4")
    got = {r.uri.split("/")[-1]: (r.mime, r.raw) for r in files.documents(spark, str(tmp_path), encoding="ISO-8859-1").collect()}
    assert got["a"] == ("text/html", "<!DOCTYPE html><p>é") and got["b"][0] == "application/xml" and got["c"][0] == "application/pdf"


def test_files_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "file:/x/a.html"), (2, "/y/a.xml"), (3, None), (4, "/y/.hidden"), (5, "/z/none")], "doc_id long, uri string")
    own = spark.createDataFrame([(1, 2, "second é"), (1, 1, "first"), (2, 1, "x"), (3, 1, "y"), (9, 1, "of no document")], "doc_id long, line_no int, line string")
    folder = f"{tmp_path}/out"
    got = {r.file: r.n for r in lines.write_files(own, docs, folder, ["line_no"], encoding="latin-1").collect()}
    assert got == {"a.txt": 2, "a.2.txt": 1, "doc-000003.txt": 1, ".hidden.txt": 0, "none.txt": 0}
    assert (tmp_path / "out" / "a.txt").read_bytes() == "first\nsecond é\n".encode("latin-1") and (tmp_path / "out" / "none.txt").read_text() == ""
    with pytest.raises(FileExistsError):
        lines.write_files(own, docs, folder, ["line_no"])
    assert lines.write_files(own.limit(0), docs, folder, ["line_no"], overwrite=True).count() == 5


def test_small_readers_and_writers(spark, tmp_path):
    assert sorted(tuple(r) for r in files.gold(spark, put(tmp_path, "gold", "a\t1\t2\na\t1\nb\t3\n")).collect()) == [("a", "1"), ("a", "2"), ("b", "3")]
    r = spark.createDataFrame([("1:2;30:4",)], "o string").select(files.ranges(F.col("o")).alias("x")).first().x
    assert [tuple(x) for x in r] == [(1, 2), (30, 4)]
    model = put(tmp_path, "model", "## Linear\n## x\n0:0.5 1:2.0 7:-1e-1\n")
    assert rank.model_weights(spark, model) == {"bias": 0.5, "no_ner": 2.0, "confidence": -0.1}
    df = spark.createDataFrame([(1.0, 3.0)], "no_ner double, confidence double")
    assert df.select(rank.linear_score(rank.model_weights(spark, model)).alias("s")).first().s == pytest.approx(2.2)
    with pytest.raises(ValueError):
        rank.model_weights(spark, put(tmp_path, "bad", "# nothing\n"))
    lines.write_filters(spark.createDataFrame([("before", "a\tb")], "field string, value string"), f"{tmp_path}/f")
    assert spark.read.text(f"{tmp_path}/f").first().value == "before\ta b"


def test_counters_without_a_pass_of_their_own(spark):
    seen = Observation()
    df = filters.counted(spark.range(10).withColumn("x", F.when(F.col("id") > 1, F.col("id"))), F.col("x") % 2 == 0, seen)
    assert df.count() == 4 and seen.get == {"total": 10, "removed": 6}


def test_inner_entities_of_relations(spark):
    rel = spark.createDataFrame([(1, 1, [(0, 9)], [(0, 9, "a", "1")])], "doc_id long, sent_no int, sources array<struct<begin: int, end: int>>, targets array<struct<begin: int, end: int, namespace: string, identifier: string>>")
    ann = spark.createDataFrame([(1, 0, 9, "a", "1"), (1, 2, 5, "b", "2"), (1, 5, 12, "b", "3"), (2, 2, 5, "b", "4")], "doc_id long, begin int, end int, namespace string, identifier string")
    (r,) = lines.normalized_targets(rel, ann).collect()
    assert [tuple(t) for t in r.targets] == [(2, 5, "b", "2")]
    one = rel.withColumn("targets", F.transform("targets", lambda t: F.struct(t["begin"], t["end"], t["namespace"], t["identifier"], F.lit(0.25).alias("confidence"), F.array(F.struct(F.lit("n").alias("name"), F.lit('x"y').alias("value"))).alias("properties"))))
    assert lines.relation_lines(one, "r", "x").first().line == 'r:x#c=1.00000\ta/1#c=0.25000&n="x\\"y"'


def test_strict_features(spark):
    own = spark.createDataFrame([(1, 0, 3, "abc", "1", "t", 1.0), (1, 5, 8, "new", "2", "t", 1.0)], "doc_id long, begin int, end int, match string, id string, taxon string, confidence double")
    taxa = spark.createDataFrame([(1, "t", 20, 25), (1, "t", 4, 5)], "doc_id long, taxon string, begin int, end int")
    ner = spark.createDataFrame([(1, 0, 4, "protein")], "doc_id long, begin int, end int, label string")
    links, symbols, refs = (spark.createDataFrame(r, s) for r, s in (([("1", 2)], "id string, n int"), ([("abc", 3)], "name string, n int"), ([("1", "abc", 4)], "id string, name string, n int")))
    loose = {r.id: r for r in rank.features(own, taxa, ner, links, symbols, refs).collect()}
    assert loose["1"].distance == 2 and loose["2"].distance == 1 and loose["2"].symbol == 0 and loose["1"].no_ner == 1
    assert [r.id for r in rank.features(own, taxa, ner, links, symbols, refs, strict=True).collect()] == ["1"]
    assert {r.id: r.label for r in rank.first_within(own, ner).collect()} == {"1": "protein", "2": None}


def test_linear_joins_on_a_long_document(spark):
    """200,000 words in one document: containment and neighbours without products."""
    docs = spark.createDataFrame([(1, "ab cde. " * 100_000)], "doc_id long, text string")
    tok, sent = segment.tokens(docs), segment.sentences(docs)
    assert joins.within(tok, sent.drop("text"), "s_").count() == 200_000
    near = joins.neighbours(tok.where("tok_no % 1000 = 0"), tok).agg(F.count("before"), F.count("after")).first()
    assert tuple(near) == (200, 199)
