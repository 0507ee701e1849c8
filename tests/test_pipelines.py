
from spanloom.__main__ import main
from spanloom.plans import pipelines as P
from spanloom.streaming import files as stream


def docs(spark):
    return spark.createDataFrame([(1, "The alpha gene binds beta2 quickly. A mouse was seen.\n\nAnother beta2 here."), (2, "No names at all."), (3, None)], "doc_id long, text string")


def genes(spark):
    return spark.createDataFrame([("1", "9606", "alpha"), ("2", "10090", "beta2")], "id string, taxon string, name string")


def test_split_tag_and_grep(spark):
    d = docs(spark)
    assert P.split(d).count() == 4 and P.split(d, P.Options(sentence_patterns=["mouse"])).count() == 1
    assert "[ NP The_DT_the alpha_NN_alpha" in P.tag(d).where("doc_id = 1 and line_no = 1").first().line
    resource = [("[ NP . * ( NN_alpha ) . * ]", [("rel", "r"), ("sem", "gene")])]
    got = P.grep(d, resource).where("part = 0").collect()
    assert [(r.doc_id, r.match) for r in got] == [(1, "alpha")] and P.grep_sentences(d, resource).count() == 1


def test_names_and_relations(spark):
    d, g = docs(spark), genes(spark)
    own = P.normalize(d, g, P.Options(weights={"n_id": 1.0}))
    assert sorted((r.begin, r.id, r.name) for r in own.collect()) == [(4, "1", "alpha"), (21, "2", "beta2"), (63, "2", "beta2")]
    taxa = spark.createDataFrame([(1, "10090", 38, 43)], "doc_id long, taxon string, begin int, end int")
    assert {r.id for r in P.normalize(d, g, taxa=taxa).collect()} == {"2"}
    rel = P.interactions(d, g.where("id = '1'"), g.where("id = '2'")).collect()
    assert [(r.doc_id, r.sent_no, [t.identifier for t in r.targets]) for r in rel] == [(1, 1, ["1", "2"])]
    species = spark.createDataFrame([("10090", "mouse", 0.9)], "id string, name string, prob double")
    assert [(r.taxon, r.confidence) for r in P.match_taxa(d, species).collect()] == [("10090", 0.9)]
    resource = [("( [ NP . + ] ) binds", [("rel", "r"), ("sem", "subject")])]
    assert P.regulations(d, resource, {"subject": g}).count() <= 1
    wanted = spark.createDataFrame([(1, "gene", "n", "1"), (1, "gene", "n", "2")], "doc_id long, type string, namespace string, id string")
    names = spark.createDataFrame([("n", "1", "alpha"), ("n", "2", "beta2")], "namespace string, id string, name string")
    known = spark.createDataFrame([(1, ["1", "2"])], "doc_id long, rel array<string>")
    assert "[[1]] gene binds [[2]]" in {r.pattern for r in P.relation_texts(d, wanted, names, known).collect()}


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<p>One alpha here.</p><p>Two.</p>")
    (tmp_path / "d").write_text("1\talpha\n")
    main(["split", f"{tmp_path}/in", "--out", f"{tmp_path}/s", "--lines"], spark)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/s").collect()) == ["One alpha here.", "Two."]
    main(["norm", f"{tmp_path}/in", "--out", f"{tmp_path}/n", "--dictionary", f"{tmp_path}/d"], spark)
    assert spark.read.parquet(f"{tmp_path}/n").first().match == "alpha"
    (tmp_path / "e").write_text("a\tgene\tn\t1\n")
    (tmp_path / "m").write_text("n\t1\talpha\n")
    main(["entities", f"{tmp_path}/in", "--out", f"{tmp_path}/k", "--entity-map", f"{tmp_path}/e", "--names", f"{tmp_path}/m"], spark)
    assert spark.read.parquet(f"{tmp_path}/k").count() == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a.html", None, "<p>One alpha</p>")], stream.RAW).write.parquet(f"{tmp_path}/in")
    gaz = genes(spark).select("id", "name")
    stream.start(stream.mentions(stream.raw_documents(spark, f"{tmp_path}/in"), gaz), f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    assert [r.match for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["alpha"]


def test_names_of_many_words(spark):
    text = "Tumor necrosis factor alpha and the IL-2 receptor of Escherichia coli str. K-12 substr. MG1655, not tumor necrosis."
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    g = spark.createDataFrame([("1", "9606", "tumor necrosis factor alpha"), ("2", "9606", "IL-2 receptor"), ("3", "9606", None)], "id string, taxon string, name string")
    assert sorted((r.begin, r.end, r.id) for r in P.normalize(d, g).collect()) == [(0, 27, "1"), (36, 49, "2")]
    species = spark.createDataFrame([("511145", "Escherichia coli str. K-12 substr. MG1655", 0.9)], "id string, name string, prob double")
    assert [(r.begin, r.taxon) for r in P.match_taxa(d, species).collect()] == [(53, "511145")]
    assert P.normalize(d, g.where("name is null")).collect() == []
