"""python -m spanloom PIPELINE INPUT... --out FOLDER [options]: runs a pipeline over files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import pipelines as P
from .sinks import lines
from .sources import files


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = argparse.ArgumentParser(prog="spanloom", description=__doc__)
    a.add_argument("pipeline", choices=["extract", "split", "pre", "tag", "grep", "match", "bioner", "norm", "ginx", "entities"])
    a.add_argument("inputs", nargs="*", help="a folder, or files; the working folder if there is none")
    a.add_argument("--out", required=True)
    a.add_argument("--mode", default="errorifexists", choices=["errorifexists", "overwrite", "append"])
    a.add_argument("--mime")
    a.add_argument("--recursive", action="store_true")
    a.add_argument("--newlines", default="successive", choices=["single", "successive", "ignore"])
    a.add_argument("--greek-to-latin", action="store_true")
    a.add_argument("--patterns", help="grep: lines of a pattern and namespace, identifier pairs")
    a.add_argument("--sentences", help="regular expressions of the sentences to keep, a line each")
    a.add_argument("--remove-sentences", action="store_true")
    a.add_argument("--dictionary", action="append", default=[], help="lines of id and name, or id, taxon and name; ginx takes two")
    a.add_argument("--entity-map", help="entities: lines of document name, type, namespace and id")
    a.add_argument("--names", help="entities: lines of namespace, id and name")
    a.add_argument("--lines", action="store_true", help="lines of text instead of a Parquet table")
    o = a.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    paths = o.inputs[0] if len(o.inputs) == 1 and not o.inputs[0].endswith((".html", ".xml", ".txt", ".nxml")) else o.inputs or None
    opts = P.Options(newlines=o.newlines, greek_to_latin=o.greek_to_latin, remove_sentences=o.remove_sentences, sentence_patterns=[r.item for r in files.items(spark, o.sentences).collect()] if o.sentences else [])
    raw = files.documents(spark, paths, o.mime, o.recursive)
    docs = P.text_of(raw, opts)
    columns = lambda path, names: files.rows(spark, path).selectExpr(*(f"cols[{i}] as {n}" for i, n in enumerate(names)))

    def dictionary(path: str):
        own = files.rows(spark, path)
        wide = own.selectExpr("max(size(cols)) as n").first().n == 3
        return own.selectExpr("cols[0] as id", "cols[1] as taxon", "cols[2] as name") if wide else own.selectExpr("cols[0] as id", "cast(null as string) as taxon", "cols[1] as name")

    key = ["begin", "end"]
    if o.pipeline == "extract":
        out, key = docs.selectExpr("doc_id", "text as line") if o.lines else docs, []
    elif o.pipeline == "split":
        own = P.split(docs, opts)
        out, key = (lines.sentence_lines(own, docs), ["line_no"]) if o.lines else (own, key)
    elif o.pipeline == "pre":
        out = P.preprocess(docs, opts)
    elif o.pipeline == "tag":
        out, key = P.tag(docs, opts), ["line_no"]
    elif o.pipeline == "grep":
        resource = [(r.cols[0], list(zip(r.cols[1::2], r.cols[2::2]))) for r in files.rows(spark, o.patterns).orderBy("line_no").collect()]
        out = P.grep(docs, resource, opts)
        out = lines.semantic_lines(out) if o.lines else out
    elif o.pipeline == "match":
        out = P.match_taxa(docs, dictionary(o.dictionary[0]).selectExpr("id", "name", "cast(null as double) as prob"))
    elif o.pipeline == "bioner":
        out = P.entity_spans(docs, opts)
    elif o.pipeline == "norm":
        out = P.normalize(docs, dictionary(o.dictionary[0]), opts)
        out = lines.annotation_lines(out.selectExpr("*", "taxon as namespace", "id as identifier")) if o.lines else out
    elif o.pipeline == "ginx":
        out, key = P.interactions(docs, dictionary(o.dictionary[0]), dictionary(o.dictionary[1]), opts), ["sent_no"]
        out = lines.relation_lines(out, "rel", "interaction") if o.lines else out
    else:
        of = raw.selectExpr("doc_id", "regexp_extract(uri, '([^/]+?)(\\\\.[^./]*)?$', 1) as doc_key")
        wanted = columns(o.entity_map, ["doc_key", "type", "namespace", "id"]).join(of, "doc_key").drop("doc_key")
        out = P.known(docs, wanted, columns(o.names, ["namespace", "id", "name"]))
    (lines.write_lines(out, o.out, key, o.mode) if o.lines and "line" in out.columns else lines.write_table(out, o.out, o.mode))


if __name__ == "__main__":
    main()
