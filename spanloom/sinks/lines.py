"""Lines of text from annotations, and their writing to tables, or to one file for each document."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.joins import surroundings, within
from ..operators.segment import gaps


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\t", *(F.coalesce(p, F.lit("")) for p in parts))


def sentence_lines(sentences: DataFrame, docs: DataFrame, other: bool = False, newlines: bool = False) -> DataFrame:
    """(doc_id, line_no, line): sentences, their line feeds joined or, with newlines, as they are; with other, what is between them too."""
    own = sentences.select("doc_id", (F.col("sent_no") * 2).alias("line_no"), (F.col("text") if newlines else T.join_newlines(F.col("text"))).alias("line"))
    if other:
        rest = gaps(sentences, docs).select("doc_id", (F.col("sent_no") * 2 - 1).alias("line_no"), T.normalize_spaces(F.regexp_replace("gap", "[\r\n]", " ")).alias("line")).where("line <> ''")
        own = own.union(rest)
    return own.withColumn("line", F.explode(F.split("line", "\r?\n"))) if newlines else own


def _word(t: Callable[[str], Column]) -> Column:
    word = F.concat_ws("_", *(T.escape_underscores(c) for c in (t("text"), F.coalesce(t("pos"), F.lit("")), F.coalesce(t("stem"), F.lower(t("text"))))))
    return F.concat(F.when(t("chunk_begin"), F.concat(F.lit("[ "), t("chunk"), F.lit(" "))).otherwise(""), word, F.when(t("chunk_end"), " ]").otherwise(""))


def tagged_lines(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): "[ NP The_DT_the dog_NN_dog ] runs_VBZ_run" for each sentence. A null stem is the small form."""
    both = within(tokens, sentences.select("doc_id", "sent_no", "begin", "end"), "s_")
    return both.groupBy("doc_id", F.col("s_sent_no").alias("line_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", _word(F.col).alias("w")))), lambda x: x["w"]), " ").alias("line"))


def lines_of_tagged(tagged: DataFrame) -> DataFrame:
    """tagged_lines() of sentences with their own tokens (doc_id, sent_no, tokens): within the row, nothing is shuffled."""
    own = tagged.where("doc_id is not null and size(tokens) > 0")
    return own.select("doc_id", F.col("sent_no").alias("line_no"), F.array_join(F.transform("tokens", lambda t: _word(lambda c: t[c])), " ").alias("line"))


def lines_of_words(sentences: DataFrame, tag: Callable[[Column], Column], pos: str) -> DataFrame:
    """tagged_lines() of sentence_words(), with B-X, I-X and O tags by the number of a token in its document, and one pos: within the row."""

    def word(w: Column, i: Column) -> Column:
        k = F.col("before") + i + 1
        own, after = tag(k), F.when(k < F.col("total"), tag(k + 1))
        inside = own != "O"
        cols = {"text": w, "pos": F.lit(pos), "stem": F.lit(None).cast("string"), "chunk": F.when(inside, F.substring(own, 3, 1000)), "chunk_begin": own.startswith("B"), "chunk_end": inside & (after.isNull() | ~after.startswith("I"))}
        return _word(cols.__getitem__)

    own = sentences.where("doc_id is not null and size(words) > 0")
    return own.select("doc_id", F.col("sent_no").alias("line_no"), F.array_join(F.transform("words", word), " ").alias("line"))


def property_fields(properties: Column) -> Column:
    return F.array_join(F.transform(properties, lambda p: T.quoted_property(p["name"], p["value"])), "\t")


def annotation_lines(annotations: DataFrame, tokens: DataFrame | None = None, pos: bool = False, annotator: bool = False, namespace: bool = True, identifier: bool = True) -> DataFrame:
    """(doc_id, begin, end, line): surroundings if tokens are given, text, pos, offset, annotator@namespace:identifier, confidence, properties."""
    own, parts = annotations, [T.flat(F.col("match"))]
    if tokens is not None:
        own = own.join(surroundings(own, tokens), ["doc_id", "begin", "end"], "left")
        parts = [F.col("before"), F.col("prefix"), *parts, F.col("suffix"), F.col("after")]
        if pos:
            parts.append(F.coalesce("pos", F.lit("NULL")))
    parts.append(T.offset_string(F.col("begin"), F.col("end")))
    tag = F.concat(*[x for on, x in ((annotator, F.coalesce("annotator", F.lit(""))), (annotator and (namespace or identifier), F.lit("@")), (namespace, F.coalesce("namespace", F.lit(""))), (namespace and identifier, F.lit(":")), (identifier, F.coalesce("identifier", F.lit("")))) if on] or [F.lit(None).cast("string")])
    parts += [tag] if annotator or namespace or identifier else []
    parts += [F.format_number("confidence", 5)]
    line = _joined(*parts)
    some = F.size("properties") > 0
    return own.select("doc_id", "begin", "end", F.when(some, F.concat_ws("\t", line, property_fields(F.col("properties")))).otherwise(line).alias("line"))


def semantic_lines(annotations: DataFrame, separator: str = "\t") -> DataFrame:
    return annotations.select("doc_id", "begin", "end", F.concat_ws(separator, "namespace", "identifier", T.offset_string(F.col("begin"), F.col("end")), T.flat(F.col("match"))).alias("line"))


def relation_lines(relations: DataFrame, namespace: str, identifier: str, separator: str = "\t") -> DataFrame:
    """"ns:id#c=1.00000" and "ns/id#c=1.00000&name="value"" of each target of (doc_id, sent_no, targets).

    A confidence of the relation, confidences and properties of targets are shown if there are such columns and fields; a
    confidence that isn't there is 1.
    """
    fields = relations.schema["targets"].dataType.elementType.fieldNames()
    conf = lambda c: F.concat(F.lit("#c="), F.format_number(c, 5))
    own = conf(F.coalesce("confidence", F.lit(1.0)) if "confidence" in relations.columns else F.lit(1.0))

    def part(t: Column) -> Column:
        line = F.concat(F.coalesce(t["namespace"], F.lit("")), F.lit("/"), F.coalesce(t["identifier"], F.lit("")), conf(F.coalesce(t["confidence"], F.lit(1.0)) if "confidence" in fields else F.lit(1.0)))
        more = F.array_join(F.transform(t["properties"], lambda p: F.concat(F.lit("&"), T.quoted_property(p["name"], T.flat(p["value"])))), "") if "properties" in fields else F.lit("")
        return F.concat(line, F.coalesce(more, F.lit("")))

    return relations.select("doc_id", "sent_no", F.concat_ws(separator, F.concat(F.lit(f"{namespace}:{identifier}"), own), F.array_join(F.transform("targets", part), separator)).alias("line"))


def normalized_targets(relations: DataFrame, annotations: DataFrame) -> DataFrame:
    """The relations (doc_id, sent_no, sources, targets) with the annotations of other namespaces within a target in its place."""
    t = relations.select("doc_id", "sent_no", F.explode("targets").alias("t")).select("doc_id", "sent_no", "t.begin", "t.end", F.col("t.namespace").alias("_ns")).distinct()
    own = annotations.select("doc_id", "begin", "end", "namespace", "identifier").distinct()
    inner = within(own, t, "_t_").where(~F.col("namespace").eqNullSafe(F.col("_t__ns")))
    per = inner.groupBy("doc_id", F.col("_t_sent_no").alias("sent_no")).agg(F.array_sort(F.collect_set(F.struct("begin", "end", "namespace", "identifier"))).alias("targets"))
    return relations.drop("targets").join(per, ["doc_id", "sent_no"])


def evidence_lines(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, sent_no, line): the relation's sentence with its targets as inline tags, where they don't overlap."""
    own = relations.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id")
    s = F.col("sources")[0]
    first = F.struct(s["begin"].alias("at"), F.lit("").alias("out"))
    tag = lambda t: F.concat(F.lit("<e ns=\""), t["namespace"], F.lit('" id="'), t["identifier"], F.lit('">'))
    step = lambda acc, t: F.when(t["begin"] < acc["at"], acc).otherwise(F.struct(t["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("whole"), acc["at"] + 1, t["begin"] - acc["at"]), tag(t), F.substring(F.col("whole"), t["begin"] + 1, t["end"] - t["begin"]), F.lit("</e>")).alias("out")))
    folded = F.aggregate(F.array_sort("targets"), first, step)
    own = own.withColumn("_f", folded)
    return own.select("doc_id", "sent_no", F.concat(F.col("_f.out"), F.substring("whole", F.col("_f.at") + 1, s["end"] - F.col("_f.at"))).alias("line"))


def write_lines(lines: DataFrame, path: str, order: list[str], mode: str = "errorifexists", extension: str = "txt") -> None:
    """All lines, those of a document together and in order, in as many files as there are tasks; documents spread by a hash of doc_id. UTF-8."""
    lines.repartition("doc_id").sortWithinPartitions("doc_id", *order).select(F.col("line").alias("value")).write.mode(mode).option("fileExtension", extension).text(path)


def file_names(docs: DataFrame, extension: str) -> DataFrame:
    """(doc_id, file): the last part of the document's uri without its ending, or doc-000001 by doc_id; of equal names, all but the first by doc_id get .2, .3 and so on."""
    base = T.base_name(F.col("uri"), False) if "uri" in docs.columns else F.lit(None).cast("string")
    own = docs.select("doc_id", F.coalesce(F.when(base != "", base), F.format_string("doc-%06d", F.col("doc_id"))).alias("_name"))
    n = F.row_number().over(Window.partitionBy("_name").orderBy("doc_id"))
    return own.withColumn("_n", n).select("doc_id", F.concat("_name", F.when(F.col("_n") > 1, F.concat(F.lit("."), F.col("_n"))).otherwise(""), F.lit("." + extension)).alias("file"))


def write_files(lines: DataFrame, docs: DataFrame, folder: str, order: list[str], extension: str = "txt", encoding: str = "utf-8", overwrite: bool = False) -> DataFrame:
    """One file of lines for each of docs (doc_id, uri), an empty one for a document without any; returns (file, n) of what was written.

    For output that people read: a file a document isn't for large corpora, which write_lines() and write_table() are.
    Tasks write files of their own under other names first, so that a task that runs again does no harm. The folder is
    one that all executors share. Without overwrite it must be empty or absent.
    """
    system, path = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)
    if not overwrite and system.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)):
        raise FileExistsError(folder)
    system.create_dir(path, recursive=True)
    per = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]).alias("lines"))
    own = file_names(docs, extension).join(per, "doc_id", "left").select("file", "lines")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, where = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)
        for batch in batches:
            counts = []
            for file, own in zip(*(c.to_pylist() for c in batch.columns)):
                part = f"{where}/_{uuid.uuid4().hex}"
                with out.open_output_stream(part) as f:
                    f.write("".join(f"{x}\n" for x in own or ()).encode(encoding, "replace"))
                out.move(part, f"{where}/{file}")
                counts.append(len(own or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["file", "n"])

    written = own.mapInArrow(write, "file string, n long").toArrow()
    return lines.sparkSession.createDataFrame(written)


def write_filters(filters: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines of field and value, tab-separated."""
    filters.select(F.concat_ws("\t", "field", T.flat(F.col("value"))).alias("value")).write.mode(mode).text(path)


def write_table(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All annotations as Parquet: the exchange format of the engine."""
    lines.write.mode(mode).parquet(path)


def write_libsvm(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.select(F.col("line").alias("value")).write.mode(mode).text(path)


__all__ = ["annotation_lines", "evidence_lines", "file_names", "lines_of_tagged", "lines_of_words", "normalized_targets", "relation_lines", "semantic_lines", "sentence_lines", "tagged_lines", "write_files", "write_filters", "write_libsvm", "write_lines", "write_table"]
