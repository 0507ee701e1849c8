"""Sentences and tokens as span tables, by regular expressions whose matches tile the text.

The matches of a tiling pattern, one after another, are the text again; the sum of the lengths before a piece is the
place where it begins. All of that happens within the row: the matches stay in the JVM, their lengths (not their texts) go
through one Arrow batch that sums them up, and nothing is shuffled. Rows don't mix, whatever their doc_id: rows that share
one, or have none, get the offsets of their own texts. Joins of span tables are by doc_id, which should be unique there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

WORDS = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"
_GAP = r"(?:\r?\n[  \t\x0B\f]*){2,}"
SENTENCES = {
    "single": r"([^.!?\n]*[.!?]+|[^.!?\n]+|\n+)",
    "ignore": r"([^.!?]*[.!?]+|[^.!?]+)",
    "successive": rf"({_GAP}|(?:(?!{_GAP})[^.!?])*[.!?]+|(?:(?!{_GAP})[^.!?])+)",
}


def running(lengths: pa.Array) -> pa.Array:
    """Of each list, the sums of the values before each place.

    One array of 32 bits is made, and worked on in place: a batch needs little memory beside what comes and goes. It may
    wrap round on its way, which differences don't see.
    """
    n = np.asarray(pc.fill_null(pc.list_value_length(lengths), 0))
    values = np.asarray(lengths.flatten())
    total = np.cumsum(values, dtype=np.int32)
    total -= values
    ends = np.cumsum(n, dtype=np.int64)
    for lo in range(0, len(n), 64):
        own, last = n[lo : lo + 64], ends[lo : lo + 64]
        b, e = int(last[0] - own[0]), int(last[-1])
        if e > b:
            total[b:e] -= np.repeat(total[np.minimum(last - own, e - 1)], own)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(total), mask=lengths.is_null())


def laid_out(docs: DataFrame, pattern: str, text: str = "text", *more: Column) -> DataFrame:
    """(doc_id, *more, _a, _b) for each row: the texts of all matches, in their order, and where they begin."""
    own = docs.select("doc_id", *more, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)).alias("_a"))
    starts = F.arrow_udf(running, ArrayType(IntegerType()))
    return own.withColumn("_b", starts(F.transform("_a", lambda x: F.length(x))))


def tiled(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, tiles) for each row; tiles holds (text, begin) of every match, in their order."""
    return zipped(laid_out(docs, pattern, text))


def zipped(own: DataFrame) -> DataFrame:
    return own.select("doc_id", *(c for c in own.columns if c not in ("doc_id", "_a", "_b")), F.arrays_zip(F.col("_a").alias("text"), F.col("_b").alias("begin")).alias("tiles"))


def pieces(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, pos, begin, end, text) of every match. Null texts have none."""
    own = tiled(docs, pattern, text).select("doc_id", F.posexplode("tiles").alias("pos", "t"))
    return own.select("doc_id", "pos", F.col("t.begin").alias("begin"), (F.col("t.begin") + F.length("t.text")).cast("int").alias("end"), F.col("t.text").alias("text"))


def words_laid_out(docs: DataFrame, text: str = "text", *more: Column) -> DataFrame:
    """laid_out() of runs of letters and digits and of what is between, with off; these alternate, and words are those at places off, off + 2, ..."""
    return laid_out(docs, WORDS, text, F.when(F.col(text).rlike(r"^[\p{L}\p{N}]"), 0).otherwise(1).alias("off"), *more)


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, tok_no, begin, end, text) of runs of letters and digits."""
    own = zipped(words_laid_out(docs)).select("doc_id", "off", F.posexplode("tiles").alias("pos", "t")).where("(pos + off) % 2 = 0")
    return own.select("doc_id", (F.floor(F.col("pos") / 2) + 1).cast("int").alias("tok_no"), F.col("t.begin").alias("begin"), (F.col("t.begin") + F.length("t.text")).cast("int").alias("end"), F.col("t.text").alias("text"))


def utf16_begins(docs: DataFrame) -> DataFrame:
    """(doc_id, begin, utf16) of tokens(): where they begin, in code points and in UTF-16 code units, which differ in rows with characters of two units. Within the row, like the tokens."""
    own = words_laid_out(docs, "text", F.col("text").rlike(r"[\x{10000}-\x{10FFFF}]").alias("_wide"))
    units = F.transform("_a", lambda x: F.length(x) + F.length(F.regexp_replace(x, r"[^\x{10000}-\x{10FFFF}]", "")))
    own = own.withColumn("_u", F.arrow_udf(running, ArrayType(IntegerType()))(F.when(F.col("_wide"), units)))
    both = F.arrays_zip(F.col("_b").alias("begin"), F.coalesce("_u", "_b").alias("utf16"))
    return own.select("doc_id", "off", F.posexplode(both).alias("pos", "t")).where("(pos + off) % 2 = 0").select("doc_id", "t.begin", "t.utf16")


def _trimmed(tiles: Column) -> Column:
    blank = F.lit(" \t\n\r\f\x0b")

    def trimmed(t: Column) -> Column:
        left = F.ltrim(t["text"], blank)
        return F.struct((t["begin"] + F.length(t["text"]) - F.length(left)).cast("int").alias("begin"), F.rtrim(left, blank).alias("text"))

    return F.filter(F.transform(tiles, trimmed), lambda t: t["text"] != "")


def sentence_words(docs: DataFrame, newlines: str = "successive") -> DataFrame:
    """(doc_id, sent_no, words, before, total): the tokens() of each of sentences(), how many the document has before, and in all.

    No end of a sentence is in a token, and no token outside all sentences: what joins of both by their places give is within the row.
    """
    own = tiled(docs, SENTENCES[newlines]).select("doc_id", F.transform(_trimmed(F.col("tiles")), lambda t: F.regexp_extract_all(t["text"], F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("words"))
    own = own.withColumn("_n", F.transform("words", lambda w: F.size(w))).withColumn("before", F.arrow_udf(running, ArrayType(IntegerType()))("_n"))
    total = F.try_element_at("before", F.lit(-1)) + F.try_element_at("_n", F.lit(-1))
    return own.select("doc_id", total.alias("total"), F.posexplode(F.arrays_zip("words", "before")).alias("pos", "t")).select("doc_id", (F.col("pos") + 1).alias("sent_no"), "t.words", "t.before", "total")


def sentences(docs: DataFrame, newlines: str = "successive") -> DataFrame:
    """(doc_id, sent_no, begin, end, text), without white space at the ends.

    newlines: "single" ends a sentence at every line feed, "successive" at two or more, "ignore" at none.
    """
    own = tiled(docs, SENTENCES[newlines]).select("doc_id", F.posexplode(_trimmed(F.col("tiles"))).alias("pos", "t"))
    return own.select("doc_id", (F.col("pos") + 1).alias("sent_no"), F.col("t.begin").alias("begin"), (F.col("t.begin") + F.length("t.text")).cast("int").alias("end"), F.col("t.text").alias("text"))


def gaps(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, sent_no, gap) of the text between a sentence and the one before, or the document's begin."""
    before = F.coalesce(F.lag("end").over(Window.partitionBy("doc_id").orderBy("sent_no")), F.lit(0))
    own = spans.select("doc_id", "sent_no", before.alias("lo"), F.col("begin").alias("hi"))
    return own.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id").select("doc_id", "sent_no", F.substring("whole", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("gap"))


def chunk_flags(tagged: DataFrame, tag: Column) -> DataFrame:
    """Adds chunk, chunk_begin and chunk_end to tokens (doc_id, tok_no) from B-X, I-X and O tags."""
    w = Window.partitionBy("doc_id").orderBy("tok_no")
    own = tagged.withColumn("_tag", tag)
    after = F.lead("_tag").over(w)
    inside = F.col("_tag") != "O"
    return own.select(*tagged.columns, F.when(inside, F.substring("_tag", 3, 1000)).alias("chunk"), F.col("_tag").startswith("B").alias("chunk_begin"), (inside & (after.isNull() | ~after.startswith("I"))).alias("chunk_end"))


def bio_spans(tagged: DataFrame, tag: Column) -> DataFrame:
    """(doc_id, begin, end, label) of every run of B-X and the I-X after it; a run open at the end is closed there."""
    own = tagged.withColumn("_tag", tag)
    own = own.withColumn("_run", F.sum(F.when(F.col("_tag").startswith("B"), 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("tok_no")))
    own = own.withColumn("_open", F.min(F.when(F.col("_tag") == "O", F.col("tok_no"))).over(Window.partitionBy("doc_id", "_run").orderBy("tok_no").rowsBetween(Window.unboundedPreceding, 0)))
    return own.where("_run > 0 and _open is null").groupBy("doc_id", "_run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min_by(F.substring("_tag", 3, 1000), "tok_no").alias("label")).drop("_run")
