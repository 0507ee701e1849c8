"""Relations between mentions of a sentence: co-occurrence, known ones, combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import within


def _mention():
    return F.struct("begin", "end", F.col("namespace"), F.col("identifier"))


def cooccurrence(sentences: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, sent_no, sources, targets): a relation for each sentence with a mention of both kinds; its targets are those of both, in the order of the text."""
    s = sentences.select("doc_id", "sent_no", "begin", "end")
    both = sources.withColumn("_k", F.lit(0)).unionByName(targets.withColumn("_k", F.lit(1)))
    own = within(both, s, "s_").groupBy("doc_id", F.col("s_sent_no").alias("sent_no"), F.col("s_begin").alias("s_begin"), F.col("s_end").alias("s_end")).agg(F.sort_array(F.collect_list(F.struct("_k", "begin", "end", "namespace", "identifier"))).alias("m"), F.count_if(F.col("_k") == 0).alias("n0"), F.count_if(F.col("_k") == 1).alias("n1"))
    return own.where("n0 > 0 and n1 > 0").select("doc_id", "sent_no", F.array(F.struct(F.col("s_begin").alias("begin"), F.col("s_end").alias("end"))).alias("sources"), F.transform("m", lambda x: F.struct(x["begin"], x["end"], x["namespace"], x["identifier"])).alias("targets"))


def known(sentences: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc_id, sent_no, rel): relations (doc_id, rel array<string>) whose entities are all in the sentence. If one is exactly the sentence's set, that one alone.

    Per sentence the set of identifiers; relations meet it by doc_id, so a pair is made for each sentence and relation of a document, no more.
    """
    own = within(mentions, sentences.select("doc_id", "sent_no", "begin", "end"), "s_").groupBy("doc_id", F.col("s_sent_no").alias("sent_no")).agg(F.collect_set("identifier").alias("have"))
    pairs = own.join(relations.withColumn("rel", F.array_sort(F.array_distinct("rel"))).distinct(), "doc_id").where(F.size(F.array_except("rel", "have")) == 0)
    exact = F.size("rel") == F.size("have")
    some = pairs.groupBy("doc_id", "sent_no").agg(F.max(exact).alias("_any"))
    return pairs.join(some, ["doc_id", "sent_no"]).where(exact | ~F.col("_any")).select("doc_id", "sent_no", "rel")


def combinations(mentions: DataFrame, by: list[str], wanted: list[str]) -> DataFrame:
    """(*by, combo): one mention of each wanted identifier per group, none partly over another, in the order of the text."""
    out = None
    for name in wanted:
        one = mentions.where(F.col("identifier") == name).select(*by, F.struct("begin", "end", "identifier").alias("_m")).distinct()
        out = one.withColumn("combo", F.array("_m")).drop("_m") if out is None else out.join(one, by).withColumn("combo", F.array_append("combo", F.col("_m"))).drop("_m")
    out = out.withColumn("combo", F.array_sort("combo"))
    clash = F.exists(F.sequence(F.lit(1), F.greatest(F.size("combo") - 1, F.lit(1))), lambda i: F.coalesce(F.get("combo", i)["begin"] < F.get("combo", i - 1)["end"], F.lit(False)))
    return out.where(~clash)
