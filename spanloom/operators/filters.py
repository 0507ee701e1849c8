"""Filters of annotations: by constraint, sentence text, properties, token context, relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.offsets import strictly_contains
from .joins import slot, within


def constraint(annotator: str | None = None, namespace: str | None = None, identifier: str | None = None) -> Column:
    """All of those given must be equal."""
    given = [(n, v) for n, v in (("annotator", annotator), ("namespace", namespace), ("identifier", identifier)) if v is not None]
    return reduce(lambda a, b: a & b, (F.col(n) == v for n, v in given), F.lit(True))


def sentences_matching(sentences: DataFrame, patterns: list[str], remove: bool = False, annotator: str | None = None) -> DataFrame:
    """Sentences in which a pattern is found, or the others; those of other annotators stay."""
    hit = reduce(lambda a, b: a | b, (F.col("text").rlike(p) for p in patterns), F.lit(False))
    keep = ~hit if remove else hit
    return sentences.where(keep if annotator is None else keep | ~F.coalesce(F.col("annotator") == annotator, F.lit(False)))


def property_value(name: str) -> Column:
    """The value of the last property of that name."""
    return F.try_element_at(F.filter("properties", lambda p: p["name"] == name), F.lit(-1))["value"]


def by_property(targets: DataFrame, sources: DataFrame, name: str, blacklist: bool = False) -> DataFrame:
    """Targets whose property has the identifier of a source in the document, or, as a blacklist, hasn't. Without any source in a document nothing goes."""
    ids = sources.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set("identifier").alias("_ids"))
    hit = F.coalesce(F.array_contains("_ids", property_value(name)), F.lit(False))
    return targets.join(ids, targets.doc_id == F.col("_d"), "left").where(F.col("_ids").isNull() | (~hit if blacklist else hit)).drop("_d", "_ids")


def by_context(mentions: DataFrame, surroundings: DataFrame, pos_tags: list[str] | None = None, sets: dict[str, list[str]] | None = None, whitelist: bool = False) -> DataFrame:
    """Mentions whose surroundings pass.

    The first token's pos must be in pos_tags (no token: it passes). As a blacklist, before, prefix, suffix and after must
    not be in their sets; as a whitelist they must be. Absent sets pass.
    """
    keep = F.lit(True)
    if pos_tags is not None:
        keep &= F.coalesce(F.col("pos").isin(pos_tags), F.lit(True))
    for name, values in (sets or {}).items():
        hit = F.coalesce(F.col(name).isin(values), F.lit(False))
        keep &= hit if whitelist else ~hit
    return mentions.join(surroundings.where(keep).select("doc_id", "begin", "end"), ["doc_id", "begin", "end"], "left_semi")


def same_verdict(mentions: DataFrame, verdict: Column, order: Column) -> DataFrame:
    """Mentions by the verdict on the first at their span."""
    w = Window.partitionBy("doc_id", "begin", "end").orderBy(order)
    return mentions.withColumn("_keep", F.first(verdict).over(w)).where("_keep").drop("_keep")


def holding(rows: DataFrame, inner: DataFrame, name: str) -> DataFrame:
    """Distinct rows of spans (doc_id, begin, end, ...) with a boolean name: whether they strictly contain a span of inner. They meet by document and slot, and rows is read once."""
    i = inner.select(F.col("doc_id").alias("_d"), F.col("begin").alias("_ib"), F.col("end").alias("_ie")).distinct()
    own = rows.withColumn("_slot", F.explode(F.sequence(slot(F.col("begin")), F.greatest(slot(F.col("begin")), slot(F.col("end"))))))
    on = (F.col("doc_id") == F.col("_d")) & (F.col("_slot") == slot(F.col("_ib"))) & strictly_contains(F.col("begin"), F.col("end"), F.col("_ib"), F.col("_ie"))
    return own.join(i, on, "left").groupBy(*rows.columns).agg(F.max(F.col("_d").isNotNull()).alias(name))


def relations_mapped(relations: DataFrame, inner: DataFrame, remove_mapped: bool = False) -> DataFrame:
    """Relations (doc_id, rel_id, targets) all of whose targets strictly contain an inner annotation, at least one target; or the others."""
    t = relations.select("doc_id", "rel_id", F.explode("targets").alias("t")).select("doc_id", "rel_id", F.col("t.begin").alias("begin"), F.col("t.end").alias("end"))
    good = holding(t, inner, "hit").groupBy("doc_id", "rel_id").agg(F.every("hit").alias("ok")).where("ok").select("doc_id", "rel_id")
    return relations.join(good, ["doc_id", "rel_id"], "left_anti" if remove_mapped else "left_semi")


def sentences_with(sentences: DataFrame, spans: DataFrame) -> DataFrame:
    """Sentences that contain a span."""
    hit = within(spans.select("doc_id", "begin", "end").distinct(), sentences.select("doc_id", "sent_no", "begin", "end"), "s_").select("doc_id", F.col("s_sent_no").alias("sent_no")).distinct()
    return sentences.join(hit, ["doc_id", "sent_no"], "left_semi")


def counted(df: DataFrame, keep: Column, seen: Observation) -> DataFrame:
    """The rows to keep; seen.get has "total" and "removed" once an action has run, without a pass of their own."""
    return df.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce(keep, F.lit(False))).alias("removed")).where(keep)
