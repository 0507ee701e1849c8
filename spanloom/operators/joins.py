"""Joins of span tables within documents: containment, cover, nearest neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.offsets import contains


def renamed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns))


#: Characters of a slot: spans meet where they share one, so that a join makes pairs of neighbours, not of all spans of a document.
SLOT = 256


def slot(place: Column, width: int = SLOT) -> Column:
    return F.floor(place / width).cast("int")


def within(inner: DataFrame, outer: DataFrame, prefix: str = "outer_", how: str = "inner", strict: bool = False) -> DataFrame:
    """Rows of inner with every span of outer that contains them, its columns under prefix.

    A span of outer is there once for each slot it reaches over, a span of inner at the slot where it begins: a pair meets
    once, by equality of document and slot. Work is linear in the text and in what is found.
    """
    out = renamed(outer, prefix, ()).withColumnRenamed(prefix + "doc_id", "_doc")
    out = out.withColumn("_slot", F.explode(F.sequence(slot(F.col(prefix + "begin")), F.greatest(slot(F.col(prefix + "begin")), slot(F.col(prefix + "end"))))))
    on = (inner.doc_id == out._doc) & (slot(inner.begin) == out._slot) & contains(F.col(prefix + "begin"), F.col(prefix + "end"), inner.begin, inner.end)
    if strict:
        on &= (F.col(prefix + "begin") != inner.begin) | (F.col(prefix + "end") != inner.end)
    return inner.join(out, on, how).drop("_doc", "_slot")


#: Characters of a slot of met(): few, as a span meets all tokens of its slots.
NEAR = 64


def met(spans: DataFrame, tokens: DataFrame, gap: int, covering: bool) -> DataFrame:
    """(doc_id, begin, end) of each distinct span with the tokens (tb, te, tok, pos) that end or begin fewer than gap characters beside it (_before, _after) and, if covering, those within or around it (_own).

    One join by equality of document and slot, for which a token is there once, or once for each slot it reaches over: no
    product, and no sorting of tokens. A pair may come twice; a span without tokens comes once, with nulls.
    """
    s = spans.select("doc_id", "begin", "end").distinct()
    b, e, tb, te = (F.col(c) for c in ("begin", "end", "tb", "te"))
    lo = F.greatest(b - (gap - 1), F.lit(0))
    probes = s.withColumn("_slot", F.explode(F.sequence(slot(lo, NEAR), slot(F.greatest(e + (gap - 1), b, lo), NEAR))))
    pos = F.col("pos") if "pos" in tokens.columns and covering else F.lit(None).cast("string")
    t = tokens.select(F.col("doc_id").alias("_doc"), b.alias("tb"), e.alias("te"), F.col("text").alias("tok"), pos.alias("pos"))
    t = t.withColumn("_at", F.explode(F.sequence(slot(tb, NEAR), slot(F.greatest(tb, te), NEAR))))
    before, after = (te <= b) & (b - te < gap), (tb >= e) & (tb - e < gap)
    own = contains(tb, te, b, e) | contains(b, e, tb, te) if covering else F.lit(False)
    near = before | after | own if covering else before | after
    both = probes.join(t, (F.col("doc_id") == F.col("_doc")) & (F.col("_slot") == F.col("_at")) & near, "left")
    return both.withColumns({"_before": before, "_after": after, "_own": own})


def _sides() -> tuple[Column, Column]:
    before = F.max(F.when(F.col("_before"), F.struct("te", "tb", "tok")))["tok"]
    return before.alias("before"), F.min(F.when(F.col("_after"), F.struct("tb", "te", "tok")))["tok"].alias("after")


def neighbours(spans: DataFrame, tokens: DataFrame, gap: int = 10) -> DataFrame:
    """(doc_id, begin, end, before, after): the nearest token that ends at or before the span, and that begins at or after, fewer than gap characters away.

    Of tokens equally near, before is the one that begins last. A span with a null doc_id has no neighbours.
    """
    return met(spans, tokens, gap, False).groupBy("doc_id", "begin", "end").agg(*_sides())


def surroundings(spans: DataFrame, tokens: DataFrame, gap: int = 10) -> DataFrame:
    """(doc_id, begin, end, before, prefix, suffix, after, pos) of each distinct span.

    prefix is the first token within or around the span if it begins no later, suffix the last if it ends no earlier; a
    single token is both if it covers the span. pos is that of the prefix, if tokens have one.
    """
    within = F.collect_set(F.when(F.col("_own"), F.struct(F.col("tb").alias("b"), F.col("te").alias("e"), F.col("tok").alias("text"), "pos")))
    both = met(spans, tokens, gap, True).groupBy("doc_id", "begin", "end").agg(*_sides(), F.sort_array(within).alias("t"))
    first, last, one = F.try_element_at("t", F.lit(1)), F.try_element_at("t", F.lit(-1)), F.size("t") == 1
    b, e = F.col("begin"), F.col("end")
    prefix = F.when(F.when(one, (first.b <= b) & (first.e >= e)).otherwise(first.b <= b), first)
    suffix = F.when(F.when(one, (first.b <= b) & (first.e >= e)).otherwise(last.e >= e), last)
    both = both.select("doc_id", "begin", "end", "before", "after", prefix.alias("p"), suffix.alias("s"))
    head = F.substring(F.col("p.text"), F.lit(1), F.greatest(b - F.col("p.b"), F.lit(0)))
    tail = F.substring(F.col("s.text"), F.length("s.text") - F.greatest(F.col("s.e") - e, F.lit(0)) + 1, F.greatest(F.col("s.e") - e, F.lit(0)))
    return both.select("doc_id", "begin", "end", "before", head.alias("prefix"), tail.alias("suffix"), "after", F.col("p.pos").alias("pos"))
