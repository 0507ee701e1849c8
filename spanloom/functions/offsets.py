"""Spans of text: order, containment, distance, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(begin: Column, end: Column, inner_begin: Column, inner_end: Column) -> Column:
    return (begin <= inner_begin) & (end >= inner_end)


def all_contained(outer: Column, inner: Column) -> Column:
    """Whether every span of the array inner lies within some span of outer."""
    return F.forall(inner, lambda i: F.exists(outer, lambda o: contains(o["begin"], o["end"], i["begin"], i["end"])))


def strictly_contains(begin: Column, end: Column, inner_begin: Column, inner_end: Column) -> Column:
    return contains(begin, end, inner_begin, inner_end) & ((begin != inner_begin) | (end != inner_end))


def canonical_order(df: DataFrame) -> DataFrame:
    """By document, begin, end from the last, then namespace and identifier, nulls last."""
    keys = [F.asc("doc_id"), F.asc("begin"), F.desc("end")]
    return df.orderBy(*keys, *(F.asc_nulls_last(c) for c in ("namespace", "identifier") if c in df.columns))


def distance(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    """Characters between two spans, 0 if they touch or overlap."""
    return F.greatest(b2 - e1, b1 - e2, F.lit(0))


def to_utf16_offset(text: Column, offset: Column) -> Column:
    """An offset in code points as one in UTF-16 code units."""
    head = F.substring(text, F.lit(1), offset)
    return offset + F.length(F.regexp_replace(head, r"[^\x{10000}-\x{10FFFF}]", ""))
