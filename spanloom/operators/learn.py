"""Learning token black-lists from judged annotations, and their evaluation; runs of equal lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import kept

POS = ("NN", "JJ", "NNP", "NNS", "DT", "NULL")
CUTOFFS = {"before": 1.2, "after": 1.2, "prefix": 1.1, "suffix": 1.1, "token": 1.2}


def field_counts(judged: DataFrame, fields: tuple[str, ...] = tuple(CUTOFFS)) -> DataFrame:
    """(field, value, hits, misses) of the values of each field; judged has a boolean hit, and may have n, how often there is such a row."""
    stack = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields)))
    n = F.col("n") if "n" in judged.columns else F.lit(1)
    sums = (F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(name) for hit, name in ((F.col("hit"), "hits"), (~F.col("hit"), "misses")))
    return judged.select("hit", n.cast("long").alias("n"), stack.alias("x")).where("x.value is not null").groupBy("x.field", "x.value").agg(*sums)


def over_cutoff(cutoff: Column) -> Column:
    """misses / hits, or misses where nothing hits, at least the cutoff; what only hits never is."""
    return F.when((F.col("hits") > 0) & (F.col("misses") > 0), F.col("misses") / F.col("hits") >= cutoff).otherwise((F.col("hits") == 0) & (F.col("misses") >= cutoff))


def learn_filters(judged: DataFrame) -> DataFrame:
    """(field, value) to be filtered. Misses that a context field filters already no longer count against tokens.

    Equal rows are one with their number, and all is learnt from that table, which is computed once.
    """
    cut = F.element_at(F.create_map(*(F.lit(x) for kv in CUTOFFS.items() for x in kv)), F.col("field"))
    own = kept(judged.groupBy("hit", *CUTOFFS).agg(F.count("*").alias("n")))
    counts = kept(field_counts(own))
    context = counts.where((F.col("field") != "token") & over_cutoff(cut)).select("field", "value")
    filtered = apply_filters(own, context, ("before", "after", "prefix", "suffix"), invert=True)
    less = filtered.where(~F.col("hit")).groupBy(F.col("token").alias("value")).agg(F.sum("n").alias("less"))
    tokens = counts.where("field = 'token'").join(less, "value", "left").withColumn("misses", F.greatest(F.col("misses") - F.coalesce("less", F.lit(0)), F.lit(0))).where(over_cutoff(F.lit(CUTOFFS["token"]))).select("field", "value")
    return context.union(tokens)


def apply_filters(rows: DataFrame, filters: DataFrame, fields: tuple[str, ...] = tuple(CUTOFFS), invert: bool = False) -> DataFrame:
    """Rows none of whose fields is filtered, or the others. One equality join for each field, which the planner broadcasts if the values are few."""
    own = filters.distinct()
    if not invert:
        for f in fields:
            rows = rows.join(own.where(F.col("field") == f).select(F.col("value").alias("_v")), F.col(f) == F.col("_v"), "left_anti")
        return rows
    for f in fields:
        rows = rows.join(own.where(F.col("field") == f).select(F.col("value").alias("_v_" + f)), F.col(f) == F.col("_v_" + f), "left")
    return rows.where(F.coalesce(*("_v_" + f for f in fields)).isNotNull()).drop(*("_v_" + f for f in fields))


def precision_recall(found: DataFrame, gold: DataFrame, article: str = "article", item: str = "item") -> DataFrame:
    """(tp, fp, fn, p, r, f) over all articles."""
    a, b = found.select(article, item).distinct().withColumn("_a", F.lit(1)), gold.select(article, item).distinct().withColumn("_b", F.lit(1))
    own = a.join(b, [article, item], "full").agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("tp"), F.count_if(F.col("_b").isNull()).alias("fp"), F.count_if(F.col("_a").isNull()).alias("fn"))
    div = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    own = own.withColumn("p", div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", div(F.col("tp"), F.col("tp") + F.col("fn")))
    return own.withColumn("f", div(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))


def recall(evidence: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(tp, fn, recall) in per cent of the evidence found."""
    own = evidence.select(*keys).distinct().join(found.select(*keys).distinct().withColumn("_f", F.lit(1)), keys, "left").agg(F.count("_f").alias("tp"), F.count_if(F.col("_f").isNull()).alias("fn"))
    return own.withColumn("recall", F.coalesce(F.try_divide(100.0 * F.col("tp"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0)))


def collapse_runs(rows: DataFrame, partition: list[str], order: list[str], same: list[str], payload: str) -> DataFrame:
    """One row for each run of rows, in order, equal in `same`: with the payloads of the run, in order, and its length."""
    w = Window.partitionBy(*partition).orderBy(*order)
    key = F.struct(*same)
    own = rows.withColumn("_new", F.when(F.lag(key).over(w).eqNullSafe(key), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return own.groupBy(*partition, "_run", *same).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, payload))), lambda x: x[payload]).alias(payload + "s"), F.count("*").alias("n")).withColumnRenamed("_run", "run")
