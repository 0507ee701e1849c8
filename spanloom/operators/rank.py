"""Counts per document and the features by which mentions are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import greek_to_latin
from .joins import within

NER = ("cell_line", "cell_type", "DNA", "protein", "RNA")
FEATURES = ("no_ner", *NER, "confidence", "taxon_nearness", "unambiguity", "n_id", "n_name", "n_id_name", "links", "symbol", "id_symbol", "n_taxon")


def counts(mentions: DataFrame) -> DataFrame:
    """Adds n_id, n_name, n_id_name and ambiguity (mentions at the span), counted per document."""
    over = lambda *c: F.count("*").over(Window.partitionBy("doc_id", *c))
    return mentions.withColumns({"n_id": over("id"), "n_name": over("match"), "n_id_name": over("id", "match"), "ambiguity": over("begin", "end")})


def over_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column by its greatest value in the document; 0 where that is 0."""
    w = Window.partitionBy("doc_id")
    return df.withColumns({c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.max(c).over(w).cast("double")), F.lit(0.0)) for c in columns})


def taxon_distance(mentions: DataFrame, taxa: DataFrame) -> DataFrame:
    """Adds distance: characters to the nearest mention of the same taxon in the document, null without one. taxa: (doc_id, taxon, begin, end).

    The least difference of begins or of ends. Each is the nearer of the last one before and the first one after, by one
    window each way over mentions and taxa in the order of the text; all share one shuffle by document and taxon.
    """
    keys = mentions.select("doc_id", "taxon", "begin", "end").distinct()
    none = F.lit(None).cast("int")
    rows = keys.select("doc_id", "taxon", "begin", "end", F.lit(1).alias("kind"), none.alias("_b"), none.alias("_e")).union(taxa.select("doc_id", "taxon", "begin", "end", F.lit(0), "begin", "end"))
    for place, of in (("begin", "_b"), ("end", "_e")):
        for side, order in (("lo", F.asc(place)), ("hi", F.desc(place))):
            w = Window.partitionBy("doc_id", "taxon").orderBy(order, "kind").rowsBetween(Window.unboundedPreceding, 0)
            rows = rows.withColumn(of + side, F.abs(F.last(of, ignorenulls=True).over(w) - F.col(place)))
    near = rows.where("kind = 1").select("doc_id", "taxon", "begin", "end", F.least("_blo", "_bhi", "_elo", "_ehi").alias("distance"))
    return mentions.join(near, ["doc_id", "taxon", "begin", "end"], "left")


def distinct_offsets(mentions: DataFrame) -> DataFrame:
    """(doc_id, match, n): at how many places of the document a text is mentioned, whatever the ids."""
    return mentions.groupBy("doc_id", "match").agg(F.count_distinct(F.struct("begin", "end")).alias("n"))


def ids_of(rows: DataFrame, keys: list[str], column: str = "id") -> DataFrame:
    """(*keys, ids): the sorted ids of each group."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set(column)).alias("ids"))


def first_within(mentions: DataFrame, ner: DataFrame) -> DataFrame:
    """Adds label: that of the first entity span (doc_id, begin, end, label) that contains the mention, null without one."""
    spans = mentions.select("doc_id", "begin", "end").distinct()
    first = within(spans, ner.select("doc_id", "begin", "end", "label"), "_n_").groupBy("doc_id", "begin", "end").agg(F.min(F.struct("_n_begin", "_n_end", "_n_label"))["_n_label"].alias("label"))
    return mentions.join(first, ["doc_id", "begin", "end"], "left")


def looked_up(df: DataFrame, column: str, names: DataFrame, value: str) -> DataFrame:
    """Adds value of names (key, value) by the column as it is, else with the names of its Greek letters; null if neither is there."""
    one, two = names.toDF("_k1", "_v1"), names.toDF("_k2", "_v2")
    own = df.join(one, F.col(column) == F.col("_k1"), "left").join(two, F.col("_k1").isNull() & (greek_to_latin(F.col(column)) == F.col("_k2")), "left")
    return own.withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_v1", "_k2", "_v2")


def model_weights(spark: SparkSession, path: str, columns: tuple[str, ...] = FEATURES) -> dict[str, float]:
    """The weights of a linear ranking model: lines of "number:weight" pairs, features numbered from 1, a bias at 0; lines with a # are comments."""
    pairs = F.regexp_extract_all("value", F.lit(r"(\d+:[-+0-9.eE]+)"), F.lit(1))
    rows = spark.read.text(path).where("not startswith(ltrim(value), '#')").select(F.explode(pairs).alias("p")).collect()
    found = {int(k): float(v) for k, v in (r.p.split(":") for r in rows)}
    if not found or max(found) > len(columns):
        raise ValueError(f"{path} isn't a model of {len(columns)} features")
    return {columns[k - 1] if k else "bias": v for k, v in sorted(found.items())}


def features(mentions: DataFrame, taxa: DataFrame, ner: DataFrame, links: DataFrame, symbols: DataFrame, references: DataFrame, strict: bool = False) -> DataFrame:
    """The mentions with FEATURES.

    ner: (doc_id, begin, end, label) of equal spans; links: (id, n); symbols: (name, n); references: (id, name, n). What isn't
    there counts 0; strictly, mentions of unknown symbols, references or taxa go.
    """
    own = taxon_distance(counts(mentions), taxa)
    if strict:
        own = own.join(symbols.toDF("match", "_n"), "match", "left_semi").join(references.toDF("id", "match", "_n"), ["id", "match"], "left_semi").join(taxa, ["doc_id", "taxon"], "left_semi")
    own = own.join(ner.groupBy("doc_id", "begin", "end").agg(F.min("label").alias("_label")), ["doc_id", "begin", "end"], "left")
    own = own.join(links.toDF("id", "links"), "id", "left").join(symbols.toDF("match", "symbol"), "match", "left").join(references.toDF("id", "match", "id_symbol"), ["id", "match"], "left")
    n_taxon = taxa.groupBy("doc_id", "taxon").agg(F.count_distinct("begin", "end").alias("n_taxon"))
    own = own.join(n_taxon, ["doc_id", "taxon"], "left").fillna(0, ["links", "symbol", "id_symbol", "n_taxon"])
    own = own.withColumns({"no_ner": F.col("_label").isNull().cast("double"), **{n: F.coalesce((F.col("_label") == n).cast("double"), F.lit(0.0)) for n in NER}})
    own = own.withColumn("taxon_nearness", F.when(F.col("distance") == 0, 1.0).otherwise(F.coalesce(1.0 / F.col("distance"), F.lit(0.0)))).withColumn("unambiguity", 1.0 / F.col("ambiguity"))
    return over_max(own, ["n_id", "n_name", "n_id_name", "links", "symbol", "id_symbol", "n_taxon"]).drop("_label")


def linear_score(weights: dict[str, float]) -> Column:
    """The sum of the weighted columns, and of a "bias"."""
    return sum((F.col(c) * w for c, w in weights.items() if c != "bias"), F.lit(weights.get("bias", 0.0)))


def top(df: DataFrame, score: Column, by: list[str], ties: list[str], n: int) -> DataFrame:
    """The n rows of highest score in each group, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), *ties)
    return df.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def training_rows(df: DataFrame, label: Column, query: Column, columns: tuple[str, ...] = FEATURES) -> Column:
    """A line "label qid:q 1:x 2:y" for each row."""
    return F.concat_ws(" ", label, F.concat(F.lit("qid:"), query), *(F.concat(F.lit(f"{i}:"), F.format_string("%.6f", F.col(c).cast("double"))) for i, c in enumerate(columns, 1)))
