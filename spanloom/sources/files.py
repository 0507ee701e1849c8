"""Scans: documents from files, keyed resources from lines, dictionaries from lines or SQL."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAB = r"(?<!\\)\t"


def documents(spark: SparkSession, paths: str | list[str] | None = None, mime: str | None = None, recursive: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """(doc_id, uri, mime, raw) of the files of a folder, of a list of files, or of the working folder.

    doc_id is a hash of the path, so that it doesn't depend on listing order. A listed local file that isn't there is an error.
    mime is the one given, else by the name's ending, else by how the content begins, else null.
    """
    if paths is None:
        paths = os.getcwd()
    if isinstance(paths, list):
        missing = [p for p in paths if "://" not in p and not os.access(p, os.R_OK)]
        if missing:
            raise FileNotFoundError(missing[0])
    own = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    guess = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    raw = F.decode("content", encoding)
    head = F.lower(F.ltrim(F.substring(raw, 1, 200), F.lit(" \t\r\n\ufeff")))
    kind = F.when(guess.isin("htm", "html", "xhtml"), "text/html").when(guess.isin("xml", "nxml"), "application/xml").when(guess == "txt", "text/plain").when(head.startswith("<!doctype html") | head.startswith("<html"), "text/html").when(head.startswith("<?xml"), "application/xml").when(F.lower(F.hex(F.substring("content", 1, 4))) == "25504446", "application/pdf")
    return own.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("uri"), (F.lit(mime) if mime else kind).alias("mime"), raw.alias("raw"))


def _scratch_folder(spark: SparkSession) -> str | None:
    """That of spark.checkpoint.dir; a local session without one has its own, others have none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    return folder or (tempfile.gettempdir() if local else None)


def _at_exit(spark: SparkSession, path: str) -> None:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(own)


def scratch(lines: DataFrame) -> str:
    """The path of a table of text lines in the folder of spark.checkpoint.dir (a local session without one has its own), gone when the application ends."""
    spark = lines.sparkSession
    folder = _scratch_folder(spark)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{folder}/lines-{uuid.uuid4().hex}"
    lines.write.text(path)
    _at_exit(spark, path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """The rows from a Parquet table beside those of scratch(), for what a plan would compute several times. As it is without a folder for that, or of a stream."""
    spark = df.sparkSession
    folder = _scratch_folder(spark)
    if df.isStreaming or not folder:
        return df
    path = f"{folder}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def rows(spark: SparkSession, path: str, separator: str = TAB) -> DataFrame:
    """(line_no, cols) of each line that isn't blank; the separator is a regular expression, escaped tabs stay."""
    own = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.trim("value").alias("v")).where("v <> ''")
    return own.select("line_no", F.split("v", separator).alias("cols"))


def _exactly(own: DataFrame, n: int) -> DataFrame:
    """An error at the first row that hasn't n columns."""
    bad = F.raise_error(F.concat(F.lit(f"a line must have {n} fields: "), F.array_join("cols", "|")))
    return own.withColumn("cols", F.when(F.size("cols") == n, F.col("cols")).otherwise(bad.cast("array<string>")))


def string_map(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(key, value); the last line of a key wins."""
    return _exactly(rows(spark, path, separator), 2).groupBy(F.col("cols")[0].alias("key")).agg(F.max_by(F.col("cols")[1], "line_no").alias("value"))


def string_sets(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(key, values), values sorted."""
    return _exactly(rows(spark, path, separator), 2).groupBy(F.col("cols")[0].alias("key")).agg(F.sort_array(F.collect_set(F.col("cols")[1])).alias("values"))


def counters(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(key, n); what isn't an integer is an error."""
    return _exactly(rows(spark, path, separator), 2).groupBy(F.col("cols")[0].alias("key")).agg(F.max_by(F.col("cols")[1], "line_no").cast("int").alias("n"))


def nested_counters(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(key, counts map) of lines key, sub-key, count."""
    own = _exactly(rows(spark, path, separator), 3).groupBy(F.col("cols")[0].alias("key"), F.col("cols")[1].alias("sub")).agg(F.max_by(F.col("cols")[2], "line_no").cast("int").alias("n"))
    return own.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("sub", "n"))).alias("counts"))


def _entity(cols: Column, at: Column | int) -> Column:
    return F.struct(F.get(cols, at).alias("type"), F.get(cols, at + 1).alias("namespace"), F.get(cols, at + 2).alias("id"))


def entities(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(key, entities): the set of (type, namespace, id) of each key; more fields don't count."""
    return rows(spark, path, separator).groupBy(F.col("cols")[0].alias("key")).agg(F.array_sort(F.collect_set(_entity(F.col("cols"), F.lit(1)))).alias("entities"))


def relations(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(key, relations): a set of entities for each line, of 1 + 3n fields; other numbers are an error."""
    n = F.size("cols")
    own = rows(spark, path, separator).withColumn("cols", F.when((n > 1) & ((n - 1) % 3 == 0), F.col("cols")).otherwise(F.raise_error(F.lit("a relation must have 1 + 3n fields")).cast("array<string>")))
    line = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("cols") - 1, F.lit(3)), lambda i: _entity(F.col("cols"), i)))
    return own.groupBy(F.col("cols")[0].alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("r")))), lambda x: x["r"]).alias("relations"))


def relation_entities(own: DataFrame) -> DataFrame:
    """(key, type, namespace, id) of all entities of relations()."""
    return own.select("key", F.explode(F.flatten("relations")).alias("e")).select("key", "e.*").distinct()


def items(spark: SparkSession, path: str) -> DataFrame:
    """(item) of each line that isn't blank."""
    return spark.read.text(path).select(F.trim("value").alias("item")).where("item <> ''")


def gazetteer(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(id, name) of lines split once."""
    own = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''").select(F.split("v", separator, 2).alias("c"))
    return own.select(F.col("c")[0].alias("id"), F.get("c", F.lit(1)).alias("name")).where("name is not null").distinct()


def jdbc(spark: SparkSession, url: str, query: str, driver: str | None = None, user: str | None = None, password: str | None = None, isolation: str = "READ_UNCOMMITTED", timeout: int = 0, **options: str) -> DataFrame:
    """The result of a query, which the database runs as it is. partitionColumn, lowerBound, upperBound and numPartitions read it in parts."""
    reader = spark.read.format("jdbc").option("url", url).option("isolationLevel", isolation).option("queryTimeout", timeout)
    reader = reader.option("dbtable", f"({query}) q") if "partitionColumn" in options else reader.option("query", query)
    for k, v in {"driver": driver, "user": user, "password": password, **options}.items():
        reader = reader.option(k, v) if v is not None else reader
    return reader.load()


def jdbc_gazetteer(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """(id, name) or (id, taxon, name) by the query's columns in their order."""
    own = jdbc(spark, url, query, **options)
    names = ["id", "name"] if len(own.columns) == 2 else ["id", "taxon", "name"]
    return own.toDF(*names).withColumns({n: F.col(n).cast("string") for n in names})


def references(spark: SparkSession, url: str, query: str, namespace: str, **options: str) -> DataFrame:
    """(id, namespace, accession) for mapping ids, read whole and joined instead of asked for by document."""
    return jdbc(spark, url, query, **options).toDF("id", "accession").select(F.col("id").cast("string").alias("id"), F.lit(namespace).alias("namespace"), F.col("accession").cast("string").alias("accession"))


def annotation_lines(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lines that a writer made, by the names of their first columns; "offset" becomes begin and end, the rest an array of properties."""
    own = rows(spark, path)
    out = own.select("line_no", *(F.get("cols", F.lit(i)).alias(n) for i, n in enumerate(names)), F.slice("cols", F.lit(len(names) + 1), F.greatest(F.size("cols") - len(names), F.lit(0))).alias("properties"))
    if "offset" in names:
        part = F.split("offset", ":")
        out = out.withColumns({"begin": part[0].cast("int"), "end": F.get(part, F.lit(1)).cast("int")}).drop("offset")
    return out


def query_lines(path: str) -> list[str]:
    """The SQL of each line of a file."""
    with open(path, encoding="utf-8") as f:
        return [line.strip() for line in f if line.strip()]


def ranges(column: Column) -> Column:
    """b:e;b:e as an array of structs with begin and end."""
    part = lambda x: F.split(x, ":")
    return F.transform(F.split(column, ";"), lambda x: F.struct(F.get(part(x), F.lit(0)).cast("int").alias("begin"), F.get(part(x), F.lit(1)).cast("int").alias("end")))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(article, item) of lines of an article and one or more items."""
    own = rows(spark, path, "\t")
    return own.select(F.col("cols")[0].alias("article"), F.explode(F.slice("cols", F.lit(2), F.size("cols"))).alias("item")).where("item <> ''").distinct()
