"""Pipelines over files as they arrive. Every stage here works within a row, so that no state is kept and rows are only appended; dictionaries are static."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract
from ..operators.gazetteer import match_everywhere

RAW = "doc_id long, uri string, mime string, raw string"


def raw_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of RAW rows, read as they appear."""
    return spark.readStream.schema(RAW).parquet(folder)


def texts(raw: DataFrame) -> DataFrame:
    return extract.extract(raw, kind=extract.kind_of(F.col("uri"), F.col("raw"), F.col("mime"))).select("doc_id", "text")


def mentions(raw: DataFrame, gazetteer: DataFrame, boundary: bool = True) -> DataFrame:
    """Dictionary mentions in arriving documents."""
    return match_everywhere(texts(raw), gazetteer, boundary=boundary)


def start(out: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends to a Parquet table, each file once; checkpoint is a folder that all executors share."""
    writer = out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
