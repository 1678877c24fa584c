"""Documents as they arrive: cleaned in a stream, and kept by identifier in a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.functions import text as T
from scriptorium.sources.readers import stem


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """``book, text`` of Markdown files as they come into a directory; a file is one row, so a document is never split."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.md").load(path)
    return files.select(stem(F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("book"), F.col("value").alias("text"))


def cleaned(stream: DataFrame, text: str = "text") -> DataFrame:
    """The light clean-up is row-local, so it holds for a stream as for a table."""
    return stream.withColumn(text, T.light(F.col(text)))


def into(stream: DataFrame, collection, checkpoint: str, key: str = "point_id") -> StreamingQuery:
    """Upserts each micro-batch into a collection; a batch that is run again changes nothing, since ids are kept once."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: collection.upsert(df, key)).start()
