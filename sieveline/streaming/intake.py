"""Micro-batch intake: new documents of a folder become facts, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import likes

DOCUMENTS = T.StructType([T.StructField("_id", T.StringType()), T.StructField("text", T.StringType())])


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, attr of a static or streaming table of documents."""
    return docs.select(F.col("_id").alias("doc_id"), F.explode(likes("text")).alias("attr"))


def start(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the facts of every JSONL file that arrives in source; stops when it has read what is there."""
    read = spark.readStream.schema(DOCUMENTS).json(source)
    return facts(read).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
