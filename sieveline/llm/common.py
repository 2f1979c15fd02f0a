"""Session helpers of the corpus operators: inputs, shared folder, folds, Arrow passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import ship
from ..sources.tables import written as cut

__all__ = ["WORD", "cut", "distinct_texts", "documents", "fold", "met", "prepare", "table"]
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Let workers find this package, and keep Arrow batches small: one batch of long texts must not fill a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; a null doc_id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts).cast("int")


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, with null texts as null; other columns only where named, so clashing extras never matter."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, text): each distinct text of each doc_id once, however often its row is repeated; tid is its hash."""
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("tid"), "text")
    twice = cut(texts.groupBy("doc_id", "tid").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "tid"))
    if twice.isEmpty():
        return texts
    again = texts.join(twice, ["doc_id", "tid"], "left_semi").groupBy("doc_id", "tid").agg(F.min("text").alias("text"))
    return cut(texts.join(twice, ["doc_id", "tid"], "left_anti").unionByName(again))


def met(rows: DataFrame, index: DataFrame, keys: list[str], hot: int) -> DataFrame:
    """rows joined with index, which has each key once and, in its column rows, how many rows have it.

    Keys with more than 1 / hot of all rows would each fill a task; there are fewer than
    hot of them, so their part of the index is broadcast. The others meet by shuffle.
    """
    least = max(rows.count() // hot, 1000)
    many = index.where(F.col("rows") > least)
    if many.isEmpty():
        return rows.join(index, keys)
    crowd = rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(index.where(F.col("rows") <= least), keys)
    return crowd.unionByName(rows.join(F.broadcast(many), keys))
