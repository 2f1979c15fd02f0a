"""Growing BM25 index, an incremental job.

Documents (doc_id, text, lang) arrive as new Parquet files of a folder or pattern. Each run takes the files
that no run has taken, in micro-batches, and stops; the checkpoint knows which those
are. It keeps, below the output folder,

* documents/batch=N: doc_id, lang, dl, and postings/batch=N: doc_id, dl, term, tf, of
  the documents that batch N brought;
* counts/batch=N: term, df, cf of that batch, so that older text is never read again;
* vocabulary/bucket=B: term, df, cf, idf over all batches, written anew after a run
  that took something.

    python jobs/grow_index.py --config jobs/grow_index.json --documents D --out O --checkpoint C

A batch that was cut off is repeated by the next run over the same files, into the same
partitions. A document that was taken before, by its doc_id, is not taken again; rows
without doc_id take no part, a null text is an empty one, and of rows with one doc_id in one batch
the least text counts. ``index`` opens the output for ``bm25.search``.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from dataclasses import dataclass
from pathlib import Path

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import tokens
from sieveline.operators import bm25

log = logging.getLogger("grow_index")
SCHEMAS = {
    "documents": "doc_id long, lang string, dl int, batch long", "postings": "doc_id long, dl int, term string, tf long, batch long",
    "counts": "term string, df long, cf long, batch long", "vocabulary": "term string, df long, cf long, raw_idf double, idf double, bucket int",
}
TAKEN = "doc_id long, text string, lang string"


@dataclass(frozen=True)
class Config:
    tokenizer: str = "regex"
    files_per_batch: int = 64
    buckets: int = 8
    epsilon: float = 0.25

    def __post_init__(self):
        if self.files_per_batch <= 0 or self.buckets <= 0:
            raise ValueError("files_per_batch and buckets must be positive")


def table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of the output; no rows before the first batch."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{out}/{name}") if there else spark.createDataFrame([], SCHEMAS[name])


def _replaced(df: DataFrame, out: str, name: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")


def _taken(out: str, config: Config):
    def take(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = table(spark, out, "documents").where(F.col("batch") < batch).select("doc_id")
        new = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("doc_id", "r.*").join(before, "doc_id", "left_anti")
        split = new.select("doc_id", "lang", tokens("text", config.tokenizer).alias("tokens")).withColumn("dl", F.size("tokens")).withColumn("batch", F.lit(batch).cast("long"))
        _replaced(split.select("doc_id", "lang", "dl", "batch"), out, "documents")
        _replaced(split.select("doc_id", "dl", "batch", F.explode("tokens").alias("term")).groupBy("doc_id", "dl", "batch", "term").agg(F.count("*").alias("tf")), out, "postings")
        mine = table(spark, out, "postings").where(F.col("batch") == batch)
        _replaced(mine.groupBy("batch", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), out, "counts")
        log.info("batch %d: %d new documents, %d postings", batch, table(spark, out, "documents").where(F.col("batch") == batch).count(), mine.count())

    return take


def vocabulary(spark: SparkSession, out: str, config: Config) -> DataFrame:
    """term, df, cf, raw_idf, idf, bucket over all batches so far, from their counts."""
    size = table(spark, out, "documents").agg(F.count("*").alias("n_docs"))
    raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = table(spark, out, "counts").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).crossJoin(F.broadcast(size)).withColumn("raw_idf", raw)
    mean = terms.agg(F.avg("raw_idf").alias("mean"))
    idf = F.when(F.col("raw_idf") >= 0, F.col("raw_idf")).otherwise(config.epsilon * F.col("mean"))
    return terms.crossJoin(F.broadcast(mean)).select("term", "df", "cf", "raw_idf", idf.alias("idf"), F.pmod(F.xxhash64("term"), F.lit(config.buckets)).cast("int").alias("bucket"))


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: Config = Config()) -> dict[str, int]:
    """Take the files of documents that no run has taken yet; documents, postings, terms and batches there are now, and new documents."""
    before = table(spark, out, "documents").count()
    arriving = spark.readStream.schema(TAKEN).option("maxFilesPerTrigger", config.files_per_batch).parquet(documents)
    stream = arriving.writeStream.foreachBatch(_taken(out, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    counts = {"documents": table(spark, out, "documents").count(), "postings": table(spark, out, "postings").count(), "batches": table(spark, out, "documents").select("batch").distinct().count()}
    counts["new_documents"] = counts["documents"] - before
    log.info("read %d new documents", counts["new_documents"])
    # also where the run before was cut off after its last batch
    vocabulary(spark, out, config).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/vocabulary")
    counts["terms"] = table(spark, out, "vocabulary").count()
    log.info("wrote %d terms over %d documents in %d batches to %s", counts["terms"], counts["documents"], counts["batches"], out)
    return counts


def index(spark: SparkSession, out: str, k1: float = 1.5, b: float = 0.75) -> bm25.Index:
    """The output as an index of its documents, numbered by doc_id."""
    terms = table(spark, out, "vocabulary").select("term", "df", "raw_idf", "idf")
    postings = table(spark, out, "postings").select(F.col("doc_id").alias("ordinal"), "dl", "term", "tf")
    return bm25.opened(postings, table(spark, out, "documents").select(F.col("doc_id").alias("ordinal"), "dl"), terms, k1, b)


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "out", "checkpoint", "config"):
        top.add_argument(f"--{name}", required=name != "config")
    asked = top.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = Config(**json.loads(Path(asked.config).read_text())) if asked.config else Config()
    spark = SparkSession.builder.appName("grow_index").getOrCreate()
    try:
        print(json.dumps(run(spark, asked.documents, asked.out, asked.checkpoint, config)))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
