"""Known-passage retrieval report, a batch job.

Every passage of a table (item_id, text) is asked as a query over a table of documents
(doc_id, text). The gold is which documents contain the passage, found without a
ranking; the job says where the ranking, and the ranking cut down to verified
documents, lose them. It writes, below the output folder and anew each time,

* run/bucket=B: qid, rank, doc_id, score: the pool of each passage;
* gold/bucket=B: qid, doc_id;
* report/method=M: one row a passage that some document contains.

    python jobs/passage_report.py --config jobs/passage_report.json --documents D --passages P --out O

Rows without id or text take no part; of documents or passages with one id the least text counts.
A run that was cut off is made whole by the next; equal tables give equal output.
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

from sieveline.operators import bm25, fusion, metrics, passages
from sieveline.sources.tables import drop, mark, written

log = logging.getLogger("passage_report")
REPORT = ("recall_at_5", "recall_at_20", "recall_at_100", "norm_recall_at_100", "ndcg_at_5", "ndcg_at_20", "ndcg_at_100", "candidate_recall")
MISSES = ("total_misses", "candidate_miss", "avoidable_ranking_miss", "structural_cutoff_miss")


@dataclass(frozen=True)
class Config:
    tokenizer: str = "regex"
    pool_k: int = 100
    final_k: int = 20
    buckets: int = 8

    def __post_init__(self):
        if not 0 < self.final_k <= self.pool_k or self.buckets <= 0:
            raise ValueError("0 < final_k <= pool_k and buckets > 0")


def _texts(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with id and text; of one id the least text. Only the texts of ids that are there more than once are brought together."""
    known = df.select(F.col(key).cast("long").alias(name), F.col("text").cast("string").alias("text")).where(f"{name} is not null and text is not null")
    twice = bm25.few(written(known.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(name)))
    return known.join(twice, name, "left_anti").unionByName(known.join(twice, name, "left_semi").groupBy(name).agg(F.min("text").alias("text")))


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("qid"), F.lit(buckets)).cast("int")).repartition("bucket")


def run(spark: SparkSession, documents: str, items: str, out: str, config: Config = Config()) -> dict[str, int]:
    """Write run, gold and report below out; rows read and written. Tables on the way there are deleted at the end."""
    since = mark()
    try:
        return _run(spark, documents, items, out, config)
    finally:
        drop(since)


def _run(spark: SparkSession, documents: str, items: str, out: str, config: Config) -> dict[str, int]:
    corpus = written(_texts(spark.read.parquet(documents), "doc_id", "ordinal"))
    asked = written(_texts(spark.read.parquet(items), "item_id", "qid").select(F.col("qid").cast("string").alias("qid"), "text"))
    counts = {"documents": corpus.count(), "passages": asked.count()}
    log.info("read %(documents)d documents and %(passages)d passages", counts)

    index = bm25.build(corpus, config.tokenizer)
    pool = written(bm25.search(index, asked, config.pool_k, config.tokenizer))
    gold = written(passages.containing(index, corpus, asked, config.tokenizer))
    flat = lambda name, df: df.select(F.lit(name).alias("method"), "qid", "ordinal", F.when(F.col("rank") <= config.final_k, F.col("rank")).alias("rank"))
    results = flat("bm25", pool).unionByName(flat("full_verify", fusion.full_verify(pool, gold, config.final_k)))
    queries = asked.select("qid", F.lit("passage").alias("template"), F.array("text").alias("attrs"))
    rows = metrics.evaluate(results, queries, gold).select("method", "qid", "gold_size", *REPORT)
    report = rows.join(metrics.ranking_errors(results, queries, gold, config.final_k).select("method", "qid", *MISSES), ["method", "qid"])

    tables = {
        "run": (_bucketed(pool.select("qid", "rank", F.col("ordinal").alias("doc_id"), "score"), config.buckets), "bucket"),
        "gold": (_bucketed(gold.select("qid", F.col("ordinal").alias("doc_id")), config.buckets), "bucket"),
        "report": (report.repartition("method"), "method"),
    }
    for name, (df, by) in tables.items():
        df.write.mode("overwrite").partitionBy(by).parquet(f"{out}/{name}")
        counts[name] = spark.read.schema(df.schema).parquet(f"{out}/{name}").count()
        log.info("wrote %d rows to %s/%s", counts[name], out, name)
    return counts


def report(spark: SparkSession, out: str) -> DataFrame:
    """The report that a run left at out."""
    kinds = ["qid string", "gold_size long", *(f"{c} double" for c in REPORT), *(f"{c} long" for c in MISSES), "method string"]
    return spark.read.schema(", ".join(kinds)).parquet(f"{out}/report")


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "passages", "out", "config"):
        top.add_argument(f"--{name}", required=name != "config")
    asked = top.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = Config(**json.loads(Path(asked.config).read_text())) if asked.config else Config()
    spark = SparkSession.builder.appName("passage_report").getOrCreate()
    try:
        print(json.dumps(run(spark, asked.documents, asked.passages, asked.out, config)))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
