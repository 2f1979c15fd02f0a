"""Reranking a fixed pool with a pluggable scorer, resumable and fail-closed."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rerank_prompt
from ..sources.ordinals import with_ordinals
from ..sources.tables import written

INSTRUCTION = "Decide whether the document answers the query."
CHECKPOINT = "qid string, ordinal long, source_rank int, score double, protocol string, seconds double"
#: Queries whose scores are kept by one commit.
GROUP = 64
#: What a model scores with: a function of queries and documents, pair by pair.
Score = Callable[[list[str], list[str]], np.ndarray]


@dataclass(frozen=True)
class Model:
    """A pair scorer. load makes the function from the weights and the token limit, once in each Python worker; weights are broadcast once a session."""

    load: Callable[[Any, int], Score]
    weights: Any = None
    batch: int = 64
    limit: int = 384


def lexical_score(query: Column | str, document: Column | str) -> Column:
    """Share of the query's distinct lower-cased words that the document has, commas and periods aside. Stands in for a neural model."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    words, have = split(col(query)), split(F.translate(col(document), ",.", "  "))
    return F.size(F.array_intersect(words, have)) / F.greatest(F.size(words), F.lit(1))


def pairs(pool: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """qid, ordinal, source_rank, query, document, prompt."""
    rows = pool.select("qid", "ordinal", F.col("rank").alias("source_rank")).join(queries.select("qid", F.col("text").alias("query")), "qid").join(corpus.select("ordinal", F.col("text").alias("document")), "ordinal")
    return rows.withColumn("prompt", rerank_prompt(INSTRUCTION, F.col("query"), F.col("document")))


def protocol_fingerprint(**contract: object) -> str:
    """SHA-256 of the canonical JSON of what makes two runs comparable."""
    return hashlib.sha256(json.dumps({"instruction": INSTRUCTION, **contract}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


_loaded: dict[str, Score] = {}


def _scorer(name: str, shared, model: Model) -> Score:
    """The model's function in this worker, made when first asked for under this name."""
    if name not in _loaded:
        _loaded.clear()  # one model at a time
        _loaded[name] = model.load(shared.value, model.limit)
    return _loaded[name]


def batches(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of pairs of about one size, at most so many together: short ones do not wait for long ones."""
    order = np.argsort(sizes, kind="stable")
    for i in range(0, len(order), most):
        yield order[i : i + most]


def model_scores(rows: DataFrame, model: Model) -> DataFrame:
    """qid, ordinal, source_rank, score, seconds of pairs (qid, ordinal, source_rank, query, document); seconds: the pair's share of its batch's time."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model.weights)
    bare, name = Model(model.load, None, model.batch, model.limit), uuid.uuid4().hex

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _scorer(name, shared, bare)
        for pdf in parts:
            queries, documents = pdf["query"].tolist(), pdf["document"].tolist()
            found, spent = np.empty(len(pdf)), np.empty(len(pdf))
            for own in batches(np.array([len(q) + len(d) for q, d in zip(queries, documents, strict=True)], np.int64), bare.batch):
                began = time.perf_counter()
                found[own] = score([queries[i] for i in own], [documents[i] for i in own])
                spent[own] = (time.perf_counter() - began) / len(own)
            yield pdf[["qid", "ordinal", "source_rank"]].assign(score=found, seconds=spent)

    return rows.select("qid", "ordinal", "source_rank", "query", "document").mapInPandas(run, "qid string, ordinal long, source_rank int, score double, seconds double")


#: Fixed value: the token pattern in Python's dialect, where a word character is a letter, a number or the underscore.
_TOKEN = re.compile(r"\w+(?:[-'’]\w+)*|[^\w\s]")
BUCKETS = 1 << 16


def overlap_weights() -> np.ndarray:
    """The weight of every bucket of tokens, from a rule: 1 to 97."""
    return 1.0 + np.arange(BUCKETS) * 7919 % 97


def _overlap(weights: np.ndarray, limit: int) -> Score:
    """Weighted share of the query's token buckets that the document has; a token's bucket is the first 16 bits of its md5."""

    def buckets(text: str, most: int) -> np.ndarray:
        return np.unique([int(hashlib.md5(t.encode()).hexdigest()[:4], 16) for t in _TOKEN.findall(text)[:most]] or [-1])

    def score(queries: list[str], documents: list[str]) -> np.ndarray:
        out = np.zeros(len(queries))
        for i, (q, d) in enumerate(zip(queries, documents, strict=True)):
            room = max(limit - len(_TOKEN.findall(q)), 0)
            asked = buckets(q, limit)
            if asked[0] >= 0:
                out[i] = weights[asked[np.isin(asked, buckets(d, room))]].sum() / weights[asked].sum()
        return out

    return score


def overlap_model() -> Model:
    """A small deterministic model in numpy, for runs without a neural one."""
    return Model(_overlap, overlap_weights())


def _pair_scores(pool: DataFrame, queries: DataFrame, corpus: DataFrame, model: Model | None) -> DataFrame:
    """qid, ordinal, source_rank, score, seconds; seconds is null where Spark's own columns score."""
    rows = pairs(pool, queries, corpus)
    if model is not None:
        return model_scores(rows, model)
    return rows.select("qid", "ordinal", "source_rank", lexical_score("query", "document").alias("score"), F.lit(None).cast("double").alias("seconds"))


def rerank(pool: DataFrame, queries: DataFrame, corpus: DataFrame, model: Model | None = None) -> DataFrame:
    """qid, ordinal, source_rank, score, rank; by the lexical score if no model is given."""
    return order(_pair_scores(pool, queries, corpus, model).drop("seconds"))


def _exists(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def resumed(pool: DataFrame, queries: DataFrame, corpus: DataFrame, path: str, protocol: str, model: Model | None = None, group: int = GROUP, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """rerank that keeps each query's scores at path and scores only the queries without them.

    A checkpoint is a partition of one query. Queries are scored and kept in groups of
    at most ``group``, one commit a group, so a run that is cut off loses the group it
    was at; Spark moves finished partitions into place, so no query is there in part. ``seconds`` is the time that scoring
    the query took: a model's own time in its batches, else the query's share of its
    group's. A checkpoint that another pool or protocol made is an error: the caller
    chooses another path or removes it.
    """
    spark = pool.sparkSession
    kept = lambda: spark.read.schema(CHECKPOINT).parquet(path) if _exists(spark, path) else spark.createDataFrame([], CHECKPOINT)
    if not incompatible(pool, kept(), protocol).isEmpty():
        raise ValueError(f"{path} holds checkpoints of another pool or protocol")
    asked = pool.select("qid").distinct().join(kept().select("qid").distinct(), "qid", "left_anti")
    # the number of a group, not its queries, is what the driver counts
    numbered = written(with_ordinals(asked, "qid").select("qid", F.floor(F.col("ordinal") / group).alias("group")))
    for i in range(-(-numbered.count() // group)):
        mine = pool.join(numbered.where(F.col("group") == i).select("qid"), "qid", "left_semi")
        began = clock()
        found = written(_pair_scores(mine, queries, corpus, model))
        share = (clock() - began) / max(found.count(), 1)
        spent = F.sum(F.coalesce("seconds", F.lit(share))).over(Window.partitionBy("qid"))
        found = found.withColumn("seconds", spent).withColumn("protocol", F.lit(protocol)).select("ordinal", "source_rank", "score", "protocol", "seconds", "qid")
        found.repartition("qid").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("qid").parquet(path)
    return order(kept().join(pool.select("qid").distinct(), "qid", "left_semi").select("qid", "ordinal", "source_rank", "score"))


def throughput(pairs_scored: int, seconds: float, queries: int, pool_k: int) -> dict[str, float | None]:
    """Pairs a second and the hours that all queries would take; none of both where no time passed."""
    rate = pairs_scored / seconds if seconds else None
    return {"pairs_per_second": rate, "projected_hours": queries * pool_k / rate / 3600 if rate else None}


def measured(done: DataFrame, queries: DataFrame, pool_k: int) -> DataFrame:
    """pairs, seconds, pairs_per_second, projected_hours of checkpoints, projected to pool_k pairs of every query; the last two null where no time passed."""
    by = done.groupBy("qid").agg(F.count("*").alias("pairs"), F.max("seconds").alias("seconds"))
    total = by.agg(F.coalesce(F.sum("pairs"), F.lit(0).cast("long")).alias("pairs"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds")).crossJoin(queries.agg((F.count("*") * pool_k).alias("all")))
    rate = F.try_divide("pairs", "seconds")
    return total.select("pairs", "seconds", rate.alias("pairs_per_second"), (F.try_divide(F.col("all"), rate) / 3600).alias("projected_hours"))


def order(scored: DataFrame) -> DataFrame:
    """Score descending, then pool order."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "source_rank")))


def pending(pool: DataFrame, done: DataFrame) -> DataFrame:
    """qids of the pool without a compatible checkpoint."""
    return pool.select("qid").distinct().join(incompatible(pool, done).unionByName(pool.select("qid").distinct().join(done.select("qid").distinct(), "qid", "left_anti")), "qid", "left_semi")


def incompatible(pool: DataFrame, done: DataFrame, protocol: str | None = None) -> DataFrame:
    """qids whose checkpoint is not a finite scoring of exactly the present pool, in its order, under the present protocol."""
    here = pool.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "ordinal"))).alias("pool"))
    other = ~F.coalesce(F.bool_and(F.col("protocol") == protocol), F.lit(False)) if protocol is not None else F.lit(False)
    there = done.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("source_rank").cast("int").alias("rank"), "ordinal"))).alias("seen"), F.bool_and(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))).alias("finite"), other.alias("other"))
    return here.join(there, "qid").where(F.col("other") | ~F.col("finite") | (F.col("pool") != F.col("seen"))).select("qid")


def pool_fingerprint(pool: DataFrame) -> DataFrame:
    """qid, sha256 of its ranking as compact JSON."""
    ranked = pool.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "ordinal"))).alias("r"))
    ids = F.transform("r", lambda x: x["ordinal"].cast("string"))
    return ranked.select("qid", F.sha2(F.to_json(F.struct("qid", ids.alias("ranking"))), 256).alias("sha256"))


def pool_violations(pool: DataFrame, corpus: DataFrame, pool_k: int) -> DataFrame:
    """qid, rule: too few ranks, repeated documents, unknown documents."""
    by = pool.groupBy("qid").agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("d"))
    unknown = pool.join(corpus.select("ordinal"), "ordinal", "left_anti").select("qid").distinct()
    rules = F.explode(F.array_compact(F.array(F.when(F.col("n") < pool_k, F.lit("too_short")), F.when(F.col("d") < F.col("n"), F.lit("duplicate_document")))))
    return by.select("qid", rules.alias("rule")).unionByName(unknown.withColumn("rule", F.lit("unknown_document")))
