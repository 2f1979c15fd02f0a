"""BM25 over a corpus (ordinal, text): index tables, scores and top-k with corpus-order ties.

``scores`` scores every document that has a query term. ``search`` finds the top-k of
the same scores. In both, postings of asked terms are dealt by document into shards and
queries into blocks; each pair of a shard and a block is one group, which scores its
documents by adding up postings, term by term in query order. No pair of a query and a
document is shuffled for that: of a search, a group gives the first k of its own only.

Zero scores are kept implicit: a query that has fewer than k scored documents is
filled from the first other documents in corpus order, which is where zero scores
would rank.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.ordinals import with_ordinals
from ..sources.tables import ship, written

TIE_BREAKS = ("corpus_ordinal",)
#: Queries of a block, postings of a shard in a search, and where all scores are given, whose groups give a row for each document and query.
BLOCK, POSTINGS, FEW = 512, 1 << 19, 1 << 15
#: Terms that are broadcast at most.
BROADCAST = 1 << 17
#: Groups are dealt over at most so many tasks.
TASKS = 4096
#: Scores nearer than this can be equal at 9 decimals.
GRAIN = 2e-9


def ordered_sum(pos: str, value: Column) -> Column:
    """Sum in the order of pos: floating-point addition is not associative, and ties depend on it."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), value.alias("x"))))
    return F.aggregate(pairs, F.lit(0.0), lambda a, z: a + z["x"])


@dataclass(frozen=True)
class Index:
    tf: DataFrame  # ordinal, dl, term, tf
    idf: DataFrame  # term, df, raw_idf, idf
    stats: DataFrame  # n_docs, avgdl, average_idf, vocabulary: one row
    docs: DataFrame  # ordinal, dl
    k1: float
    b: float


def build(corpus: DataFrame, tokenizer: str = "regex", epsilon: float = 0.25, k1: float = 1.5, b: float = 0.75) -> Index:
    """Written index tables. Negative raw idf is replaced by epsilon times the mean raw idf of the vocabulary; zero stays."""
    split = corpus.select("ordinal", tokens("text", tokenizer).alias("tokens")).withColumn("dl", F.size("tokens"))
    # texts are dealt by document before they are split, for their postings are several times as large
    dealt = corpus.select("ordinal", "text").repartition("ordinal").select("ordinal", tokens("text", tokenizer).alias("tokens")).withColumn("dl", F.size("tokens"))
    tf = written(dealt.select("ordinal", "dl", F.explode("tokens").alias("term")).groupBy("ordinal", "dl", "term").agg(F.count("*").alias("tf")))
    docs = written(split.select("ordinal", "dl"))
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = written(tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_docs)).select("term", "df", raw.alias("raw_idf")))
    mean = terms.agg(F.avg("raw_idf").alias("average_idf"))
    idf = F.when(F.col("raw_idf") >= 0, F.col("raw_idf")).otherwise(epsilon * F.col("average_idf"))
    return opened(tf, docs, terms.crossJoin(F.broadcast(mean)).select("term", "df", "raw_idf", idf.alias("idf")), k1, b)


def opened(tf: DataFrame, docs: DataFrame, idf: DataFrame, k1: float = 1.5, b: float = 0.75) -> Index:
    """The index of postings (ordinal, dl, term, tf), documents (ordinal, dl) and terms (term, df, raw_idf, idf) that are written already."""
    size = docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    mean = idf.agg(F.avg("raw_idf").alias("average_idf"), F.count("*").alias("vocabulary"))
    return Index(tf, written(idf), written(size.crossJoin(mean), 1), docs, k1, b)


def query_terms(queries: DataFrame, tokenizer: str = "regex") -> DataFrame:
    """qid, term, pos of first occurrence, qf."""
    return queries.select("qid", F.posexplode(tokens("text", tokenizer)).alias("pos", "term")).groupBy("qid", "term").agg(F.min("pos").alias("pos"), F.count("*").alias("qf"))


def few(rows: DataFrame) -> DataFrame:
    """For a join with all postings, which then stay where they are: rows to be broadcast, if there are few. They are counted first; more meet by shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Places, in corpus order, of what can be among the first k: as good as the kth at 9 decimals, but of equal scores the first k only."""
    if len(score) <= k:
        return np.arange(len(score))
    near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - GRAIN)
    near = near[np.argsort(-score[near], kind="stable")]
    at = np.arange(len(near))
    begins = np.maximum.accumulate(np.where(np.diff(score[near], prepend=np.inf) != 0, at, 0))
    return np.sort(near[at - begins < k])


def _scorer(avgdl: float, k1: float, b: float, k: int | None):
    """Scores of one group: postings (ordinal, dl, term, tf) and query terms (qid, pos, term, weight), terms by number; a row a query, its documents in arrays."""

    def run(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("term", kind="stable")
        docs, place = np.unique(held["ordinal"].to_numpy(), return_inverse=True)
        tf, term = held["tf"].to_numpy(), held["term"].to_numpy()
        over, under = tf * (k1 + 1), tf + k1 * (1 - b + b * held["dl"].to_numpy() / avgdl)
        out = []
        for qid, own in asked.sort_values(["qid", "pos"]).groupby("qid", sort=False):
            score, met = np.zeros(len(docs)), np.zeros(len(docs), bool)
            for t, weight in zip(own["term"], own["weight"], strict=True):
                at = slice(*np.searchsorted(term, [t, t + 1]))
                # a document has a term once, so no place is there twice
                score[place[at]] += weight * over[at] / under[at]
                met[place[at]] = True
            found = np.flatnonzero(met)
            found = found if k is None else found[_first(score[found], k)]
            if len(found):
                out.append((qid, docs[found], score[found]))
        return pd.DataFrame(out, columns=["qid", "ordinal", "score"])

    return run


def _scored(index: Index, queries: DataFrame, tokenizer: str, k: int | None = None) -> DataFrame:
    """qid, ordinal, score of documents that have a query term; with k, at least those that can be among the first k of their query."""
    ship(index.tf.sparkSession)
    terms = written(query_terms(queries, tokenizer).join(index.idf.select("term", "df", "idf"), "term").select("qid", "pos", "term", "df", (F.col("idf") * F.col("qf")).alias("weight")))
    names = written(with_ordinals(terms.select("term", "df").distinct(), "term").withColumnRenamed("ordinal", "number"))
    asked = written(with_ordinals(terms.select("qid").distinct(), "qid").select("qid", F.floor(F.col("ordinal") / BLOCK).cast("int").alias("block")))
    avgdl = index.stats.first()["avgdl"]
    shards = max(1, -(-(names.agg(F.sum("df")).first()[0] or 0) // (POSTINGS if k else FEW)))
    blocks = (asked.agg(F.max("block")).first()[0] or 0) + 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    known = names.select("term", "number")
    held = index.tf.join(few(known), "term").select(F.pmod(F.xxhash64("ordinal"), F.lit(shards)).cast("int").alias("shard"), "ordinal", "dl", F.col("number").alias("term"), "tf")
    held = held.select(each(blocks).alias("block"), *held.columns)
    wanted = terms.join(known, "term").join(asked, "qid").select(each(shards).alias("shard"), "block", "qid", "pos", F.col("number").alias("term"), "weight")
    # a number of partitions, or the few rows, which are much work, would be put together in few tasks
    tasks = min(shards * blocks, TASKS)
    groups = (df.repartition(tasks, "shard", "block").groupBy("shard", "block") for df in (held, wanted))
    rows = next(groups).cogroup(next(groups)).applyInPandas(_scorer(avgdl, index.k1, index.b, k), "qid string, ordinal array<long>, score array<double>")
    return rows.select("qid", F.inline(F.arrays_zip("ordinal", "score")))


def scores(index: Index, queries: DataFrame, tokenizer: str = "regex") -> DataFrame:
    """qid, ordinal, score of documents that have a query term."""
    return _scored(index, queries, tokenizer)


def _checked(k: int, tie_break: str) -> None:
    if tie_break not in TIE_BREAKS:
        raise ValueError(f"ties go by {' or '.join(TIE_BREAKS)}, not by {tie_break!r}")
    if k <= 0:
        raise ValueError("k must be positive")


def _order():
    # scores are compared at 9 decimals, so that the last bit of a sum does not break a tie
    return Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "ordinal")


def unscored(scored: DataFrame, asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """qid, ordinal: the first k documents in corpus order that scored does not have, of the queries asked.

    Documents are numbered in order; a query's gaps between scored numbers are where the
    others are, and only the first of them are opened.
    """
    places = written(with_ordinals(docs.select(F.col("ordinal").alias("doc")), "doc").withColumnRenamed("ordinal", "place"))
    total = places.count()
    taken = scored.join(asked.select("qid"), "qid", "left_semi").join(places, F.col("ordinal") == F.col("doc")).select("qid", "place")
    taken = taken.unionByName(asked.select("qid", F.lit(total).cast("long").alias("place")))
    order = Window.partitionBy("qid").orderBy("place")
    gaps = taken.select("qid", "place", (F.row_number().over(order) - 1).alias("before"), (F.lag("place", 1, -1).over(order) + 1).alias("low"))
    # low - before others are in earlier gaps
    high = F.least(F.col("place"), F.col("before") + k) - 1
    open_ = gaps.withColumn("high", high).where("low <= high")
    return open_.select("qid", F.explode(F.sequence("low", "high")).alias("place")).join(places, "place").select("qid", F.col("doc").alias("ordinal"))


def top_k(scored: DataFrame, queries: DataFrame, docs: DataFrame, k: int, tie_break: str = "corpus_ordinal") -> DataFrame:
    """qid, ordinal, score, rank: score descending, then corpus order; unscored documents count as 0.

    scored is read more than once; write it first if it is dear.
    """
    _checked(k, tie_break)
    best = scored.withColumn("rank", F.row_number().over(_order())).where(F.col("rank") <= k)
    fine = best.groupBy("qid").agg(F.count_if(F.col("score") >= 0).alias("fine"))
    short = queries.select("qid").join(fine.where(F.col("fine") >= k), "qid", "left_anti")
    if short.isEmpty():
        return best
    short = written(short)
    fill = unscored(scored, short, docs, k).withColumn("score", F.lit(0.0))
    out = best.select("qid", "ordinal", "score").unionByName(fill)
    return out.withColumn("rank", F.row_number().over(_order())).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int, tokenizer: str = "regex", tie_break: str = "corpus_ordinal") -> DataFrame:
    """The top_k of scores, from the first k of every shard of the corpus."""
    _checked(k, tie_break)
    if (index.idf.agg(F.min("idf")).first()[0] or 0) < 0:  # in a tiny corpus a common term can count against a document
        return top_k(written(scores(index, queries, tokenizer)), queries, index.docs, k, tie_break)
    return top_k(written(_scored(index, queries, tokenizer, k)), queries, index.docs, k, tie_break)
