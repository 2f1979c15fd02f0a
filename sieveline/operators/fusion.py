"""Candidate sets from ranked lists: hard composition, union-verify, full verify, hybrid verify.

A result is (depth, qid, ordinal, rank): every row is a candidate, rank is null
beyond final_k. atomic is (attr, ordinal, rank), pool is (qid, ordinal, rank).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .bm25 import few, ordered_sum
from .boolean import survives

RRF = 60


def atomic_queries(atoms: DataFrame) -> DataFrame:
    """One ranking query for each distinct attribute, negative ones included."""
    return atoms.select(F.col("attr").alias("qid"), F.concat(F.lit("Who likes "), "attr", F.lit("?")).alias("text")).distinct()


def prefixes(atomic: DataFrame, depths: Sequence[int]) -> DataFrame:
    """depth, attr, ordinal, rank: the lists cut at each depth, from one search at the largest."""
    if not depths or min(depths) <= 0:
        raise ValueError("depths must be positive")
    cuts = F.explode(F.array(*(F.lit(d) for d in sorted(set(depths)))))
    return atomic.select("attr", "ordinal", "rank", cuts.alias("depth")).where("rank <= depth")


def _ranked(found: DataFrame, final_k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("depth", "qid").orderBy(F.round("rrf", 12).desc(), "ordinal"))
    return found.withColumn("place", rank).select("depth", "qid", "ordinal", F.when(F.col("place") <= final_k, F.col("place")).alias("rank"), "rrf")


def _met(atoms: DataFrame, lists: DataFrame) -> DataFrame:
    part = F.lit(1.0) / (F.lit(RRF) + F.col("rank"))
    return (
        atoms.join(lists, "attr")
        .groupBy("depth", "qid", "ordinal")
        .agg(
            F.bool_or("is_negative").alias("negated"), F.count_distinct(F.when(~F.col("is_negative"), F.col("pos"))).alias("hits"),
            F.max("positive_operator").alias("positive_operator"), F.max("n_positive").alias("n_positive"),
            ordered_sum("pos", F.when(~F.col("is_negative"), part).otherwise(F.lit(0.0))).alias("rrf"),
        )
        .where("hits > 0")
    )


def compose_exact_not(atoms: DataFrame, lists: DataFrame, facts: DataFrame, final_k: int) -> DataFrame:
    """The plan over truncated positive lists, without the exact posting of the negated attribute.

    Facts meet only what the lists have, so of postings no more is shuffled than that, whatever the corpus.
    """
    met = written(_met(atoms, lists).where(survives()))
    barred = met.select("qid", "ordinal").distinct().join(atoms.where("is_negative").select("qid", "attr").distinct(), "qid")
    gone = facts.join(few(barred), ["attr", "ordinal"]).select("qid", "ordinal").distinct()
    return _ranked(met.join(gone, ["qid", "ordinal"], "left_anti"), final_k)


def compose_truncated_not(atoms: DataFrame, lists: DataFrame, final_k: int) -> DataFrame:
    """As above, but only the truncated negative list is excluded."""
    return _ranked(_met(atoms, lists).where(survives() & ~F.col("negated")), final_k)


def union_verify(atoms: DataFrame, lists: DataFrame, exact: DataFrame, final_k: int) -> DataFrame:
    """Any positive list's documents that satisfy the plan exactly."""
    return _ranked(_met(atoms, lists).join(exact, ["qid", "ordinal"], "left_semi"), final_k)


def full_verify(pool: DataFrame, exact: DataFrame, final_k: int) -> DataFrame:
    """The pool's documents that satisfy the plan exactly, in pool order."""
    kept = pool.join(exact, ["qid", "ordinal"], "left_semi")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return kept.withColumn("place", place).select(F.lit(None).cast("int").alias("depth"), "qid", "ordinal", F.when(F.col("place") <= final_k, F.col("place")).alias("rank"), F.lit(None).cast("double").alias("rrf"))


def hybrid_verify(atoms: DataFrame, lists: DataFrame, pool: DataFrame, exact: DataFrame, depths: Sequence[int], final_k: int) -> DataFrame:
    """Pool and positive lists together, exactly verified, fused by reciprocal ranks: pool first, then lists in plan order."""
    positive = atoms.where("not is_negative").groupBy("qid", "attr").agg(F.min("pos").alias("pos"))
    cuts = F.explode(F.array(*(F.lit(d) for d in sorted(set(depths)))))
    rows = positive.join(lists, "attr").select("depth", "qid", "ordinal", "pos", "rank").unionByName(pool.select(cuts.alias("depth"), "qid", "ordinal", F.lit(-1).alias("pos"), "rank"))
    fused = rows.join(exact, ["qid", "ordinal"], "left_semi").groupBy("depth", "qid", "ordinal").agg(ordered_sum("pos", F.lit(1.0) / (F.lit(RRF) + F.col("rank"))).alias("rrf"))
    return _ranked(fused, final_k)


def deduplicate(rankings: DataFrame) -> DataFrame:
    """Order-preserving distinct: each document at its first rank, ranks renumbered."""
    first = rankings.groupBy("qid", "ordinal").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
