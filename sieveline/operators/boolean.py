"""Exact execution of Boolean plans over facts (ordinal, attr)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .bm25 import BROADCAST, few


def survives() -> Column:
    """Whether hits positives satisfy the plan's operator."""
    return F.when(F.col("positive_operator") == "and", F.col("hits") == F.col("n_positive")).otherwise(F.col("hits") >= 1)


def execute(atoms: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, ordinal) of every document that satisfies its plan: one join and one grouping for all templates.

    Facts are dealt by document before they meet the plans, if these are few: what a
    document meets is then grouped where it is, and only facts are shuffled. atoms is
    read more than once.
    """
    own = facts.select("attr", "ordinal")
    if atoms.count() <= BROADCAST:
        # a number of partitions, or the few facts, which meet many plans, would be put together in few tasks
        dealt = own.repartition(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ordinal")
        met = dealt.join(F.broadcast(atoms), "attr")
    else:
        met = atoms.join(own, "attr")
    by = met.groupBy("qid", "ordinal").agg(
        F.bool_or("is_negative").alias("negated"), F.count_distinct(F.when(~F.col("is_negative"), F.col("pos"))).alias("hits"),
        F.max("positive_operator").alias("positive_operator"), F.max("n_positive").alias("n_positive"),
    )
    return by.where(~F.col("negated")).where(survives()).select("qid", "ordinal")


def _posting(plans: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    return plans.select("qid", F.get("attrs", F.lit(k)).alias("attr")).join(facts, "attr").select("qid", "ordinal").distinct()


def atom(plans, facts):
    return _posting(plans, facts, 0)


def union(plans, facts, arity):
    out = _posting(plans, facts, 0)
    for k in range(1, arity):
        out = out.union(_posting(plans, facts, k))
    return out.distinct()


def intersection(plans, facts, arity):
    out = _posting(plans, facts, 0)
    for k in range(1, arity):
        out = out.join(_posting(plans, facts, k), ["qid", "ordinal"], "left_semi")
    return out


def difference(plans, facts, arity):
    """The intersection of all but the last posting, without the last."""
    return intersection(plans, facts, arity - 1).join(_posting(plans, facts, arity - 1), ["qid", "ordinal"], "left_anti")


def oracle_ranking(exact: DataFrame, final_k: int) -> DataFrame:
    """qid, ordinal, rank: exact sets, no document twice, in corpus order; rank is null beyond final_k.

    Only the first final_k of each set are sorted; the others are those after its last.
    """
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("ordinal"))
    first = written(exact.select("qid", "ordinal", rank.alias("rank")).where(F.col("rank") <= final_k))
    last = few(first.groupBy("qid").agg(F.max("ordinal").alias("last")))
    beyond = exact.join(last, "qid").where("ordinal > last").select("qid", "ordinal", F.lit(None).cast("int").alias("rank"))
    return first.unionByName(beyond)
