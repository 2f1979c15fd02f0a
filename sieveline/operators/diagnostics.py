"""Quality of the atomic lists: per attribute and depth, and per depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attribute_usage(atoms: DataFrame) -> DataFrame:
    """attr, total, positive and negative occurrences in plans."""
    return atoms.groupBy("attr").agg(F.count("*").alias("total_occurrences"), F.count_if(~F.col("is_negative")).alias("positive_occurrences"), F.count_if("is_negative").alias("negative_occurrences"))


def atomic_diagnostics(atoms: DataFrame, lists: DataFrame, facts: DataFrame, depths: list[int]) -> DataFrame:
    """One row for each used attribute and depth; ranks are null if no relevant document is in the prefix."""
    usage = attribute_usage(atoms)
    posting = facts.groupBy("attr").agg(F.count_distinct("ordinal").alias("posting_size"))
    marked = lists.join(facts.select("attr", "ordinal", F.lit(True).alias("hit")).distinct(), ["attr", "ordinal"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    found = marked.groupBy("attr", "depth").agg(
        F.count("*").alias("retrieved_size"), F.count_if("hit").alias("relevant_retrieved"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_relevant_rank"), F.max(F.when(F.col("hit"), F.col("rank"))).alias("last_relevant_rank"), F.avg(F.when(F.col("hit"), F.col("rank"))).alias("mean_relevant_rank"),
    )
    base = usage.join(posting, "attr", "left").withColumn("depth", F.explode(F.array(*map(F.lit, sorted(set(depths))))))
    rows = base.join(found, ["attr", "depth"], "left").na.fill(0, ["posting_size", "retrieved_size", "relevant_retrieved"])
    room, hits, size = F.least("retrieved_size", "posting_size"), F.col("relevant_retrieved"), F.col("posting_size")
    per = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return rows.select(
        "attr", "depth", "total_occurrences", "positive_occurrences", "negative_occurrences", "posting_size", "retrieved_size", "relevant_retrieved",
        per(hits, size).alias("recall"), per(hits, F.col("retrieved_size")).alias("precision"), per(room, size).alias("structural_ceiling"), per(hits, room).alias("ceiling_normalised_recall"),
        (size - room).alias("structural_misses"), (room - hits).alias("avoidable_misses"), "first_relevant_rank", "last_relevant_rank", "mean_relevant_rank",
        F.coalesce(1 / F.col("first_relevant_rank"), F.lit(0.0)).alias("reciprocal_rank"), (hits == size).alias("full_coverage"),
    )


def atomic_summary(diagnostics: DataFrame) -> DataFrame:
    """One row for each depth: size quantiles, recalls weighted by posting, evenly, and by use; 0 where weights sum to 0."""
    per = lambda a, b: F.when(F.sum(b) == 0, F.lit(0.0)).otherwise(F.sum(a) / F.sum(b))
    recall = F.col("recall")
    hit = F.when(F.col("relevant_retrieved") > 0, F.col("first_relevant_rank"))
    return diagnostics.groupBy("depth").agg(
        F.count("*").alias("unique_attrs"), F.avg("posting_size").alias("posting_size_mean"), F.percentile("posting_size", F.lit(0.5)).alias("posting_size_median"), F.percentile("posting_size", F.lit(0.9)).alias("posting_size_p90"),
        per(F.col("relevant_retrieved"), F.col("posting_size")).alias("posting_weighted_recall"), per(F.col("relevant_retrieved"), F.least("retrieved_size", "posting_size")).alias("posting_weighted_normalised_recall"), F.avg("recall").alias("macro_recall"),
        per(recall * F.col("positive_occurrences"), F.col("positive_occurrences")).alias("positive_weighted_recall"), per(recall * F.col("negative_occurrences"), F.col("negative_occurrences")).alias("negative_weighted_recall"),
        F.count_if(F.col("relevant_retrieved") == 0).alias("zero_hit_attrs"), F.count_if("full_coverage").alias("full_coverage_attrs"), F.avg(hit).alias("first_rank_mean"), F.percentile(hit, F.lit(0.5)).alias("first_rank_median"),
    )
