"""Report tables over per-query metrics, and comparisons of two result sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import close


def micro_coverage(metrics: DataFrame, method: str) -> DataFrame:
    """covered, total, coverage: gold documents that the method's candidates hold, over all queries."""
    covered = F.sum(F.round(F.col("gold_size") * F.col("candidate_recall")).cast("long"))
    return metrics.where(F.col("method") == method).agg(covered.alias("covered"), F.sum("gold_size").alias("total"), (covered / F.sum("gold_size")).alias("coverage"))


def model_means(metrics: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return metrics.groupBy("method").agg(*(F.avg(m).alias(m) for m in names))


def template_view(metrics: DataFrame, baseline: str, treatment: str, metric: str = "ndcg_at_20") -> DataFrame:
    """template, means of both methods and their difference."""
    rows = metrics.where(F.col("method").isin(baseline, treatment)).groupBy("template").pivot("method", [baseline, treatment]).agg(F.avg(metric))
    return rows.select("template", F.col(f"`{baseline}`").alias("baseline"), F.col(f"`{treatment}`").alias("treatment"), (F.col(f"`{treatment}`") - F.col(f"`{baseline}`")).alias("delta"))


def negation_share(metrics: DataFrame, baseline: str, treatment: str, negated: tuple[str, ...], metric: str = "ndcg_at_20") -> DataFrame:
    """share of the net gain that comes from the negated templates."""
    wide = metrics.where(F.col("method").isin(baseline, treatment)).groupBy("qid", "template").agg(F.sum(F.when(F.col("method") == treatment, F.col(metric)).otherwise(-F.col(metric))).alias("delta"))
    gain = F.sum("delta")
    part = F.sum(F.when(F.col("template").isin(*negated), F.col("delta")).otherwise(0.0))
    return wide.agg(part.alias("negated_gain"), gain.alias("gain"), F.try_divide(part, gain).alias("share"))


def gap_closed(means: DataFrame, baseline: str, treatment: str, best: str, names: tuple[str, ...]) -> DataFrame:
    """metric, share of the distance from baseline to best that the treatment covers."""
    long = means.select("method", F.expr(f"stack({len(names)}, {', '.join(f"'{m}', {m}" for m in names)}) as (metric, value)"))
    wide = long.groupBy("metric").agg(*(F.max(F.when(F.col("method") == m, F.col("value"))).alias(k) for k, m in (("b", baseline), ("t", treatment), ("e", best))))
    return wide.select("metric", F.try_divide(F.col("t") - F.col("b"), F.col("e") - F.col("b")).alias("closed"))


def result_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column, left, right of every difference: keys on one side only, numbers beyond 1e-12, other values not equal."""
    if set(left.columns) != set(right.columns):
        raise ValueError("the two result sets have different columns")
    values = [c for c in left.columns if c not in keys]
    numeric = {c for c, t in left.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")}
    a = left.select(*keys, F.struct(*values).alias("a"))
    b = right.select(*keys, F.struct(*values).alias("b"))
    both = a.join(b, keys, "full_outer")

    def differs(c: str):
        x, y = F.col("a")[c], F.col("b")[c]
        if c not in numeric:
            return ~x.eqNullSafe(y)
        bad = lambda v: F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))
        return ~(x.isNull() & y.isNull()) & F.coalesce(~close(x.cast("double"), y.cast("double")) | bad(x) | bad(y), F.lit(True))

    found = F.array_compact(F.array(*(F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & differs(c), F.struct(F.lit(c).alias("column"), F.col("a")[c].cast("string").alias("left_value"), F.col("b")[c].cast("string").alias("right_value"))) for c in values)))
    missing = F.when(F.col("a").isNull(), F.lit("right_only")).when(F.col("b").isNull(), F.lit("left_only"))
    null = F.lit(None).cast("string")
    one_side = both.where(missing.isNotNull()).select(*keys, missing.alias("column"), null.alias("left_value"), null.alias("right_value"))
    return both.select(*keys, F.explode(found).alias("d")).select(*keys, "d.*").unionByName(one_side)
