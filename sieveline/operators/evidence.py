"""Cross-checks of a release: the same figures from several files must agree.

A claim is one row (scope, method, metric, source, value). Scope says what the value is
a mean over, or against which method it is a difference. Claims come from per-query
rows, from summaries and from interval tables, and are compared by grouping; nothing
but violations needs to be looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bootstrap import bootstrap
from .metrics import paired_deltas

CLAIM = ["scope", "method", "metric", "source", "value"]
TOLERANCE = 1e-12
INTERVAL = ("ci_low", "ci_high", "probability_positive")


def _long(df: DataFrame, keys: list[str], names: tuple[str, ...], source: str) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names)))
    return df.select(*keys, pairs.alias("c")).select(*keys, "c.metric", F.lit(source).alias("source"), "c.value").select(*CLAIM)


def row_claims(rows: DataFrame, names: tuple[str, ...], source: str) -> DataFrame:
    """Means of per-query rows (method, template, gold_size_bin and the metrics): overall, by template and by gold size."""
    sets = [["method"], ["method", "template"], ["method", "gold_size_bin"]]
    means = rows.groupingSets(sets, "method", "template", "gold_size_bin").agg(*(F.avg(F.col(m).cast("double")).alias(m) for m in names))
    return _long(means.withColumn("scope", F.coalesce("template", "gold_size_bin", F.lit("all"))), ["scope", "method"], names, source)


def summary_claims(rows: DataFrame, names: tuple[str, ...], source: str) -> DataFrame:
    """Values of a summary (method, group_value and the metrics)."""
    return _long(rows.withColumnRenamed("group_value", "scope"), ["scope", "method"], names, source)


def object_claims(objects: DataFrame, column: str, source: str, scope: str = "all") -> DataFrame:
    """Values of an object read as rows: column maps methods to maps of metrics."""
    by = objects.select(F.explode(column).alias("method", "m")).select("method", F.explode("m").alias("metric", "value"))
    return by.select(F.lit(scope).alias("scope"), "method", "metric", F.lit(source).alias("source"), F.col("value").cast("double").alias("value"))


def interval_claims(rows: DataFrame, source: str) -> DataFrame:
    """Values of an interval table (baseline, treatment, metric, delta and INTERVAL): the delta as a difference, the others named after their column."""
    names = ("delta", *INTERVAL)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("value")) for c in names)))
    long = rows.select(F.concat(F.lit("minus "), "baseline").alias("scope"), F.col("treatment").alias("method"), "metric", pairs.alias("p"))
    return long.select("scope", "method", F.when(F.col("p.c") == "delta", F.col("metric")).otherwise(F.concat_ws(".", "metric", "p.c")).alias("metric"), F.lit(source).alias("source"), "p.value")


def difference_claims(claims: DataFrame, baseline: str) -> DataFrame:
    """What the means of each source make of every method's difference to the baseline; the source is named after it."""
    means = claims.where("scope = 'all'")
    base = means.where(F.col("method") == baseline).select("metric", "source", F.col("value").alias("base"))
    return means.where(F.col("method") != baseline).join(base, ["metric", "source"]).select(F.lit(f"minus {baseline}").alias("scope"), "method", "metric", F.concat_ws(" ", "source", F.lit("means")).alias("source"), (F.col("value") - F.col("base")).alias("value"))


def recomputed(rows: DataFrame, stored: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """interval_claims of new bootstraps of per-query rows, each with the draws and the seed that the stored table states."""
    out = None
    asked = stored.select("baseline", F.col("bootstrap_samples").cast("long").alias("draws"), F.col("seed").cast("long").alias("seed")).distinct()
    # how many different contracts a table has is up to its writer's code, not to the data
    for baseline, draws, seed in asked.collect():
        own = stored.where((F.col("baseline") == baseline) & (F.col("seed").cast("long") == seed)).select("treatment", "metric").distinct()
        deltas = paired_deltas(rows, baseline, names).join(F.broadcast(own), ["treatment", "metric"], "left_semi")
        one = interval_claims(bootstrap(deltas, draws, seed, baseline), "recomputed")
        out = one if out is None else out.unionByName(one)
    return out


def evidence(claims: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """scope, method, metric, sources, low, high, agree: one row a figure; it agrees if all values are finite and within the tolerance of each other."""
    value = F.col("value")
    odd = F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(True))
    by = claims.groupBy("scope", "method", "metric").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count_if(odd).alias("odd"), F.min(F.when(~odd, value)).alias("low"), F.max(F.when(~odd, value)).alias("high"))
    near = F.col("high") - F.col("low") <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs("low"), F.abs("high")))
    return by.select("scope", "method", "metric", "sources", "low", "high", ((F.col("odd") == 0) & F.coalesce(near, F.lit(False))).alias("agree"))


def violations(found: DataFrame, needed: int = 1) -> DataFrame:
    """scope, method, metric, rule: figures that disagree, and those that fewer than ``needed`` sources have."""
    rules = F.explode(F.array_compact(F.array(F.when(~F.col("agree"), F.lit("disagrees")), F.when(F.size("sources") < needed, F.lit("too_few_sources")))))
    return found.select("scope", "method", "metric", rules.alias("rule"))


def misquoted(claims: DataFrame, quoted: DataFrame, digits: int = 3) -> DataFrame:
    """scope, method, metric, quoted, actual of quoted values (scope, method, metric, quoted as text) that no claim rounds to, or that some claim does not."""
    shown = F.when(F.col("value").isNotNull(), F.format_string(f"%.{digits}f", F.col("value")))
    found = quoted.join(claims, ["scope", "method", "metric"], "left")
    return found.where(F.coalesce(shown != F.col("quoted"), F.lit(True))).select("scope", "method", "metric", "quoted", shown.alias("actual")).distinct()


def shape_violations(rows: DataFrame, models: list[str], pool_k: int, per_template: int | None = None) -> DataFrame:
    """subject, rule: what per-query rows (method, qid, template, gold_size, candidate_size, candidate_recall) of one shared pool must hold.

    Every query has each model once and no other, all with the same template, gold size
    and candidate recall and with pool_k candidates; with per_template, every template
    has so many queries of every model.
    """
    same = lambda c: F.count_distinct(c) == 1
    listed = F.array(*(F.lit(m) for m in sorted(models)))
    checks = {
        "wrong_models": F.array_sort(F.collect_list("method")) == listed, "metadata_differs": same("template") & same("gold_size") & same("candidate_recall"),
        "wrong_pool": F.bool_and(F.col("candidate_size") == pool_k),
    }
    by = rows.groupBy("qid").agg(*(v.alias(k) for k, v in checks.items()))
    found = by.select(F.col("qid").alias("subject"), F.explode(F.array_compact(F.array(*(F.when(~F.coalesce(F.col(k), F.lit(False)), F.lit(k)) for k in checks)))).alias("rule"))
    if per_template is None:
        return found
    counts = rows.groupBy("template", "method").agg(F.count("*").alias("n")).where(F.col("n") != per_template)
    return found.unionByName(counts.select(F.col("template").alias("subject"), F.lit("wrong_template_count").alias("rule")).distinct())


def misnumbered(rows: DataFrame, total: int) -> DataFrame:
    """qid, rule of rows whose numbers are not exactly 0 to total - 1."""
    number = F.expr("try_cast(qid as bigint)")
    there = rows.select("qid", number.alias("n")).distinct()
    extra = there.where(F.coalesce(~F.col("n").between(0, total - 1), F.lit(True))).select("qid", F.lit("unexpected").alias("rule"))
    wanted = rows.sparkSession.range(total).select(F.col("id").alias("n"))
    return extra.unionByName(wanted.join(there.select("n"), "n", "left_anti").select(F.col("n").cast("string").alias("qid"), F.lit("missing").alias("rule")))

