"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Targets: a source gets its weight's share of the budget, but no more than ``epochs``
times its size; what a clamped source cannot take is shared again by weight among
the others. Sorted by size per weight, the clamped sources are a prefix, so one
pass with running sums gives the level at which the rest is feasible.

Sampling: a source's documents are taken whole as often as its target allows; the
rest of the target is one more, fractional repetition, for which documents come in
the order of a seeded hash until the words are reached; the last may give a part
of its words. Only sums per source and hash bucket are ordered, and then the one
bucket in which a source's target ends, so a source with most of the rows is spread
over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, documents, prepare

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, 20240601
#: Sources whose plan may be broadcast (about 10 MB); the rows are joined by shuffle if there are more.
SOURCES = 100_000


def targets(sized: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """source, source_size, target of the sources of (source, size); one row a source, null included.

    The sources are ordered in one task, by code point and by size per weight: a row of
    four numbers and a name each, made for millions of sources, not for one a document.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by) - 1) % len(weights) + 1).cast("int")).cast("double")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w).withColumn("cap", F.col("source_size") * float(epochs))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = sources.withColumn("level", level).withColumn("clamped", F.col("cap") <= F.col("level") * F.col("w"))
    # the level of the first source that is not clamped holds for all after it
    final = F.min(F.when(~F.col("clamped"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("source").isNull().alias("z"), "source", "level"))).over(whole)["level"]
    return ranked.withColumn("final", final).select("source", "source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("w") * F.col("final")).alias("target"))


def plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Of (source, size, key): source, source_size, target, whole repetitions, and where the fractional one ends.

    Documents whose key is below ``last`` are in the fractional repetition whole; those
    whose key equals it give ``part`` of their ``part_of`` words.
    """
    goals = targets(sized, weights, share, epochs)
    goal = F.floor(F.col("target") + 0.5)
    goals = cut(goals.withColumn("whole", F.coalesce(F.floor(F.try_divide(goal, F.col("source_size"))), F.lit(0))).withColumn("need", (goal - F.col("whole") * F.col("source_size")).cast("long")))
    bucket = F.substring("key", 1, 3)
    same = F.col("source").eqNullSafe(F.col("s"))
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    ends = sums.withColumn("before", upto - F.col("words")).join(goals.select(F.col("source").alias("s"), "need"), same).where("before <= need and need < before + words").select("s", "bucket", "before", "need")
    inside = sized.withColumn("b", bucket).join(ends, same & (F.col("b") == F.col("bucket"))).groupBy("source", "key", "before", "need").agg(F.sum("size").alias("words"))
    run = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("key")) - F.col("words")
    last = inside.withColumn("run", run).where("run <= need and need < run + words").select(F.col("source").alias("s"), F.col("key").alias("last"), (F.col("need") - F.col("run")).alias("part"), F.col("words").alias("part_of"))
    return goals.join(last, same, "left").drop("s", "need")


def key(doc_id: str = "doc_id", seed: int = SEED):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def size(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _taken(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows (with source, size, key) and source_size, target, whole, extra: words of the fractional repetition."""
    names = {c: f"_{c}" for c in ("source_size", "target", "whole", "last", "part", "part_of")}
    found = goals.select(F.col("source").alias("_s"), *(F.col(c).alias(v) for c, v in names.items()))
    # the rows of a source must not meet in one task: sources are few and broadcast, unless counting says otherwise
    found = F.broadcast(found) if goals.count() <= SOURCES else found
    extra = F.when(F.col("key") < F.col("_last"), F.col("size")).when(F.col("key") == F.col("_last"), F.floor(F.col("_part") * F.col("size") / F.col("_part_of"))).otherwise(F.lit(0))
    return rows.join(found, F.col("source").eqNullSafe(F.col("_s"))).select(*rows.columns, F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_whole").alias("whole"), extra.cast("long").alias("extra"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    A null text has size 0; null is a source of its own, the last. Rows that share a
    doc_id and source share a place in the sampling order and are taken alike. Where
    all sizes are 0, targets are 0 and nothing is taken. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    sized = cut(documents(docs, F.col("source").cast("string").alias("source")).select("doc_id", "source", size().alias("size"), key(seed=seed).alias("key")))
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken")
    return _taken(sized, cut(plan(sized, weights, share, epochs), 1)).select("doc_id", "size", "source_size", "target", taken)


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: docs' rows as often as it takes them, all columns kept.

    The one partial repetition that ends a source's share has the first words of its
    text, joined by one space, and n_chars to match if docs has that column. Texts
    without words come along with the whole repetitions.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    sized = cut(docs.select(F.col("source").cast("string").alias("source"), size().alias("size"), key(seed=seed).alias("key")))
    goals = cut(plan(sized, weights, share, epochs), 1)
    rows = docs.select(F.struct(*names).alias("row"), F.col("source").cast("string").alias("source"), size().alias("size"), key(seed=seed).alias("key"))
    rows = _taken(rows, goals)
    copies = (F.col("whole") + (F.col("extra") == F.col("size")).cast("int") * (F.col("size") > 0).cast("int")).cast("int")
    whole = rows.withColumn("k", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")
    head = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), 1, F.col("extra").cast("int")), " ")
    part = rows.where("extra > 0 and extra < size").withColumn("head", head)
    cut_to = {"text": F.col("head"), "n_chars": F.length("head").cast("long")}
    part = part.select(*((cut_to[c] if c in cut_to else F.col("row")[c]).alias(c) for c in names))
    return whole.unionByName(part)


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM sized GROUP BY source
), levels AS (
  SELECT source, source_size, w, 2.0::DOUBLE * source_size AS cap,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), goals AS (
  SELECT source, source_size, CASE WHEN cap <= level * w THEN cap ELSE w * (SELECT arg_min(level, cap / w) FROM levels WHERE cap > level * w) END AS target FROM levels
), rows_ AS (
  SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS goal,
    (sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE goal // source_size * size + greatest(0, least(size, goal % source_size - before)) END)::BIGINT AS taken
FROM rows_
"""
