"""Per-query metrics, grouped summaries, error decomposition and paired deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gold_size_bin
from ..plans.templates import templates

METRICS = ("recall_at_5", "recall_at_20", "recall_at_100", "norm_recall_at_100", "ndcg_at_5", "ndcg_at_20", "ndcg_at_100", "candidate_precision", "candidate_recall", "candidate_f1", "candidate_jaccard")
SIZES = ("retrieved_size", "candidate_size")
KEYS = ("method", "qid", "template", "n_atoms", "gold_size", "gold_size_bin")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _ideal(k: int) -> Column:
    """DCG of an ideal ranking of the query's gold documents cut at k."""
    n = F.least(F.col("gold_size"), F.lit(k)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))


def described(queries: DataFrame, qrels: DataFrame, distinct: bool = False) -> DataFrame:
    """qid, template, n_atoms, gold_size, gold_size_bin; queries without gold are an error of the caller's and are left out.

    distinct: qrels has no row twice, so its rows are counted where they are.
    """
    gold = qrels.groupBy("qid").agg((F.count("ordinal") if distinct else F.count_distinct("ordinal")).alias("gold_size"))
    return queries.select("qid", "template", F.size("attrs").alias("n_atoms")).join(gold, "qid").withColumn("gold_size_bin", gold_size_bin("gold_size"))


def _each(results: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """rows once for every method of results. Methods are named in code and few, however many queries there are; they are what is broadcast."""
    return rows.crossJoin(F.broadcast(results.select(*(keys or ["method"])).distinct()))


def _marked(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """method, qid, ordinal, first, hit: each document of a ranking once, at its first rank. Rankings and gold meet by document; nothing else of their size is shuffled."""
    # marked after they are made distinct: a mark among the keys would have them shuffled again for the join
    gold = qrels.select("qid", "ordinal").distinct().withColumn("hit", F.lit(True))
    return results.join(gold, ["qid", "ordinal"], "left").groupBy("method", "qid", "ordinal").agg(F.min("rank").alias("first"), F.coalesce(F.max("hit"), F.lit(False)).alias("hit"))


def _top(marked: DataFrame, k: int) -> DataFrame:
    """method, qid, rank, hit of the first k documents of every ranking, ranks renumbered; documents without a rank are none of them."""
    place = F.row_number().over(Window.partitionBy("method", "qid").orderBy("first", "ordinal"))
    return marked.where("first is not null").select("method", "qid", place.alias("rank"), "hit").where(F.col("rank") <= k)


def outside(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """method, qid, ordinal of ranked documents that are no candidates of their query."""
    return results.where("rank is not null").select("method", "qid", "ordinal").join(candidates.select("qid", "ordinal"), ["qid", "ordinal"], "left_anti").select("method", "qid", "ordinal")


def evaluate(results: DataFrame, queries: DataFrame, qrels: DataFrame, candidates: DataFrame | None = None, about: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame:
    """KEYS, METRICS and SIZES of every method and query; results is (method, qid, ordinal, rank).

    Driven by all queries, so a query for which a method finds nothing has zeros. A
    document that a ranking repeats counts at its first rank. candidates: (qid, ordinal)
    that all methods chose from, if the rows of results are not all their candidates; a
    ranked document outside them is an error. about: described of the queries and all
    their gold, if it is at hand; qrels need then have only the gold that results and
    candidates can have. counted: (qid, found, candidate_size) of the gold among the
    candidates and of all of them, where they are too many to be given.
    """
    base = _each(results, described(queries, qrels) if about is None else about)
    marked = _marked(results, qrels)
    hit, rank = F.col("hit"), F.col("rank")
    gain = F.when(hit, 1 / F.log2(rank + 1))
    best = _top(marked, 100).groupBy("method", "qid").agg(
        *(F.count_if(hit & (rank <= k)).alias(f"hits_{k}") for k in (5, 20, 100)),
        *(F.aggregate(F.array_sort(F.collect_list(F.when(rank <= k, F.struct(rank.alias("r"), gain.alias("g"))))), F.lit(0.0), lambda a, z: a + F.coalesce(z["g"], F.lit(0.0))).alias(f"dcg_{k}") for k in (5, 20, 100)),
    )
    sums = marked.groupBy("method", "qid").agg(F.count_if(hit).alias("found"), F.count("*").alias("candidate_size"), F.count("first").alias("retrieved_size"))
    if candidates is not None:
        if not outside(results, candidates).isEmpty():
            raise ValueError("a ranking has documents outside the candidates")
        whole = candidates.select("qid", "ordinal").distinct().join(qrels.select("qid", "ordinal", F.lit(1).alias("gold")).distinct(), ["qid", "ordinal"], "left")
        counted = whole.groupBy("qid").agg(F.count("gold").alias("found"), F.count("*").alias("candidate_size"))
    if counted is not None:
        # of the query, not of the method: a method that ranks nothing had the same candidates
        base = base.join(counted, "qid", "left")
        sums = sums.drop("found", "candidate_size")
    rows = base.join(sums, ["method", "qid"], "left").join(best, ["method", "qid"], "left").na.fill(0)
    gold, found, size = F.col("gold_size"), F.col("found"), F.col("candidate_size")
    precision, recall = _ratio(found, size), found / gold
    return rows.select(
        *KEYS,
        *((F.col(f"hits_{k}") / gold).alias(f"recall_at_{k}") for k in (5, 20, 100)),
        (F.col("hits_100") / F.least(gold, F.lit(100))).alias("norm_recall_at_100"),
        *((F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / _ideal(k)).alias(f"ndcg_at_{k}") for k in (5, 20, 100)),
        precision.alias("candidate_precision"), recall.alias("candidate_recall"), _ratio(2 * precision * recall, precision + recall).alias("candidate_f1"), (found / (gold + size - found)).alias("candidate_jaccard"),
        *SIZES,
    )


def budgets(metrics: DataFrame, pool_k: int, final_k: int) -> DataFrame:
    """method, qid and what the method was given: its depth and cutoff, its pool, its lists, and their nominal sizes; null where it has none."""
    depth = F.expr("try_cast(nullif(regexp_extract(method, '_L([0-9]+)$', 1), '') as int)")
    family = F.regexp_replace("method", "_L[0-9]+$", "")
    rows = metrics.select("method", "qid", "template", "n_atoms").join(F.broadcast(templates(metrics.sparkSession).select("template", "has_negative")), "template")
    rows = rows.withColumn("family", family).withColumn("atomic_depth", depth)
    composed, hybrid = F.col("family").isin("compose_exact_not", "compose_truncated_not", "union_verify"), F.col("family") == "hybrid_verify"
    positive = F.col("n_atoms") - F.col("has_negative").cast("int")
    pooled = F.col("family").isin("full_verify", "hybrid_verify")
    return rows.select(
        "method", "qid", "atomic_depth", F.lit(final_k).alias("final_k"), F.when(F.col("family") == "bm25", F.lit(pool_k)).alias("pool_k"), F.when(pooled, F.lit(pool_k)).alias("full_query_pool"),
        F.when(composed, F.col("n_atoms")).when(hybrid, positive).alias("atomic_lists"), F.when(composed, F.col("n_atoms") * F.col("atomic_depth")).alias("nominal_atomic_budget"),
        F.when(F.col("family") == "full_verify", F.lit(pool_k)).when(hybrid, F.lit(pool_k) + positive * F.col("atomic_depth")).alias("nominal_candidate_budget"),
    )


def summarise(metrics: DataFrame) -> DataFrame:
    """Means over queries: overall, by template and by gold size, in one pass of grouping sets."""
    sets = [["method"], ["method", "template"], ["method", "gold_size_bin"]]
    out = metrics.groupingSets(sets, "method", "template", "gold_size_bin").agg(F.grouping("template").alias("gt"), F.grouping("gold_size_bin").alias("gb"), F.count("*").alias("n_queries"), *(F.avg(m).alias(m) for m in (*METRICS, *SIZES)))
    kind = F.when((F.col("gt") == 1) & (F.col("gb") == 1), "overall").when(F.col("gt") == 0, "template").otherwise("gold_size_bin")
    return out.select("method", kind.alias("group_type"), F.coalesce("template", "gold_size_bin", F.lit("all")).alias("group_value"), "n_queries", *METRICS, *SIZES)


def ranking_errors(results: DataFrame, queries: DataFrame, qrels: DataFrame, k: int, candidates: DataFrame | None = None, about: DataFrame | None = None) -> DataFrame:
    """Where gold documents are lost: not a candidate; ranked too low though there was room; no room at k. The three sum to the misses.

    A document that a ranking repeats counts at its first rank. candidates and about: as
    in evaluate; a ranked document outside the candidates is an error.
    """
    if candidates is not None and not outside(results, candidates).isEmpty():
        raise ValueError("a ranking has documents outside the candidates")
    base = _each(results, described(queries, qrels) if about is None else about)
    marked = _marked(results, qrels)
    hits = _top(marked, k).groupBy("method", "qid").agg(F.count_if("hit").alias("hits"))
    if candidates is None:
        keys, inside = ["method", "qid"], marked.groupBy("method", "qid").agg(F.count_if("hit").alias("inside"))
    else:
        keys, inside = ["qid"], candidates.select("qid", "ordinal").distinct().join(qrels.select("qid", "ordinal"), ["qid", "ordinal"], "left_semi").groupBy("qid").agg(F.count("*").alias("inside"))
    rows = base.join(inside, keys, "left").join(hits, ["method", "qid"], "left").na.fill(0)
    room = F.least(F.lit(k), F.col("inside"))
    return rows.select("method", "qid", "template", "gold_size", (F.col("gold_size") - F.col("hits")).alias("total_misses"), (F.col("gold_size") - F.col("inside")).alias("candidate_miss"), (room - F.col("hits")).alias("avoidable_ranking_miss"), (F.col("inside") - room).alias("structural_cutoff_miss"))


def composition_errors(results: DataFrame, atoms: DataFrame, lists: DataFrame, queries: DataFrame, qrels: DataFrame, any_list: bool) -> DataFrame:
    """Candidate misses split: no list (any_list), or too few lists for the operator, had the document; or composition or exclusion lost it."""
    from .boolean import survives

    lost = _each(results, qrels.select("qid", "ordinal"), "method", "depth").join(results.select("method", "depth", "qid", "ordinal"), ["method", "depth", "qid", "ordinal"], "left_anti")
    shape = atoms.groupBy("qid").agg(F.max("positive_operator").alias("positive_operator"), F.max("n_positive").alias("n_positive"))
    hits = atoms.where("not is_negative").join(lists, "attr").groupBy("depth", "qid", "ordinal").agg(F.count_distinct("pos").alias("hits"))
    seen = lost.join(hits, ["depth", "qid", "ordinal"], "left").na.fill(0, ["hits"]).join(shape, "qid")
    alive = F.col("hits") >= 1 if any_list else survives()
    split = seen.groupBy("method", "depth", "qid").agg(F.count_if(~alive).alias("atomic_miss"), F.count_if(alive).alias("composition_or_exclusion_miss"))
    base = _each(results, described(queries, qrels).select("qid", "template", "gold_size"), "method", "depth")
    return base.join(split, ["method", "depth", "qid"], "left").na.fill(0, ["atomic_miss", "composition_or_exclusion_miss"]).select("method", "qid", "template", "gold_size", F.lit(0).cast("long").alias("parse_or_oracle_mismatch"), "atomic_miss", "composition_or_exclusion_miss")


def paired_deltas(metrics: DataFrame, baseline: str, names: tuple[str, ...]) -> DataFrame:
    """qid, template, treatment, metric, delta of every other method against the baseline, on the same queries."""
    long = metrics.select("method", "qid", "template", F.expr(f"stack({len(names)}, {', '.join(f"'{m}', {m}" for m in names)}) as (metric, value)"))
    base = long.where(F.col("method") == baseline).select("qid", "metric", F.col("value").alias("base"))
    return long.where(F.col("method") != baseline).join(base, ["qid", "metric"]).select("qid", "template", F.col("method").alias("treatment"), "metric", (F.col("value") - F.col("base")).alias("delta"))
