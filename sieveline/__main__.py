"""Command line: audit a collection, evaluate every method over it, or check that the files of an evaluation agree."""

from __future__ import annotations

import argparse
import json
import platform
import sys
import time
from dataclasses import dataclass

import numpy
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import TOKENIZERS
from .operators import bm25, boolean, bootstrap, diagnostics, evidence, fusion, metrics
from .plans import templates
from .sources import corpus as sources
from .sources import results as finished
from .sources import files, sinks
from .sources.ordinals import with_ordinals
from .sources.tables import ship, written

HEADLINE = ("recall_at_100", "norm_recall_at_100", "ndcg_at_20")
TREATED = ("compose_exact_not", "union_verify", "full_verify", "hybrid_verify")


def _depths(text: str) -> list[int]:
    found = sorted({int(x) for x in text.split(",")})
    if not found or found[0] <= 0:
        raise argparse.ArgumentTypeError("depths must be positive")
    return found


@dataclass(frozen=True)
class Collection:
    corpus: DataFrame  # ordinal, doc_id, text
    raw: DataFrame  # query rows as read
    queries: DataFrame
    gold: DataFrame  # qid, doc_id, known or not
    qrels: DataFrame  # qid, ordinal of known gold documents
    facts: DataFrame


def load(spark: SparkSession, corpus_path: str, queries_path: str) -> Collection:
    raw = sources.jsonl(spark, corpus_path, sources.CORPUS).withColumn("_row", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")))
    corpus = written(with_ordinals(raw.select(F.col("_id").alias("doc_id"), "text", "_row"), "_row").select("ordinal", "doc_id", "text"))
    asked = written(sources.jsonl(spark, queries_path, sources.QUERIES))
    queries, gold = sources.load_queries(asked)
    queries = written(queries.withColumn("ordinal", F.expr("try_cast(qid as bigint)")))
    qrels = written(gold.join(corpus.select("doc_id", "ordinal"), "doc_id").select("qid", "ordinal").distinct())
    return Collection(corpus, asked, queries, gold, qrels, written(sources.facts(corpus)))


def checked_files(spark: SparkSession, folder: str, names: list[str], listed: str | None, verify: bool) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Checksums of the files, and (file, rule) of those that are not as listed (lines of checksum and name, as sha256sum writes them)."""
    pins = listed or f"{folder}/SHA256SUMS"
    expected = [line.split(maxsplit=1)[::-1] for line in files.read_text(spark, pins).splitlines() if line.strip()] if verify and (listed or files.exists(spark, pins)) else []
    present = [p for p in (f"{folder}/{n}" for n in sorted({*names, *(name.lstrip("*") for name, _ in expected)})) if files.exists(spark, p)]
    observed = sources.checksums(spark, present)
    broken = []
    if expected:
        wanted = spark.createDataFrame([(name.lstrip("*"), digest) for name, digest in expected], "file string, sha256 string")
        broken = [(r.file, r.rule) for r in sources.checksum_violations(observed, wanted).collect()]
    return {r.file: r.sha256 for r in observed.collect()}, broken


def audit(spark: SparkSession, found: Collection, per_template: int | None = None) -> tuple[dict, DataFrame]:
    """What the collection holds, and (what, rule) of everything that is wrong with it."""
    c = found
    mismatch = written(sources.oracle_mismatch(c.queries, c.qrels, c.facts))
    unknown = written(sources.unknown_references(c.queries, c.gold, c.corpus, c.facts))
    total = c.queries.count()
    counts = sources.template_counts(c.queries, c.qrels)
    parts = [
        sources.corpus_violations(c.corpus), sources.raw_query_violations(c.raw), sources.id_violations(c.raw.select(F.col("id").alias("qid")), total), sources.query_violations(c.queries, c.qrels),
        mismatch.select("qid", "side"), unknown.select("qid", F.concat(F.lit("unknown_"), "kind")),
    ]
    if per_template is not None:
        known = templates.templates(spark).select("template").join(counts, "template", "left")
        parts.append(known.where(F.coalesce("n_queries", F.lit(0)) != per_template).select("template", F.lit("wrong_template_count")))
    broken = parts[0]
    for p in parts[1:]:
        broken = broken.union(p)
    summary = sources.audit_summary(c.corpus, c.queries, c.qrels, c.facts).first().asDict()
    wrong = mismatch.select("qid").distinct().count()
    summary |= {
        "unique_corpus_ids": c.corpus.select("doc_id").distinct().count(), "template_counts": {r.template: r.n_queries for r in counts.collect()},
        "unknown_gold_ids": unknown.where("kind = 'document'").count(), "unknown_attributes": unknown.where("kind = 'attribute'").count(),
        "plan_text_matches": c.queries.where(F.col("text").eqNullSafe(templates.render())).count(), "exact_matches": total - wrong, "exact_mismatches": wrong,
    }
    return summary, written(broken.toDF("what", "rule"))


def run(spark: SparkSession, found: Collection, out: str, depths: list[int], tokenizer: str, draws: int, tie_break: str = "corpus_ordinal", pool_k: int = 1000, final_k: int = 100) -> dict:
    """Write every table and run to out; the manifest says what made them."""
    corpus, queries, qrels, facts = found.corpus, found.queries, found.qrels, found.facts
    began = time.perf_counter()
    index = bm25.build(corpus, tokenizer)
    indexed = time.perf_counter()
    atoms = written(templates.atoms(queries))
    exact = written(boolean.execute(atoms, facts))
    pool = written(bm25.search(index, queries, pool_k, tokenizer, tie_break))
    pooled = time.perf_counter()
    atomic = written(bm25.search(index, fusion.atomic_queries(atoms), max(depths), tokenizer, tie_break).withColumnRenamed("qid", "attr"))
    lists = written(fusion.prefixes(atomic, depths))
    listed = time.perf_counter()
    name = lambda m, df: df.select(F.when(F.col("depth").isNull(), F.lit(m)).otherwise(F.concat(F.lit(f"{m}_L"), "depth")).alias("method"), "depth", "qid", "ordinal", "rank")
    flat = lambda df: df.withColumn("depth", F.lit(None).cast("int"))
    families = {
        "bm25": flat(pool.withColumn("rank", F.when(F.col("rank") <= final_k, F.col("rank")))), "exact": flat(boolean.oracle_ranking(exact, final_k)),
        "compose_exact_not": fusion.compose_exact_not(atoms, lists, facts, final_k), "compose_truncated_not": fusion.compose_truncated_not(atoms, lists, final_k),
        "union_verify": fusion.union_verify(atoms, lists, exact, final_k), "full_verify": fusion.full_verify(pool, exact, final_k), "hybrid_verify": fusion.hybrid_verify(atoms, lists, pool, exact, depths, final_k),
    }
    results = {k: written(name(k, df)) for k, df in families.items()}

    def union(names) -> DataFrame:
        parts = [results[k] for k in names]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    rows = written(metrics.evaluate(union(results).drop("depth"), queries, qrels))
    made = [k for k in results if k not in ("bm25", "exact")]
    split = [metrics.composition_errors(results[k], atoms, lists, queries, qrels, any_list=k == "union_verify") for k in ("compose_exact_not", "compose_truncated_not", "union_verify")]
    buckets = split[0].unionByName(split[1]).unionByName(split[2]).select("method", "qid", "atomic_miss", "composition_or_exclusion_miss")
    errors = metrics.ranking_errors(union(made), queries, qrels, final_k).withColumn("parse_or_oracle_mismatch", F.lit(0)).join(buckets, ["method", "qid"], "left")
    treated = written(rows.where(F.col("method").isin("bm25") | F.regexp_replace("method", "_L[0-9]+$", "").isin(*TREATED)))
    diagnosed = written(diagnostics.atomic_diagnostics(atoms, lists, facts, depths))
    tables = {
        "per_query_metrics": rows.join(metrics.budgets(rows, pool_k, final_k), ["method", "qid"]), "summary_metrics": metrics.summarise(rows),
        "bootstrap_deltas": bootstrap.bootstrap(metrics.paired_deltas(treated, "bm25", HEADLINE), draws), "atomic_metrics": diagnosed, "atomic_summary": diagnostics.atomic_summary(diagnosed), "error_decomposition": errors,
    }
    for k, df in tables.items():
        sinks.write_csv(df, f"{out}/{k}")
    ids = corpus.select("ordinal", "doc_id")
    ranked = lambda df: df.where("rank is not null").join(ids, "ordinal")
    sinks.write_run(ranked(results["exact"]).select("qid", "rank", "doc_id"), f"{out}/runs/exact")
    sinks.write_run(ranked(pool).select("qid", "rank", "doc_id", "score"), f"{out}/runs/bm25")
    sinks.write_run(ranked(atomic).select("attr", "rank", "doc_id", "score"), f"{out}/runs/atomic", ("attr",))
    sinks.write_run(ranked(union(made)).select("method", "qid", "rank", "doc_id"), f"{out}/runs/composed", ("method", "qid"))
    stats = index.stats.first()
    manifest = {
        "tokenizer": tokenizer, "bm25": {"k1": index.k1, "b": index.b, "corpus_size": stats.n_docs, "vocabulary_size": stats.vocabulary, "average_document_length": stats.avgdl, "tie_break": tie_break},
        "composition": {"depths": depths, "full_query_pool": pool_k, "final_k": final_k, "fusion": f"reciprocal ranks, constant {fusion.RRF}"},
        "bootstrap": {"samples": draws, "seed": bootstrap.SEED, "paired": True, "stratified_by": "template"},
        "runtime": {
            "python": platform.python_version(), "numpy": numpy.__version__, "spark": pyspark.__version__, "platform": platform.platform(), "index_seconds": indexed - began,
            "full_bm25_seconds": pooled - indexed, "atomic_retrieval_seconds": listed - pooled, "total_seconds": time.perf_counter() - began,
        },
        "artifacts": {k: k for k in tables} | {"audit": "data_audit.json", "runs": ["runs/exact", "runs/bm25", "runs/atomic", "runs/composed"]},
    }
    sinks.write_json(spark, manifest, f"{out}/manifest.json")
    return manifest


def check(spark: SparkSession, out: str) -> DataFrame:
    """scope, method, metric, rule of every figure of a run's files that another of its files, or a new bootstrap of its rows, does not confirm."""
    numbers = lambda df, names: df.select(*(F.col(c).cast("double").alias(c) if c in names else c for c in df.columns))
    rows = written(numbers(finished.read_csv(spark, f"{out}/per_query_metrics"), metrics.METRICS))
    summary = finished.read_csv(spark, f"{out}/summary_metrics")
    stored = written(finished.read_csv(spark, f"{out}/bootstrap_deltas"))
    means = evidence.row_claims(rows, metrics.METRICS, "per_query_metrics")
    claims = means.unionByName(evidence.summary_claims(summary, metrics.METRICS, "summary_metrics"))
    intervals = evidence.interval_claims(stored, "bootstrap_deltas").unionByName(evidence.recomputed(rows, stored, HEADLINE))
    differences = evidence.difference_claims(means.where(F.col("metric").isin(*HEADLINE)), "bm25").join(stored.select(F.col("treatment").alias("method")).distinct(), "method", "left_semi").select(*evidence.CLAIM)
    return evidence.violations(evidence.evidence(claims.unionByName(intervals).unionByName(differences)), needed=2)


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="sieveline", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for command in ("audit", "run"):
        p = sub.add_parser(command)
        p.add_argument("--data-dir", required=True)
        p.add_argument("--corpus-file", default="corpus.jsonl")
        p.add_argument("--queries-file", default="queries.jsonl")
        p.add_argument("--checksums", help="list of checksums; SHA256SUMS in the data folder if there is one")
        p.add_argument("--no-checksums", action="store_true", help="compute checksums, but do not compare them")
        p.add_argument("--per-template", type=int, help="how many queries each template must have")
        if command == "run":
            p.add_argument("--output-dir", required=True)
            p.add_argument("--depths", type=_depths, default=_depths("10,25,50,100,250,500,1000"))
            p.add_argument("--tokenizer", choices=sorted(TOKENIZERS), default="regex")
            p.add_argument("--tie-break", choices=bm25.TIE_BREAKS, default="corpus_ordinal")
            p.add_argument("--bootstrap-samples", type=int, default=bootstrap.DRAWS)
    sub.add_parser("check").add_argument("--output-dir", required=True)
    asked = top.parse_args(args)
    spark = SparkSession.builder.appName("sieveline").getOrCreate()
    ship(spark)
    if asked.command == "check":
        wrong = written(check(spark, asked.output_dir))
        wrong.show(50, truncate=False)
        return int(not wrong.isEmpty())
    sums, broken_files = checked_files(spark, asked.data_dir, [asked.corpus_file, asked.queries_file], asked.checksums, not asked.no_checksums)
    if broken_files:
        print(json.dumps({"checksums": broken_files}, indent=2))
        return 1
    found = load(spark, f"{asked.data_dir}/{asked.corpus_file}", f"{asked.data_dir}/{asked.queries_file}")
    summary, broken = audit(spark, found, asked.per_template)
    summary = {"checksums": sums, **summary}
    print(json.dumps(summary, indent=2, sort_keys=True, default=str))
    if not broken.isEmpty():
        broken.show(50, truncate=False)
        return 1
    if asked.command == "run":
        sinks.write_json(spark, summary, f"{asked.output_dir}/data_audit.json")
        print(json.dumps(run(spark, found, asked.output_dir, asked.depths, asked.tokenizer, asked.bootstrap_samples, asked.tie_break), indent=2, sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
