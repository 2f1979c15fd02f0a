"""The jobs as queries over a directory of tables, each run twice into one new folder, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.sources.tables import shared_dir, ship

from . import grow_index, passage_report


def _folder(spark: SparkSession, job: str) -> str:
    ship(spark)
    return f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"


def job1_passage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on the benchmark's passages over the documents table."""
    out = _folder(spark, "job1")
    for _ in range(2):
        passage_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out)
    rows = passage_report.report(spark, out)
    return rows.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


def job2_grow_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the index grown from the files of the documents table."""
    out = _folder(spark, "job2")
    for _ in range(2):
        # as a pattern, for a stream reads a folder or a pattern, and the table may be one file
        grow_index.run(spark, f"{sf_dir}/documents.parque[t]", f"{out}/index", f"{out}/checkpoint")
    rows = grow_index.table(spark, f"{out}/index", "vocabulary")
    # the mean over the vocabulary depends on the order of its sum in the last digits
    return rows.select("term", "df", "cf", F.round("raw_idf", 6).alias("raw_idf"), F.round("idf", 6).alias("idf"))


QUERIES = {f.__name__: f for f in (job1_passage_report, job2_grow_index)}

_TOKENS = r"'[\p{L}\p{N}_]+(?:[-''’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]'"
_IDF = """tf AS (SELECT ordinal, term, count(*) AS tf FROM (SELECT ordinal, unnest(l) AS term FROM toks) GROUP BY ALL
), st AS (SELECT count(*) AS n_docs, avg(len(l)) AS avgdl FROM toks
), raw AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, ln(n_docs - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw_idf FROM tf, st GROUP BY term, n_docs
), idf AS (SELECT *, CASE WHEN raw_idf >= 0 THEN raw_idf ELSE 0.25::DOUBLE * (SELECT avg(raw_idf) FROM raw) END AS idf FROM raw)"""
_DOCS = "SELECT doc_id AS ordinal, min(text) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id"


def _ndcg(k: int) -> str:
    return f"round(coalesce(sum(1 / log2(rank + 1) ORDER BY rank) FILTER (WHERE rank <= least({k}, 20) AND g), 0) / list_sum(list_transform(range(1, least(gold_size, {k}) + 1), lambda i: 1 / log2(i + 1))), 9) AS ndcg_at_{k}"


def _recall(k: int) -> str:
    return f"round(count(*) FILTER (WHERE rank <= least({k}, 20) AND g) / gold_size, 9) AS recall_at_{k}"


ORACLES = {
    "job1_passage_report": f"""
WITH toks AS (SELECT ordinal, regexp_extract_all(text, {_TOKENS}) AS l FROM ({_DOCS})
), asked AS (SELECT qid, regexp_extract_all(text, {_TOKENS}) AS l FROM (SELECT item_id::VARCHAR AS qid, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY item_id)
), {_IDF}, qt AS (SELECT qid, term, min(pos) AS pos, count(*) AS qf FROM (SELECT qid, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM asked) GROUP BY ALL
), scored AS (
  SELECT qid, tf.ordinal, sum(idf * qf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len(l) / avgdl)) ORDER BY pos) AS score
  FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN toks ON toks.ordinal = tf.ordinal, st GROUP BY qid, tf.ordinal
), pool AS (SELECT * FROM (
  SELECT a.qid, d.ordinal, row_number() OVER (PARTITION BY a.qid ORDER BY round(coalesce(score, 0), 9) DESC, d.ordinal) AS rank
  FROM asked a CROSS JOIN toks d LEFT JOIN scored s ON s.qid = a.qid AND s.ordinal = d.ordinal) WHERE rank <= 100
), gold AS MATERIALIZED (
  SELECT qid, ordinal FROM (SELECT qid, ' ' || array_to_string(l, ' ') || ' ' AS p FROM asked WHERE len(l) > 0) JOIN (SELECT ordinal, ' ' || array_to_string(l, ' ') || ' ' AS t FROM toks) ON contains(t, p)
), sizes AS (SELECT qid, count(*) AS gold_size FROM gold GROUP BY qid
), results AS (
  SELECT 'bm25' AS method, qid, ordinal, rank FROM pool
  UNION ALL SELECT 'full_verify', qid, ordinal, row_number() OVER (PARTITION BY qid ORDER BY rank) FROM pool SEMI JOIN gold USING (qid, ordinal)
), marked AS (
  SELECT m.method, s.qid, gold_size, r.rank, g.ordinal IS NOT NULL AS g FROM sizes s CROSS JOIN (SELECT unnest(['bm25', 'full_verify']) AS method) m
  LEFT JOIN results r ON r.method = m.method AND r.qid = s.qid LEFT JOIN gold g ON g.qid = r.qid AND g.ordinal = r.ordinal)
SELECT method, qid, gold_size, {", ".join(_recall(k) for k in (5, 20, 100))}, round(count(*) FILTER (WHERE rank <= 20 AND g) / least(gold_size, 100), 9) AS norm_recall_at_100, {", ".join(_ndcg(k) for k in (5, 20, 100))},
  round(count(*) FILTER (WHERE g) / gold_size, 9) AS candidate_recall, gold_size - count(*) FILTER (WHERE rank <= 20 AND g) AS total_misses, gold_size - count(*) FILTER (WHERE g) AS candidate_miss,
  least(20, count(*) FILTER (WHERE g)) - count(*) FILTER (WHERE rank <= 20 AND g) AS avoidable_ranking_miss, count(*) FILTER (WHERE g) - least(20, count(*) FILTER (WHERE g)) AS structural_cutoff_miss
FROM marked GROUP BY method, qid, gold_size""",
    "job2_grow_index": f"WITH toks AS (SELECT doc_id AS ordinal, regexp_extract_all(coalesce(min(text), ''), {_TOKENS}) AS l FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id), {_IDF} SELECT term, df, cf, round(raw_idf, 6) AS raw_idf, round(idf, 6) AS idf FROM idf",
}
