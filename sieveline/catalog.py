"""The registered queries over the derived fixture, each beside the SQL that checks it.

Fixture: a customer "likes" the parts it ordered at least 48 of on one line: the rule is
part of the fixture's definition, so that documents state few facts, as people do.
Depths and pools are a tenth of the published ones, to fit its corpus. Rotation
plans take attributes by rank; conjunctive plans take the first attributes of the
first document of each leading attribute, so that every plan has gold.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import CONTRACTIONS, regex_tokens, rerank_prompt, treebank_tokens
from .operators import bm25, boolean, bootstrap, diagnostics, evidence, fusion, metrics, report, rerank
from .plans import templates
from .sources import corpus as sources
from .sources import results as finished
from .sources import sinks
from .sources.ordinals import with_ordinals
from .sources.tables import shared_dir, ship, written

DEPTHS, POOL, FINAL = (5, 10, 25, 50, 100), 200, 100
#: Methods that choose from the pool, and from the positive lists.
POOLED, LISTED = ("bm25", "full_verify", "hybrid_verify"), ("compose_exact_not", "compose_truncated_not", "union_verify", "hybrid_verify")
HEADLINE = ("recall_at_100", "norm_recall_at_100", "ndcg_at_20")
NEGATED = (templates.AND_NOT_3, templates.NOT_2)
#: What a judge takes for a liking; see Fixture.judged.
JUDGED = "l_quantity >= 46 and l_returnflag <> 'R'"


class Fixture:
    """Tables over one input directory. What several operators share is a written table, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        ship(spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def bought(self, rule: str) -> DataFrame:
        """(ordinal, attr): customers and the parts they ordered on lines that the rule holds for."""
        lines = self.read("lineitem").where(rule).select("l_orderkey", "l_partkey")
        orders, part = self.read("orders").select("o_orderkey", "o_custkey"), self.read("part").select("p_partkey", "p_name")
        rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
        return rows.select(F.col("o_custkey").alias("ordinal"), F.col("p_name").alias("attr")).distinct()

    @cached_property
    def facts(self) -> DataFrame:
        return written(self.bought("l_quantity >= 48"))

    @cached_property
    def corpus(self) -> DataFrame:
        own = self.facts.groupBy("ordinal").agg(F.array_sort(F.collect_list("attr")).alias("attrs"))
        names = self.read("customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("doc_id"))
        return written(own.join(names, "ordinal").select("ordinal", "doc_id", F.concat("doc_id", F.lit(" likes "), F.array_join("attrs", ", "), F.lit(".")).alias("text"), "attrs"))

    @cached_property
    def planned(self) -> tuple[DataFrame, DataFrame]:
        """The queries and what they find. Plans are executed once: the queries are those that find something."""
        ranked = written(with_ordinals(self.facts.select("attr").distinct(), "attr").select("attr", F.col("ordinal").alias("r")))
        n = ranked.count()

        def turned(ks: list[int]) -> DataFrame:
            """r and the attributes k places on, for every rank r."""
            rows = ranked.select("r")
            for i, k in enumerate(ks):
                rows = rows.join(ranked.select(F.pmod(F.col("r") - k, F.lit(n)).alias("r"), F.col("attr").alias(f"a{i}")), "r")
            return rows.select("r", F.array(*(f"a{i}" for i in range(len(ks)))).alias("attrs"))

        rotation = [(0, templates.ATOM, [0]), (1, templates.OR_2, [0, 7]), (2, templates.OR_3, [0, 7, 19]), (6, templates.NOT_2, [0, 7])]
        parts = [turned(ks).select(F.lit(i).alias("t"), "r", F.lit(t).alias("template"), "attrs") for i, t, ks in rotation] if n else []
        seeds = self.corpus.where(F.size("attrs") >= 3).groupBy(F.get("attrs", F.lit(0)).alias("lead")).agg(F.min_by("attrs", "ordinal").alias("own"))
        # the first attribute that a seed lacks: its own, in order, have ranks 0, 1, ... up to there
        places = seeds.select("lead", F.explode("own").alias("attr")).join(ranked, "attr").groupBy("lead").agg(F.array_sort(F.collect_list("r")).alias("rs"), F.min(F.when(F.col("attr") == F.col("lead"), F.col("r"))).alias("r"))
        gap = F.coalesce(F.array_position(F.transform("rs", lambda x, i: x != i), True), F.lit(0))
        lack = F.when(gap > 0, gap - 1).otherwise(F.size("rs")).cast("long")
        seeds = seeds.join(places.select("lead", "r", lack.alias("lack")), "lead").join(ranked.select(F.col("r").alias("lack"), F.col("attr").alias("lacked")), "lack", "left")
        own = lambda k: F.get("own", F.lit(k))
        conjunctive = [(3, templates.AND_2, [own(0), own(1)]), (4, templates.AND_3, [own(0), own(1), own(2)]), (5, templates.AND_NOT_3, [own(0), own(1), F.col("lacked")])]
        parts += [seeds.select(F.lit(i).alias("t"), "r", F.lit(t).alias("template"), F.array(*cols).alias("attrs")) for i, t, cols in conjunctive]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = written(out.select((F.col("t") * 1000 + F.col("r")).cast("string").alias("qid"), (F.col("t") * 1000 + F.col("r")).cast("long").alias("ordinal"), templates.render().alias("text"), "template", "attrs"))
        # a rotation of NOT can be empty; queries without gold are no queries
        exact = written(boolean.execute(templates.atoms(out), self.facts))
        return written(out.join(exact.select("qid").distinct(), "qid", "left_semi")), exact

    @property
    def queries(self) -> DataFrame:
        return self.planned[0]

    @cached_property
    def atoms(self) -> DataFrame:
        return written(templates.atoms(self.queries))

    @property
    def exact(self) -> DataFrame:
        return self.planned[1]

    @property
    def qrels(self) -> DataFrame:
        return self.exact

    @cached_property
    def about(self) -> DataFrame:
        """The queries and the sizes of their gold."""
        return written(metrics.described(self.queries, self.qrels, distinct=True))

    @cached_property
    def pool_gold(self) -> DataFrame:
        """(qid, ordinal): gold that is in the pool. As much as queries and pools allow, whatever the corpus; all gold is read for it, but none shuffled."""
        return written(self.exact.join(bm25.few(self.pool.select("qid", "ordinal")), ["qid", "ordinal"], "left_semi"))

    @cached_property
    def list_gold(self) -> DataFrame:
        """(qid, ordinal): gold that is in a positive list of its query."""
        listed = written(self.atoms.where("not is_negative").join(self.atomic, "attr").select("qid", "ordinal").distinct())
        return written(self.exact.join(bm25.few(listed), ["qid", "ordinal"], "left_semi"))

    def offered(self, *methods: str) -> DataFrame:
        """(qid, ordinal): all gold that these methods can find, each row once."""
        parts = [gold for names, gold in ((POOLED, "pool_gold"), (LISTED, "list_gold")) if set(names) & set(methods)]
        return _union(getattr(self, p) for p in parts).distinct()

    @cached_property
    def judged(self) -> DataFrame:
        """(qid, ordinal): gold that is judged on the orders, not executed over what texts state.

        A customer is relevant by what it ordered 46 or more of and did not send back, so
        texts state likings that the judgement denies and leave out some that it holds.
        """
        held = self.atoms.join(self.bought(JUDGED), "attr").groupBy("qid", "ordinal").agg(F.count_if(~F.col("is_negative")).alias("for"), F.count_if("is_negative").alias("against"))
        need = self.atoms.groupBy("qid").agg(F.max(F.when(F.col("positive_operator") == "and", F.col("n_positive")).otherwise(1)).alias("need"))
        return written(held.join(need, "qid").where("against = 0 and for >= need").select("qid", "ordinal"))

    def of(self, template: str) -> DataFrame:
        return self.queries.where(F.col("template") == template)

    @cached_property
    def index(self) -> bm25.Index:
        return bm25.build(self.corpus)

    @cached_property
    def pool(self) -> DataFrame:
        return written(bm25.search(self.index, self.queries, POOL))

    @cached_property
    def best(self) -> DataFrame:
        """The first FINAL of BM25's ranking of the whole corpus."""
        return written(bm25.search(self.index, self.queries, FINAL))

    @cached_property
    def counted(self) -> DataFrame:
        """(qid, found, candidate_size) where every document is a candidate: all gold is found but for customers that have facts and no document. No pair of a query and a document is made."""
        absent = written(self.facts.select("ordinal").distinct().join(self.corpus.select("ordinal"), "ordinal", "left_anti"))
        lost = self.exact.join(bm25.few(absent), "ordinal", "left_semi").groupBy("qid").agg(F.count("*").alias("lost"))
        size = self.corpus.agg(F.count("*").alias("candidate_size"))
        return self.about.select("qid", "gold_size").join(lost, "qid", "left").na.fill(0).crossJoin(F.broadcast(size)).select("qid", (F.col("gold_size") - F.col("lost")).alias("found"), "candidate_size")

    @cached_property
    def atomic(self) -> DataFrame:
        return written(bm25.search(self.index, fusion.atomic_queries(self.atoms), max(DEPTHS)).withColumnRenamed("qid", "attr"))

    @cached_property
    def reranked(self) -> DataFrame:
        """The pool by the lexical score."""
        return written(rerank.rerank(self.pool.select("qid", "ordinal", "rank"), self.queries, self.corpus))

    @cached_property
    def lists(self) -> DataFrame:
        return fusion.prefixes(self.atomic, DEPTHS)


def _method(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.when(F.col("depth").isNull(), F.lit(name)).otherwise(F.concat(F.lit(f"{name}_L"), "depth")).alias("method"), "depth", "qid", "ordinal", "rank")


def _flat(name: str, df: DataFrame) -> DataFrame:
    return _method(name, df.withColumn("depth", F.lit(None).cast("int")))


def results(fx: Fixture, *names: str) -> dict[str, DataFrame]:
    """(method, depth, qid, ordinal, rank) of the named method families, or of every one, over shared plans."""
    made = {
        "bm25": lambda: _flat("bm25", fx.pool.withColumn("rank", F.when(F.col("rank") <= FINAL, F.col("rank")))),
        "exact": lambda: _flat("exact", boolean.oracle_ranking(fx.exact, FINAL)),
        "compose_exact_not": lambda: _method("compose_exact_not", fusion.compose_exact_not(fx.atoms, fx.lists, fx.facts, FINAL)),
        "compose_truncated_not": lambda: _method("compose_truncated_not", fusion.compose_truncated_not(fx.atoms, fx.lists, FINAL)),
        "union_verify": lambda: _method("union_verify", fusion.union_verify(fx.atoms, fx.lists, fx.list_gold, FINAL)),
        "full_verify": lambda: _method("full_verify", fusion.full_verify(fx.pool, fx.pool_gold, FINAL)),
        "hybrid_verify": lambda: _method("hybrid_verify", fusion.hybrid_verify(fx.atoms, fx.lists, fx.pool, fx.offered("hybrid_verify"), DEPTHS, FINAL)),
    }
    return {name: made[name]() for name in names or made}


def _union(parts) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def _evaluated(fx: Fixture, *names: str) -> DataFrame:
    """Per-query metrics of the named method families. The exact one, which finds all gold, meets all of it; the others what they can find."""
    by = results(fx, *names)
    found = [k for k in by if k != "exact"]
    parts = [metrics.evaluate(_union(by[k] for k in found), fx.queries, fx.offered(*found), about=fx.about)] if found else []
    return _union(parts + [metrics.evaluate(by[k], fx.queries, fx.qrels, about=fx.about) for k in by if k not in found])


def _main(fx: Fixture) -> DataFrame:
    """Per-query metrics of the methods that reports compare."""
    return _evaluated(fx, "bm25", "exact", "full_verify", "union_verify", "hybrid_verify")


def _missed(fx: Fixture, *names: str) -> DataFrame:
    """Where the named method families lose gold."""
    return metrics.ranking_errors(_union(results(fx, *names).values()), fx.queries, fx.offered(*names), FINAL, about=fx.about)


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


Q: dict[str, Callable[[Fixture], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _treebank_sql(source: str) -> str:
    """The published conventions in DuckDB's dialect, which cannot look around: what is beside a word is taken along, and the step repeated."""
    space = r"[\s\p{Z}\x1c-\x1f\x85]"
    steps = [
        ("([«“‘„]|`+)", r" \1 "), ('^"', "``"), ("``", " `` "), (r"([ (\[{<])(\"|'')", r"\1 `` "), *[(rf"'([a-ce-lo-ru-zA-CE-LO-RU-Z0-9_])([^\p{{L}}\p{{N}}_]|$)", r"' \1\2")] * 2,
        (rf"([^.])(\.)([\])}}>\"'»”’ ]*){space}*$", r"\1 \2 \3 "), (r"([:,])(\D)", r" \1 \2"), ("([:,])$", r" \1 "), (r"\.{2,}", r" \0 "), (r"[;@#$%&?!*]", r" \0 "), ("([^'])' ", r"\1 ' "),
        (r"[\]\[(){}<>]", r" \0 "), ("--", " -- "), ("^", " "), ("$", " "), ("([»”’])", r" \1 "), ("''", " '' "), ('"', " '' "), ("([^' ])('[sSmMdD]|') ", r"\1 \2 "), ("([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
        *[(rf"(?i)([^\p{{L}}\p{{N}}_])({a})({b})([^\p{{L}}\p{{N}}_])", r"\1 \2 \3\4") for a, b in CONTRACTIONS for _ in range(2)],
    ]
    text, quoted = "coalesce(text, '')", lambda x: x.replace("'", "''")
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{quoted(pattern)}', '{quoted(to)}', 'g')"
    return rf"SELECT ordinal, to_json(list_filter(regexp_split_to_array({text}, '{space}+'), lambda t: t <> ''))::VARCHAR AS tokens FROM ({source})"


#: CTEs that the checks share, in order of use.
BASE = r"""
WITH RECURSIVE facts AS (
  SELECT DISTINCT o_custkey AS ordinal, p_name AS attr FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 48
), corpus AS (
  SELECT ordinal, c_name AS doc_id, c_name || ' likes ' || array_to_string(attrs, ', ') || '.' AS text, attrs
  FROM (SELECT ordinal, list(attr ORDER BY attr) AS attrs FROM facts GROUP BY ordinal) JOIN customer ON c_custkey = ordinal
), tmpl(t, template, arity, op, neg) AS (
  VALUES (0, '_', 1, 'atom', false), (1, '_ or _', 2, 'or', false), (2, '_ or _ or _', 3, 'or', false), (3, '_ that are also _', 2, 'and', false),
    (4, '_ that are also both _ and _', 3, 'and', false), (5, '_ that are also _ but not _', 3, 'and', true), (6, '_ that are not _', 2, 'atom', true)
), wheel AS (SELECT list(attr ORDER BY attr) AS a, count(*)::INT AS n FROM (SELECT DISTINCT attr FROM facts)
), turned AS (SELECT a, n, unnest(range(n))::INT AS r FROM wheel
), seeds AS (
  SELECT list_position(a, lead) - 1 AS r, own, list_filter(a, lambda x: NOT list_contains(own, x))[1] AS lacked
  FROM (SELECT attrs[1] AS lead, arg_min(attrs, ordinal) AS own FROM corpus WHERE len(attrs) >= 3 GROUP BY attrs[1]), wheel
), plans AS (
  SELECT 0 AS t, r, [a[r + 1]] AS attrs FROM turned
  UNION ALL SELECT 1, r, [a[r + 1], a[(r + 7) % n + 1]] FROM turned
  UNION ALL SELECT 2, r, [a[r + 1], a[(r + 7) % n + 1], a[(r + 19) % n + 1]] FROM turned
  UNION ALL SELECT 6, r, [a[r + 1], a[(r + 7) % n + 1]] FROM turned
  UNION ALL SELECT 3, r, own[1:2] FROM seeds UNION ALL SELECT 4, r, own[1:3] FROM seeds UNION ALL SELECT 5, r, [own[1], own[2], lacked] FROM seeds
), all_queries AS (
  SELECT (t * 1000 + r)::VARCHAR AS qid, (t * 1000 + r)::BIGINT AS ordinal, template, attrs, arity, op, neg,
    CASE t WHEN 0 THEN 'Who likes ' || attrs[1] || '?' WHEN 1 THEN 'Who likes ' || attrs[1] || ' or ' || attrs[2] || '?'
      WHEN 2 THEN 'Who likes ' || attrs[1] || ' or ' || attrs[2] || ' or ' || attrs[3] || '?' WHEN 3 THEN 'Who likes ' || attrs[1] || ' and also likes ' || attrs[2] || '?'
      WHEN 4 THEN 'Who likes ' || attrs[1] || ' and also likes both ' || attrs[2] || ' and ' || attrs[3] || '?'
      WHEN 5 THEN 'Who likes ' || attrs[1] || ' and also likes ' || attrs[2] || ' but not ' || attrs[3] || '?' ELSE 'Who likes ' || attrs[1] || ' but not ' || attrs[2] || '?' END AS text
  FROM plans JOIN tmpl USING (t)
), hits AS (
  SELECT qid, f.ordinal, q.op, q.arity - q.neg::INT AS np, count(DISTINCT pos) FILTER (WHERE NOT (neg AND pos = arity)) AS h, bool_or(neg AND pos = arity) AS negated
  FROM (SELECT qid, op, neg, arity, unnest(attrs) AS attr, generate_subscripts(attrs, 1) AS pos FROM all_queries) q JOIN facts f USING (attr) GROUP BY ALL
), exact AS (SELECT qid, ordinal FROM hits WHERE NOT negated AND h >= CASE op WHEN 'and' THEN np ELSE 1 END
), queries AS MATERIALIZED (SELECT * FROM all_queries WHERE qid IN (SELECT qid FROM exact)
), atoms AS MATERIALIZED (
  SELECT qid, template, (pos - 1)::INT AS pos, attr, (neg AND pos = arity) AS is_negative, op AS positive_operator, arity - neg::INT AS n_positive
  FROM (SELECT qid, template, neg, arity, op, unnest(attrs) AS attr, generate_subscripts(attrs, 1) AS pos FROM queries)
), toks AS (SELECT ordinal, regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[-''’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]') AS l FROM corpus
), dl AS (SELECT ordinal, len(l)::INT AS dl FROM toks
), tf AS (SELECT ordinal, term, count(*) AS tf FROM (SELECT ordinal, unnest(l) AS term FROM toks) GROUP BY ALL
), st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl
), raw AS (SELECT term, count(*) AS df, ln(n_docs - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw_idf FROM tf, st GROUP BY term, n_docs
), idf AS (SELECT term, df, raw_idf, CASE WHEN raw_idf >= 0 THEN raw_idf ELSE 0.25::DOUBLE * (SELECT avg(raw_idf) FROM raw) END AS idf FROM raw
), asked AS (SELECT qid, text, 'q' AS kind FROM queries UNION ALL SELECT DISTINCT attr, 'Who likes ' || attr || '?', 'a' FROM atoms
), qt AS (
  SELECT kind, qid, term, min(pos) AS pos, count(*) AS qf
  FROM (SELECT kind, qid, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM (SELECT kind, qid, regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[-''’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]') AS l FROM asked)) GROUP BY ALL
), scored AS MATERIALIZED (
  SELECT kind, qid, ordinal, sum(idf * qf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ORDER BY pos) AS score
  FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (ordinal), st GROUP BY kind, qid, ordinal
), ranked AS MATERIALIZED (
  SELECT kind, qid, ordinal, score, rank FROM (
    SELECT a.kind, a.qid, d.ordinal, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY a.kind, a.qid ORDER BY round(coalesce(score, 0), 9) DESC, d.ordinal)::INT AS rank
    FROM asked a CROSS JOIN dl d LEFT JOIN scored s ON s.kind = a.kind AND s.qid = a.qid AND s.ordinal = d.ordinal) WHERE rank <= 200
), pool AS (SELECT qid, ordinal, score, rank FROM ranked WHERE kind = 'q'
), lists AS MATERIALIZED (SELECT qid AS attr, ordinal, rank, depth FROM ranked, (SELECT unnest([5, 10, 25, 50, 100]) AS depth) WHERE kind = 'a' AND rank <= depth
), met AS MATERIALIZED (
  SELECT depth, qid, ordinal, positive_operator AS op, n_positive AS np, count(DISTINCT pos) FILTER (WHERE NOT is_negative) AS h, bool_or(is_negative) AS negated,
    sum(CASE WHEN is_negative THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (60 + rank) END ORDER BY pos) AS rrf
  FROM atoms JOIN lists USING (attr) GROUP BY ALL HAVING count(DISTINCT pos) FILTER (WHERE NOT is_negative) > 0
), gone AS (SELECT DISTINCT qid, ordinal FROM atoms JOIN facts USING (attr) WHERE is_negative
), fused AS (
  SELECT 'compose_exact_not' AS m, depth, qid, ordinal, rrf FROM met ANTI JOIN gone USING (qid, ordinal) WHERE h >= CASE op WHEN 'and' THEN np ELSE 1 END
  UNION ALL SELECT 'compose_truncated_not', depth, qid, ordinal, rrf FROM met WHERE NOT negated AND h >= CASE op WHEN 'and' THEN np ELSE 1 END
  UNION ALL SELECT 'union_verify', depth, qid, ordinal, rrf FROM met SEMI JOIN exact USING (qid, ordinal)
  UNION ALL SELECT 'hybrid_verify', depth, qid, ordinal, sum(1.0::DOUBLE / (60 + rank) ORDER BY pos) FROM (
    SELECT depth, qid, ordinal, pos, rank FROM (SELECT qid, attr, min(pos) AS pos FROM atoms WHERE NOT is_negative GROUP BY ALL) JOIN lists USING (attr)
    UNION ALL SELECT unnest([5, 10, 25, 50, 100]), qid, ordinal, -1, rank FROM pool) SEMI JOIN exact USING (qid, ordinal) GROUP BY depth, qid, ordinal
), results AS MATERIALIZED (
  SELECT m AS family, m || '_L' || depth AS method, depth, qid, ordinal, rrf, CASE WHEN p <= 100 THEN p END AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY m, depth, qid ORDER BY round(rrf, 12) DESC, ordinal)::INT AS p FROM fused)
  UNION ALL SELECT 'bm25', 'bm25', NULL, qid, ordinal, NULL, CASE WHEN rank <= 100 THEN rank END FROM pool
  UNION ALL SELECT 'exact', 'exact', NULL, qid, ordinal, NULL, CASE WHEN p <= 100 THEN p END FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ordinal)::INT AS p FROM exact SEMI JOIN queries USING (qid))
  UNION ALL SELECT 'full_verify', 'full_verify', NULL, qid, ordinal, NULL, CASE WHEN p <= 100 THEN p END FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS p FROM pool SEMI JOIN exact USING (qid, ordinal))
), descr AS (
  SELECT qid, template, len(attrs)::INT AS n_atoms, gold_size, CASE WHEN gold_size <= 2 THEN '01-02' WHEN gold_size <= 5 THEN '03-05' WHEN gold_size <= 20 THEN '06-20' WHEN gold_size <= 50 THEN '21-50' WHEN gold_size <= 100 THEN '51-100' ELSE '101-200' END AS gold_size_bin
  FROM queries JOIN (SELECT qid, count(*) AS gold_size FROM exact GROUP BY qid) USING (qid)
), sums AS (
  SELECT family, method, qid, count(*) AS candidate_size, count(rank) AS retrieved_size, count(e.ordinal) AS found,
    count(e.ordinal) FILTER (WHERE rank <= 5) AS h5, count(e.ordinal) FILTER (WHERE rank <= 20) AS h20, count(e.ordinal) FILTER (WHERE rank <= 100) AS h100,
    coalesce(sum(1 / log2(rank + 1) ORDER BY rank) FILTER (WHERE rank <= 5 AND e.ordinal IS NOT NULL), 0) AS d5, coalesce(sum(1 / log2(rank + 1) ORDER BY rank) FILTER (WHERE rank <= 20 AND e.ordinal IS NOT NULL), 0) AS d20,
    coalesce(sum(1 / log2(rank + 1) ORDER BY rank) FILTER (WHERE rank <= 100 AND e.ordinal IS NOT NULL), 0) AS d100
  FROM results r LEFT JOIN exact e USING (qid, ordinal) GROUP BY family, method, qid
), measured AS MATERIALIZED (
  SELECT family, method, qid, template, n_atoms, gold_size, gold_size_bin, h5 / gold_size AS recall_at_5, h20 / gold_size AS recall_at_20, h100 / gold_size AS recall_at_100, h100 / least(gold_size, 100) AS norm_recall_at_100,
    d5 / list_sum(list_transform(range(1, least(gold_size, 5) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_at_5, d20 / list_sum(list_transform(range(1, least(gold_size, 20) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_at_20,
    d100 / list_sum(list_transform(range(1, least(gold_size, 100) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_at_100,
    CASE WHEN candidate_size = 0 THEN 0 ELSE found / candidate_size END AS candidate_precision, found / gold_size AS candidate_recall,
    CASE WHEN found = 0 THEN 0 ELSE 2 * (found / candidate_size) * (found / gold_size) / (found / candidate_size + found / gold_size) END AS candidate_f1, found / (gold_size + candidate_size - found) AS candidate_jaccard, retrieved_size, candidate_size
  FROM (SELECT m.family, m.method, d.*, coalesce(candidate_size, 0) AS candidate_size, coalesce(retrieved_size, 0) AS retrieved_size, coalesce(found, 0) AS found, coalesce(h5, 0) AS h5, coalesce(h20, 0) AS h20, coalesce(h100, 0) AS h100,
      coalesce(d5, 0) AS d5, coalesce(d20, 0) AS d20, coalesce(d100, 0) AS d100
    FROM (SELECT DISTINCT family, method FROM results) m CROSS JOIN descr d LEFT JOIN sums s ON s.method = m.method AND s.qid = d.qid)
), main AS (SELECT * FROM measured WHERE family IN ('bm25', 'exact', 'full_verify', 'union_verify', 'hybrid_verify')
), long AS (UNPIVOT (SELECT method, qid, template, recall_at_100, norm_recall_at_100, ndcg_at_20 FROM main) ON recall_at_100, norm_recall_at_100, ndcg_at_20 INTO NAME metric VALUE value
), deltas AS (SELECT a.qid, a.template, a.method AS treatment, a.metric, a.value - b.value AS delta FROM long a JOIN long b ON a.qid = b.qid AND a.metric = b.metric AND b.method = 'bm25' WHERE a.method <> 'bm25'
), usage AS (SELECT attr, count(*) AS total_occurrences, count(*) FILTER (WHERE NOT is_negative) AS positive_occurrences, count(*) FILTER (WHERE is_negative) AS negative_occurrences FROM atoms GROUP BY attr
), diag AS (
  SELECT u.attr, dp.depth, total_occurrences, positive_occurrences, negative_occurrences, posting_size, retrieved_size, hits, fr, lr, mr, least(retrieved_size, posting_size) AS room
  FROM usage u JOIN (SELECT attr, count(*) AS posting_size FROM facts GROUP BY attr) USING (attr) CROSS JOIN (SELECT unnest([5, 10, 25, 50, 100]) AS depth) dp
  JOIN (SELECT l.attr, depth, count(*) AS retrieved_size, count(f.ordinal) AS hits, min(rank) FILTER (WHERE f.ordinal IS NOT NULL) AS fr, max(rank) FILTER (WHERE f.ordinal IS NOT NULL) AS lr, avg(rank) FILTER (WHERE f.ordinal IS NOT NULL) AS mr
    FROM lists l LEFT JOIN facts f ON f.attr = l.attr AND f.ordinal = l.ordinal GROUP BY ALL) x ON x.attr = u.attr AND x.depth = dp.depth
)
"""
MEAN = ", ".join(f"round(avg({m}), 9) AS {m}" for m in (*metrics.METRICS, *metrics.SIZES))
ROW = ", ".join(f"round({m}, 9) AS {m}" for m in metrics.METRICS)
MEASURED = f"SELECT method, qid, template, n_atoms, gold_size, gold_size_bin, {ROW}, retrieved_size, candidate_size FROM measured"


@query("SELECT ordinal, attr FROM facts")
def facts(fx):
    return fx.facts


@query("SELECT attr, count(*)::BIGINT AS posting_size, min(ordinal) AS first_ordinal FROM facts GROUP BY attr")
def postings(fx):
    return sources.postings(fx.facts)


@query("SELECT ordinal, attr FROM facts")
def parse_facts(fx):
    return sources.facts(fx.corpus)


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents")
def doc_ordinal(fx):
    return with_ordinals(fx.read("documents").select("doc_id"), "doc_id")


@query("SELECT qid, text FROM queries")
def plan_render(fx):
    return fx.queries.select("qid", templates.render().alias("text"))


@query("SELECT qid, template, pos, attr, is_negative, positive_operator, n_positive FROM atoms")
def plan_atoms(fx):
    return fx.atoms


@query("""SELECT qid, CASE WHEN ordinal % 5 = 0 THEN 'unknown_template' WHEN ordinal % 7 = 0 THEN 'wrong_arity' ELSE 'empty_attribute' END AS rule FROM queries WHERE ordinal % 5 = 0 OR ordinal % 7 = 0 OR ordinal % 11 = 0
UNION ALL SELECT qid, 'empty_attribute' FROM queries WHERE ordinal % 11 = 0 AND (ordinal % 5 = 0 OR ordinal % 7 = 0)""")
def plan_violations(fx):
    """The fixture's plans, of which some have another template, an attribute too many or a blank one."""
    planted = lambda n: F.col("ordinal") % n == 0
    attrs = F.when(planted(11), F.concat(F.array(F.lit(" ")), F.slice("attrs", 2, F.size("attrs")))).otherwise(F.col("attrs"))
    attrs = F.when(planted(7), F.concat(attrs, F.array(F.lit("more")))).otherwise(attrs)
    return templates.violations(fx.queries.select("qid", F.when(planted(5), F.lit("no such")).otherwise(F.col("template")).alias("template"), attrs.alias("attrs")))


@query("SELECT qid, rule FROM (SELECT qid || 'x' AS qid, 'text_is_not_rendering' AS rule FROM queries UNION ALL SELECT qid || 'x', 'no_gold' FROM queries)")
def query_violations(fx):
    off = fx.queries.withColumn("text", F.lower("text")).withColumn("qid", F.concat("qid", F.lit("x")))
    return sources.query_violations(fx.queries.unionByName(off), fx.qrels)


@query("SELECT (SELECT count(*) FROM corpus) AS n_documents, (SELECT count(DISTINCT attr) FROM facts) AS n_attrs, (SELECT count(*) FROM facts) AS n_facts, (SELECT count(*) FROM queries) AS n_queries, (SELECT count(DISTINCT template) FROM queries) AS n_templates, sum(g)::BIGINT AS gold_total, min(g) AS gold_min, max(g) AS gold_max, avg(g) AS gold_mean, (SELECT count(DISTINCT ordinal) FROM exact) AS referenced_documents FROM (SELECT count(*) AS g FROM exact GROUP BY qid)")
def audit_summary(fx):
    return sources.audit_summary(fx.corpus, fx.queries, fx.qrels, fx.facts)


@query("SELECT qid, ordinal, 'exact_only' AS side FROM exact WHERE ordinal % 10 = 0")
def oracle_mismatch(fx):
    return sources.oracle_mismatch(fx.queries, fx.qrels.where("ordinal % 10 <> 0"), fx.facts)


@query(r"SELECT doc_id, to_json(coalesce(regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[-''’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]'), []))::VARCHAR AS tokens FROM documents")
def tokenize(fx):
    return fx.read("documents").select("doc_id", F.to_json(regex_tokens("text")).alias("tokens"))


@query(_treebank_sql("SELECT ordinal, text FROM corpus"))
def tokenize_treebank(fx):
    return fx.corpus.select("ordinal", F.to_json(treebank_tokens("text")).alias("tokens"))


@query(_treebank_sql("SELECT doc_id AS ordinal, text FROM documents"))
def tokenize_treebank_documents(fx):
    return fx.read("documents").select(F.col("doc_id").alias("ordinal"), F.to_json(treebank_tokens("text")).alias("tokens"))


def _bool(name: str, run):
    def f(fx):
        return run(fx)

    f.__name__ = name
    return f


for _name, _t, _run in (
    ("bool_atom", templates.ATOM, lambda p, f: boolean.atom(p, f)),
    ("bool_or2", templates.OR_2, lambda p, f: boolean.union(p, f, 2)),
    ("bool_or3", templates.OR_3, lambda p, f: boolean.union(p, f, 3)),
    ("bool_and2", templates.AND_2, lambda p, f: boolean.intersection(p, f, 2)),
    ("bool_and3", templates.AND_3, lambda p, f: boolean.intersection(p, f, 3)),
    ("bool_and_not3", templates.AND_NOT_3, lambda p, f: boolean.difference(p, f, 3)),
    ("bool_not2", templates.NOT_2, lambda p, f: boolean.difference(p, f, 2)),
):
    query(f"SELECT qid, exact.ordinal FROM exact JOIN queries USING (qid) WHERE template = '{_t}'")(_bool(_name, lambda fx, t=_t, run=_run: run(fx.of(t), fx.facts)))


@query("SELECT qid, ordinal FROM exact SEMI JOIN queries USING (qid)")
def exact_oracle(fx):
    return fx.exact


@query("SELECT qid, ordinal, rank FROM results WHERE family = 'exact'")
def oracle_ranking(fx):
    return boolean.oracle_ranking(fx.exact, FINAL)


@query("SELECT ordinal, term, tf FROM tf")
def bm25_tf(fx):
    return fx.index.tf.select("ordinal", "term", "tf")


@query("SELECT n_docs, round(avgdl, 9) AS avgdl, round((SELECT avg(raw_idf) FROM raw), 9) AS average_idf, (SELECT count(*) FROM raw) AS vocabulary FROM st")
def bm25_doc_stats(fx):
    return _rounded(fx.index.stats.select("n_docs", "avgdl", "average_idf", "vocabulary"))


@query("SELECT term, df, round(raw_idf, 9) AS raw_idf, round(idf, 9) AS idf FROM idf")
def bm25_idf(fx):
    return _rounded(fx.index.idf.select("term", "df", "raw_idf", "idf"))


@query("SELECT qid, ordinal, round(score, 9) AS score FROM scored WHERE kind = 'q'")
def bm25_scores(fx):
    return _rounded(bm25.scores(fx.index, fx.queries))


@query("SELECT qid, ordinal, round(score, 9) AS score, rank FROM pool")
def bm25_topk(fx):
    return _rounded(fx.pool)


@query("SELECT qid AS attr, ordinal, round(score, 9) AS score, rank FROM ranked WHERE kind = 'a' AND rank <= 100")
def atomic_topk(fx):
    return _rounded(fx.atomic)


@query("SELECT attr, ordinal, rank, depth FROM lists")
def atomic_prefix(fx):
    return fx.lists


def _family(name: str):
    def f(fx):
        return results(fx, name)[name].select("method", "qid", "ordinal", "rank")

    f.__name__ = name
    return f


for _name in ("compose_exact_not", "compose_truncated_not", "union_verify", "full_verify", "hybrid_verify"):
    query(f"SELECT method, qid, ordinal, rank FROM results WHERE family = '{_name}'")(_family(_name))


@query("SELECT method, qid, ordinal, rank, round(rrf, 12) AS rrf FROM results WHERE family = 'union_verify'")
def rrf(fx):
    out = fusion.union_verify(fx.atoms, fx.lists, fx.list_gold, FINAL)
    return out.select(F.concat(F.lit("union_verify_L"), "depth").alias("method"), "qid", "ordinal", "rank", F.round("rrf", 12).alias("rrf"))


@query("SELECT attr AS qid, ordinal, row_number() OVER (PARTITION BY attr ORDER BY min(r))::INT AS rank FROM (SELECT attr, ordinal, rank * 2 AS r FROM lists WHERE depth = 100 UNION ALL SELECT attr, ordinal, rank * 2 + 5 FROM lists WHERE depth = 50) GROUP BY attr, ordinal")
def dedup_rankings(fx):
    lists = fx.lists.withColumnRenamed("attr", "qid")
    return fusion.deduplicate(lists.where("depth = 100").select("qid", "ordinal", (F.col("rank") * 2).alias("rank")).unionByName(lists.where("depth = 50").select("qid", "ordinal", (F.col("rank") * 2 + 5).alias("rank"))))


@query("SELECT qid, template FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY ordinal) AS p FROM queries) WHERE p <= 5")
def first_n_per_template(fx):
    return templates.first_n(fx.queries, 5).select("qid", "template")


@query(f"SELECT qid, p.ordinal, md5('<Instruct>: {rerank.INSTRUCTION}' || chr(10) || '<Query>: ' || q.text || chr(10) || '<Document>: ' || c.text) AS prompt_md5 FROM pool p JOIN queries q USING (qid) JOIN corpus c ON c.ordinal = p.ordinal")
def rerank_pairs(fx):
    return rerank.pairs(fx.pool, fx.queries, fx.corpus).select("qid", "ordinal", F.md5("prompt").alias("prompt_md5"))


LEXED = r"""SELECT p.qid, p.ordinal, p.rank AS source_rank, len(list_intersect(qw, dw)) / greatest(len(qw), 1) AS score
  FROM pool p JOIN (SELECT qid, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\v\f\r]+'), lambda w: w <> '')) AS qw FROM queries) q USING (qid)
  JOIN (SELECT ordinal, list_distinct(list_filter(regexp_split_to_array(lower(translate(text, ',.', '  ')), '[ \t\n\v\f\r]+'), lambda w: w <> '')) AS dw FROM corpus) c ON c.ordinal = p.ordinal"""


@query(f"SELECT qid, ordinal, source_rank, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source_rank)::INT AS rank FROM ({LEXED})")
def rerank_lexical(fx):
    return _rounded(fx.reranked)


@query("SELECT qid, ordinal, rank AS source_rank, (ordinal % 7)::DOUBLE AS score, row_number() OVER (PARTITION BY qid ORDER BY ordinal % 7 DESC, rank)::INT AS rank FROM pool")
def rerank_order(fx):
    return rerank.order(fx.pool.select("qid", "ordinal", F.col("rank").alias("source_rank"), (F.col("ordinal") % 7).cast("double").alias("score")))


MODELLED = r"""WITH words AS (SELECT regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[-''’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]') AS l, qid, NULL::BIGINT AS ordinal FROM queries
    UNION ALL SELECT regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[-''’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]'), NULL::VARCHAR, ordinal FROM corpus
  ), hashed AS (SELECT qid, ordinal, list_transform(l, lambda t: ('0x' || md5(t)[1:4])::INT) AS b FROM words)
  SELECT p.qid, p.ordinal, rank AS source_rank, list_sum(list_transform(list_filter(list_distinct(q.b[1:384]), lambda x: list_contains(d.b[1:greatest(384 - len(q.b), 0)], x)), lambda x: 1 + x * 7919 % 97)) / list_sum(list_transform(list_distinct(q.b[1:384]), lambda x: 1 + x * 7919 % 97)) AS score
  FROM pool p JOIN hashed q ON q.qid = p.qid JOIN hashed d ON d.ordinal = p.ordinal"""


@query(f"SELECT qid, ordinal, source_rank, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source_rank)::INT AS rank FROM (SELECT qid, ordinal, source_rank, coalesce(score, 0) AS score FROM ({MODELLED}))")
def rerank_model(fx):
    """The pool by the numpy model, in batches."""
    return _rounded(rerank.rerank(fx.pool.select("qid", "ordinal", "rank"), fx.queries, fx.corpus, rerank.overlap_model()))


@query("SELECT qid, 'too_short' AS rule FROM pool WHERE rank % 2 = 0 GROUP BY qid HAVING count(*) < 200 UNION ALL SELECT DISTINCT qid, 'unknown_document' FROM pool WHERE rank % 2 = 0 AND ordinal % 50 = 0")
def pool_violations(fx):
    return rerank.pool_violations(fx.pool.where("rank % 2 = 0"), fx.corpus.where("ordinal % 50 <> 0"), POOL)


@query("""SELECT qid, sha256('{"qid":"' || qid || '","ranking":[' || string_agg('"' || ordinal || '"', ',' ORDER BY rank) || ']}') AS sha256 FROM pool GROUP BY qid""")
def pool_fingerprint(fx):
    return rerank.pool_fingerprint(fx.pool.select("qid", "ordinal", "rank"))


@query("SELECT qid FROM pool WHERE ordinal % 40 = 0 GROUP BY qid")
def checkpoint_check(fx):
    pool = fx.pool.select("qid", "ordinal", "rank")
    done = pool.select("qid", (F.col("ordinal") + (F.col("ordinal") % 40 == 0).cast("int")).alias("ordinal"), F.col("rank").alias("source_rank"), F.lit(1.0).alias("score"))
    return rerank.incompatible(pool, done)


@query(MEASURED)
def metrics_per_query(fx):
    return _rounded(_evaluated(fx))


def _judged_sql() -> str:
    """The checks of the measures, their gold replaced by the judged one, which is restated in sets of lists."""
    measures = BASE[BASE.index("descr AS (") : BASE.index("), main AS")]
    for name in ("exact", "descr", "sums", "measured"):
        measures = re.sub(rf"\b{name}\b", f"judged_{name}", measures)
    return f""", kept AS (
  SELECT o_custkey AS ordinal, list(DISTINCT p_name) AS has FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE {JUDGED} GROUP BY o_custkey
), judged_exact AS MATERIALIZED (
  SELECT qid, k.ordinal FROM (SELECT qid, op, CASE WHEN neg THEN attrs[:-2] ELSE attrs END AS wanted, CASE WHEN neg THEN attrs[-1:] ELSE [] END AS barred FROM queries), kept k
  WHERE NOT list_has_any(has, barred) AND CASE op WHEN 'and' THEN list_has_all(has, wanted) ELSE list_has_any(has, wanted) END
), {measures})"""


@query(_judged_sql() + MEASURED.replace("measured", "judged_measured"))
def judged_metrics(fx):
    """Every method against a gold independent of the engine: what follows the texts exactly loses precision and recall too."""
    return _rounded(metrics.evaluate(_union(results(fx).values()), fx.queries, fx.judged))


@query(_judged_sql() + " SELECT m.method, qid, template, gold_size, gold_size - coalesce(hits, 0) AS total_misses, gold_size - coalesce(inside, 0) AS candidate_miss, least(100, coalesce(inside, 0)) - coalesce(hits, 0) AS avoidable_ranking_miss, coalesce(inside, 0) - least(100, coalesce(inside, 0)) AS structural_cutoff_miss FROM (SELECT DISTINCT method FROM results) m CROSS JOIN judged_descr LEFT JOIN (SELECT method, qid, count(*) AS inside, count(*) FILTER (WHERE rank <= 100) AS hits FROM results SEMI JOIN judged_exact USING (qid, ordinal) GROUP BY ALL) x USING (method, qid)")
def judged_errors(fx):
    """Where each method loses the judged documents."""
    return metrics.ranking_errors(_union(results(fx).values()), fx.queries, fx.judged, FINAL)


def _whole_sql() -> str:
    """The checks of the measures over BM25's ranking of the whole corpus, from which no pool is cut."""
    measures = BASE[BASE.index("sums AS (") : BASE.index("), main AS")]
    for name in ("results", "sums", "measured"):
        measures = re.sub(rf"\b{name}\b", f"whole_{name}", measures)
    return f""", whole_results AS MATERIALIZED (
  SELECT 'bm25' AS family, 'bm25' AS method, qid, ordinal, CASE WHEN p <= 100 THEN p END AS rank
  FROM (SELECT q.qid, d.ordinal, row_number() OVER (PARTITION BY q.qid ORDER BY round(coalesce(score, 0), 9) DESC, d.ordinal)::INT AS p
    FROM queries q CROSS JOIN dl d LEFT JOIN scored s ON s.kind = 'q' AND s.qid = q.qid AND s.ordinal = d.ordinal)
), {measures})"""


@query(_whole_sql() + MEASURED.replace("measured", "whole_measured"))
def method_bm25(fx):
    """BM25 over the whole corpus, not over a pool: every document is a candidate, for BM25 ranks them all, and the first FINAL, which are all that the measures of ranks look at, are the ranking."""
    gold = fx.exact.join(bm25.few(fx.best.select("qid", "ordinal")), ["qid", "ordinal"], "left_semi")
    return _rounded(metrics.evaluate(_flat("bm25", fx.best), fx.queries, gold, about=fx.about, counted=fx.counted))


@query("SELECT method, qid, round(recall_at_5, 9) AS recall_at_5, round(recall_at_20, 9) AS recall_at_20, round(recall_at_100, 9) AS recall_at_100 FROM measured WHERE family = 'full_verify'")
def recall_at_k(fx):
    return _rounded(_evaluated(fx, "full_verify").select("method", "qid", "recall_at_5", "recall_at_20", "recall_at_100"))


@query("SELECT method, qid, round(ndcg_at_5, 9) AS ndcg_at_5, round(ndcg_at_20, 9) AS ndcg_at_20, round(ndcg_at_100, 9) AS ndcg_at_100 FROM measured WHERE family = 'union_verify'")
def ndcg_at_k(fx):
    return _rounded(_evaluated(fx, "union_verify").select("method", "qid", "ndcg_at_5", "ndcg_at_20", "ndcg_at_100"))


@query("SELECT method, qid, round(candidate_precision, 9) AS candidate_precision, round(candidate_recall, 9) AS candidate_recall, round(candidate_f1, 9) AS candidate_f1, round(candidate_jaccard, 9) AS candidate_jaccard FROM measured WHERE family = 'hybrid_verify'")
def set_metrics(fx):
    return _rounded(_evaluated(fx, "hybrid_verify").select("method", "qid", "candidate_precision", "candidate_recall", "candidate_f1", "candidate_jaccard"))


@query(f"SELECT method, CASE WHEN grouping(template) = 1 AND grouping(gold_size_bin) = 1 THEN 'overall' WHEN grouping(template) = 0 THEN 'template' ELSE 'gold_size_bin' END AS group_type, coalesce(template, gold_size_bin, 'all') AS group_value, count(*) AS n_queries, {MEAN} FROM main GROUP BY GROUPING SETS ((method), (method, template), (method, gold_size_bin))")
def summary_metrics(fx):
    return _rounded(metrics.summarise(_main(fx)))


@query("SELECT * FROM usage")
def attr_usage(fx):
    return diagnostics.attribute_usage(fx.atoms)


@query("SELECT attr, depth, total_occurrences, positive_occurrences, negative_occurrences, posting_size, retrieved_size, hits AS relevant_retrieved, round(hits / posting_size, 9) AS recall, round(hits / retrieved_size, 9) AS precision, round(room / posting_size, 9) AS structural_ceiling, round(hits / room, 9) AS ceiling_normalised_recall, posting_size - room AS structural_misses, room - hits AS avoidable_misses, fr AS first_relevant_rank, lr AS last_relevant_rank, round(mr, 9) AS mean_relevant_rank, round(coalesce(1 / fr, 0), 9) AS reciprocal_rank, hits = posting_size AS full_coverage FROM diag")
def atomic_diagnostics(fx):
    return _rounded(diagnostics.atomic_diagnostics(fx.atoms, fx.lists, fx.facts, list(DEPTHS)))


@query("SELECT depth, count(*) AS unique_attrs, round(avg(posting_size), 9) AS posting_size_mean, median(posting_size)::DOUBLE AS posting_size_median, round(quantile_cont(posting_size, 0.9), 9) AS posting_size_p90, round(sum(hits) / sum(posting_size), 9) AS posting_weighted_recall, round(sum(hits) / sum(room), 9) AS posting_weighted_normalised_recall, round(avg(hits / posting_size), 9) AS macro_recall, round(sum(hits / posting_size * positive_occurrences) / sum(positive_occurrences), 9) AS positive_weighted_recall, round(sum(hits / posting_size * negative_occurrences) / sum(negative_occurrences), 9) AS negative_weighted_recall, count(*) FILTER (WHERE hits = 0) AS zero_hit_attrs, count(*) FILTER (WHERE hits = posting_size) AS full_coverage_attrs, round(avg(fr), 9) AS first_rank_mean, median(fr)::DOUBLE AS first_rank_median FROM diag GROUP BY depth")
def atomic_summary(fx):
    return _rounded(diagnostics.atomic_summary(diagnostics.atomic_diagnostics(fx.atoms, fx.lists, fx.facts, list(DEPTHS))))


@query("SELECT sum(round(gold_size * candidate_recall)::BIGINT)::BIGINT AS covered, sum(gold_size)::BIGINT AS total, round(sum(round(gold_size * candidate_recall)) / sum(gold_size), 9) AS coverage FROM measured WHERE method = 'bm25'")
def micro_coverage(fx):
    return _rounded(report.micro_coverage(_main(fx), "bm25"))


@query("SELECT template, round(avg(ndcg_at_20) FILTER (WHERE method = 'bm25'), 9) AS baseline, round(avg(ndcg_at_20) FILTER (WHERE method = 'full_verify'), 9) AS treatment, round(avg(ndcg_at_20) FILTER (WHERE method = 'full_verify') - avg(ndcg_at_20) FILTER (WHERE method = 'bm25'), 9) AS delta FROM measured GROUP BY template")
def template_view(fx):
    return _rounded(report.template_view(_main(fx), "bm25", "full_verify"))


@query("SELECT round(sum(d) FILTER (WHERE template IN ('_ that are also _ but not _', '_ that are not _')), 7) AS negated_gain, round(sum(d), 7) AS gain, round(sum(d) FILTER (WHERE template IN ('_ that are also _ but not _', '_ that are not _')) / sum(d), 7) AS share FROM (SELECT a.template, a.ndcg_at_20 - b.ndcg_at_20 AS d FROM measured a JOIN measured b USING (qid) WHERE a.method = 'full_verify' AND b.method = 'bm25')")
def negation_share(fx):
    return _rounded(report.negation_share(_main(fx), "bm25", "full_verify", NEGATED), 7)


@query("SELECT metric, round((avg(value) FILTER (WHERE method = 'union_verify_L100') - avg(value) FILTER (WHERE method = 'bm25')) / (avg(value) FILTER (WHERE method = 'exact') - avg(value) FILTER (WHERE method = 'bm25')), 7) AS closed FROM long WHERE metric <> 'norm_recall_at_100' GROUP BY metric")
def gap_closed(fx):
    return _rounded(report.gap_closed(report.model_means(_main(fx), HEADLINE), "bm25", "union_verify_L100", "exact", ("recall_at_100", "ndcg_at_20")), 7)


@query("SELECT method, round(avg(recall_at_100), 9) AS recall_at_100, round(avg(norm_recall_at_100), 9) AS norm_recall_at_100, round(avg(ndcg_at_20), 9) AS ndcg_at_20 FROM main GROUP BY method")
def model_means(fx):
    return _rounded(report.model_means(_main(fx), HEADLINE))


@query("SELECT m.method, qid, template, gold_size, gold_size - coalesce(hits, 0) AS total_misses, gold_size - coalesce(inside, 0) AS candidate_miss, least(100, coalesce(inside, 0)) - coalesce(hits, 0) AS avoidable_ranking_miss, coalesce(inside, 0) - least(100, coalesce(inside, 0)) AS structural_cutoff_miss FROM (SELECT DISTINCT method FROM results WHERE family NOT IN ('bm25', 'exact')) m CROSS JOIN descr LEFT JOIN (SELECT method, qid, count(*) AS inside, count(*) FILTER (WHERE rank <= 100) AS hits FROM results SEMI JOIN exact USING (qid, ordinal) GROUP BY ALL) x USING (method, qid)")
def error_decomposition(fx):
    return _missed(fx, "compose_exact_not", "compose_truncated_not", "union_verify", "full_verify", "hybrid_verify")


@query("""SELECT method, qid, template, gold_size, 0::BIGINT AS parse_or_oracle_mismatch, coalesce(am, 0) AS atomic_miss, coalesce(cm, 0) AS composition_or_exclusion_miss
FROM (SELECT DISTINCT family, method, depth FROM results WHERE family IN ('compose_exact_not', 'compose_truncated_not', 'union_verify')) m CROSS JOIN descr LEFT JOIN (
  SELECT method, qid, count(*) FILTER (WHERE NOT alive) AS am, count(*) FILTER (WHERE alive) AS cm FROM (
    SELECT m.method, e.qid, coalesce(h, 0) >= CASE WHEN m.family <> 'union_verify' AND q.op = 'and' THEN q.arity - q.neg::INT ELSE 1 END AS alive
    FROM (SELECT DISTINCT family, method, depth FROM results WHERE family IN ('compose_exact_not', 'compose_truncated_not', 'union_verify')) m CROSS JOIN exact e JOIN queries q ON q.qid = e.qid
    LEFT JOIN met ON met.depth = m.depth AND met.qid = e.qid AND met.ordinal = e.ordinal ANTI JOIN results r ON r.method = m.method AND r.qid = e.qid AND r.ordinal = e.ordinal) GROUP BY ALL) x USING (method, qid)""")
def composition_errors(fx):
    """Hard compositions need as many lists as their operator says, union-verify any one."""
    by = results(fx, "compose_exact_not", "compose_truncated_not", "union_verify")
    return _union(metrics.composition_errors(by[k], fx.atoms, fx.lists, fx.queries, fx.qrels, any_list=k == "union_verify") for k in ("compose_exact_not", "compose_truncated_not", "union_verify"))


@query("SELECT qid, template, treatment, metric, round(delta, 9) AS delta FROM deltas")
def paired_delta(fx):
    return _rounded(metrics.paired_deltas(_main(fx), "bm25", HEADLINE))


TREATED = ("compose_exact_not", "union_verify", "full_verify", "hybrid_verify")
TREATED_SQL = f"""long_treated AS (UNPIVOT (SELECT family, method, qid, template, recall_at_100, norm_recall_at_100, ndcg_at_20 FROM measured WHERE family IN ('bm25', {", ".join(f"'{t}'" for t in TREATED)})) ON recall_at_100, norm_recall_at_100, ndcg_at_20 INTO NAME metric VALUE value
), treated AS (SELECT a.qid, a.template, a.method AS treatment, a.metric, a.value - b.value AS delta FROM long_treated a JOIN long_treated b ON a.qid = b.qid AND a.metric = b.metric AND b.method = 'bm25' WHERE a.family <> 'bm25')"""


def _treated(fx, *names: str) -> DataFrame:
    """The deltas that bootstraps are made of: of the named method families, or of every one but the truncated composition and the exact one."""
    return metrics.paired_deltas(written(_evaluated(fx, "bm25", *(names or TREATED))), "bm25", HEADLINE)


@query(", " + TREATED_SQL + ", numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY treatment, metric, template ORDER BY qid::BIGINT) - 1 AS place, count(*) OVER (PARTITION BY treatment, metric, template) AS size FROM treated" + f"""
), picks AS (SELECT template, draw, ('0x' || substr(md5(draw || ':' || template || ':' || place), 1, 8))::BIGINT % size AS place
  FROM (SELECT DISTINCT template, place, size FROM numbered), (SELECT unnest(range({bootstrap.DRAWS})) AS draw)
), counted AS (SELECT template, draw, place, count(*) AS times FROM picks GROUP BY ALL
), drawn AS (SELECT treatment, metric, draw, sum(delta * times) / sum(times) AS m FROM counted JOIN numbered USING (template, place) GROUP BY ALL)
SELECT treatment, metric, round(delta, 8) AS delta, round(quantile_cont(m, 0.025), 8) AS ci_low, round(quantile_cont(m, 0.975), 8) AS ci_high, round(avg((m > 1e-12)::INT), 8) AS probability_positive
FROM drawn JOIN (SELECT treatment, metric, avg(delta) AS delta FROM numbered GROUP BY ALL) USING (treatment, metric) GROUP BY ALL""")
def bootstrap_native(fx):
    return _rounded(bootstrap.bootstrap_native(_treated(fx)), 8)


@query()
def bootstrap_deltas(fx):
    return bootstrap.bootstrap(_treated(fx))


THREE = ("bm25", "model", "exact_constraint_verifier")
FOUR = (*HEADLINE, "ndcg_at_100")


def _measured_sql(ranked: str, candidates: str) -> str:
    """The metrics of ranked (method, qid, ordinal, rank) over one set of candidates (qid, ordinal), restated."""
    ideal = lambda k: f"list_sum(list_transform(range(1, least(gold_size, {k}) + 1), lambda i: 1 / log2(i + 1)))"
    cuts = ", ".join(f"count(e.ordinal) FILTER (WHERE rank <= {k}) AS h{k}, coalesce(sum(1 / log2(rank + 1) ORDER BY rank) FILTER (WHERE rank <= {k} AND e.ordinal IS NOT NULL), 0) AS d{k}" for k in (5, 20, 100))
    recall, ndcg = ", ".join(f"round(coalesce(h{k}, 0) / gold_size, 9) AS recall_at_{k}" for k in (5, 20, 100)), ", ".join(f"round(coalesce(d{k}, 0) / {ideal(k)}, 9) AS ndcg_at_{k}" for k in (5, 20, 100))
    return f"""SELECT m.method, qid, template, n_atoms, gold_size, gold_size_bin, {recall}, round(coalesce(h100, 0) / least(gold_size, 100), 9) AS norm_recall_at_100, {ndcg},
    round(found / size, 9) AS candidate_precision, round(found / gold_size, 9) AS candidate_recall, round(CASE WHEN found = 0 THEN 0 ELSE 2 * (found / size) * (found / gold_size) / (found / size + found / gold_size) END, 9) AS candidate_f1,
    round(found / (gold_size + size - found), 9) AS candidate_jaccard, coalesce(retrieved, 0) AS retrieved_size, size AS candidate_size
  FROM (SELECT DISTINCT method FROM ({ranked})) m CROSS JOIN descr JOIN (SELECT c.qid, count(*) AS size, count(e.ordinal) AS found FROM ({candidates}) c LEFT JOIN exact e USING (qid, ordinal) GROUP BY c.qid) USING (qid)
  LEFT JOIN (SELECT method, r.qid, count(rank) AS retrieved, {cuts} FROM ({ranked}) r LEFT JOIN exact e USING (qid, ordinal) GROUP BY ALL) s ON s.method = m.method AND s.qid = descr.qid"""


SAME_POOL = f"""SELECT 'bm25' AS method, qid, ordinal, rank FROM pool WHERE rank <= {FINAL}
  UNION ALL SELECT 'model', qid, ordinal, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source_rank)::INT AS rank FROM ({LEXED})) WHERE rank <= {FINAL}
  UNION ALL SELECT 'exact_constraint_verifier', qid, ordinal, rank FROM (SELECT qid, ordinal, row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS rank FROM pool SEMI JOIN exact USING (qid, ordinal)) WHERE rank <= {FINAL}"""


def _same_pool(fx) -> DataFrame:
    """BM25, the model and the exact verifier over one pool, whose documents are the candidates of all three."""
    pool = fx.pool.select("qid", "ordinal", "rank")
    verified = fusion.full_verify(pool, fx.pool_gold, FINAL).select("qid", "ordinal", "rank")
    parts = [df.where(F.col("rank") <= FINAL).select(F.lit(name).alias("method"), "qid", "ordinal", "rank") for name, df in zip(THREE, (pool, fx.reranked, verified), strict=True)]
    return metrics.evaluate(_union(parts), fx.queries, fx.pool_gold, pool, about=fx.about)


@query(_measured_sql(SAME_POOL, "SELECT qid, ordinal FROM pool"))
def same_pool_eval(fx):
    return _rounded(_same_pool(fx))


@query()
def model_bootstraps(fx):
    """The model against BM25, and the exact verifier against the model."""
    return bootstrap.model_bootstraps(written(_same_pool(fx)), [THREE[:2], THREE[1:]], FOUR)


@query()
def non_negation_bootstrap(fx):
    """The model against BM25 on queries without negation."""
    rows = _same_pool(fx).where(~F.col("template").isin(*NEGATED))
    return bootstrap.model_bootstraps(written(rows), [THREE[:2]], ("ndcg_at_20",))


@query(f"SELECT method, count(*) AS n_queries, round(avg(recall_at_100), 8) AS recall_at_100, round(avg(ndcg_at_20), 8) AS ndcg_at_20 FROM ({_measured_sql(SAME_POOL, 'SELECT qid, ordinal FROM pool')}) WHERE template NOT IN ('_ that are also _ but not _', '_ that are not _') GROUP BY method")
def non_negation_means(fx):
    rows = _same_pool(fx).where(~F.col("template").isin(*NEGATED))
    return _rounded(rows.groupBy("method").agg(F.count("*").alias("n_queries"), F.avg("recall_at_100").alias("recall_at_100"), F.avg("ndcg_at_20").alias("ndcg_at_20")), 8)


@query()
def interval_check(fx):
    """Stored intervals against a new bootstrap: of those planted wrong, every value that differs."""
    deltas = written(_treated(fx, "full_verify"))
    stored = bootstrap.bootstrap(deltas).withColumn("ci_high", F.when(F.col("metric") == "ndcg_at_20", F.col("ci_high") + 0.001).otherwise(F.col("ci_high")))
    return bootstrap.check_intervals(stored, deltas).select("treatment", "metric", "column")


@query(r"""SELECT method, qid, depth::VARCHAR AS atomic_depth, '100' AS final_k, CASE WHEN family = 'bm25' THEN '200' END AS pool_k, CASE WHEN family IN ('full_verify', 'hybrid_verify') THEN '200' END AS full_query_pool,
  CASE WHEN composed THEN n_atoms WHEN family = 'hybrid_verify' THEN n_atoms - neg::INT END::VARCHAR AS atomic_lists, CASE WHEN composed THEN n_atoms * depth END::VARCHAR AS nominal_atomic_budget,
  CASE WHEN family = 'full_verify' THEN 200 WHEN family = 'hybrid_verify' THEN 200 + (n_atoms - neg::INT) * depth END::VARCHAR AS nominal_candidate_budget
FROM (SELECT *, try_cast(nullif(regexp_extract(method, '_L(\d+)$', 1), '') AS INT) AS depth, family IN ('compose_exact_not', 'compose_truncated_not', 'union_verify') AS composed FROM measured JOIN queries USING (qid))""")
def method_budgets(fx):
    """As text, blank where a method has none."""
    names = _union(df.select("method").distinct() for df in results(fx).values())
    rows = metrics.budgets(names.crossJoin(F.broadcast(fx.about)), POOL, FINAL)
    return rows.select("method", "qid", *(F.col(c).cast("string").alias(c) for c in rows.columns[2:]))


@query("SELECT template, count(*) AS n_queries, sum(g)::BIGINT AS gold_total FROM queries JOIN (SELECT qid, count(*) AS g FROM exact GROUP BY qid) USING (qid) GROUP BY template")
def audit_templates(fx):
    return sources.template_counts(fx.queries, fx.qrels)


@query("""SELECT qid, 'document' AS kind, c_name || '?' AS name FROM exact SEMI JOIN queries USING (qid) JOIN customer ON c_custkey = ordinal WHERE ordinal % 10 = 0
UNION ALL SELECT DISTINCT qid, 'attribute', attr FROM atoms WHERE attr NOT IN (SELECT attr FROM facts WHERE ordinal % 3 <> 0)""")
def unknown_references(fx):
    """Gold ids that were changed, and attributes that only left-out documents state."""
    gold = fx.qrels.join(fx.corpus.select("ordinal", "doc_id"), "ordinal").select("qid", F.when(F.col("ordinal") % 10 == 0, F.concat("doc_id", F.lit("?"))).otherwise(F.col("doc_id")).alias("doc_id"))
    return sources.unknown_references(fx.queries, gold, fx.corpus, fx.facts.where("ordinal % 3 <> 0"))


@query("""SELECT qid AS id, 'wrong_num_docs' AS rule FROM queries WHERE ordinal % 5 = 0 UNION ALL SELECT qid, 'duplicate_gold' FROM queries WHERE ordinal % 7 = 0
UNION ALL SELECT qid, 'no_text' FROM queries WHERE ordinal % 11 = 0 UNION ALL SELECT qid, 'no_plan' FROM queries WHERE ordinal % 13 = 0""")
def raw_query_violations(fx):
    gold = fx.qrels.groupBy("qid").agg(F.array_sort(F.collect_list(F.col("ordinal").cast("string"))).alias("docs"))
    planted = lambda n: F.col("ordinal") % n == 0
    docs = F.when(planted(7), F.concat("docs", F.slice("docs", 1, 1))).otherwise(F.col("docs"))
    raw = fx.queries.join(gold, "qid").select("ordinal", F.col("qid").alias("id"), F.when(planted(11), F.lit("")).otherwise(F.col("text")).alias("query"), docs.alias("docs"), "template", "attrs")
    raw = raw.withColumn("num_docs", F.size("docs").cast("long") + planted(5).cast("long")).withColumn("metadata", F.struct(F.when(~planted(13), F.col("template")).alias("template"), "attrs"))
    return sources.raw_query_violations(raw)


@query("""WITH RECURSIVE ranked(qid, n, twice) AS (SELECT item_id::VARCHAR, 3 - (item_id % 3 = 0)::INT, item_id % 5 = 0 FROM benchmark), counted AS (SELECT count(*) AS k FROM benchmark)
SELECT qid, 'too_short' AS rule FROM ranked WHERE n < 3 UNION ALL SELECT qid, 'duplicate_document' FROM ranked WHERE twice
UNION ALL SELECT qid, 'qid_out_of_range' FROM ranked, counted WHERE qid::BIGINT >= k OR qid::BIGINT < 0 UNION ALL SELECT i::VARCHAR, 'missing_qid' FROM (SELECT unnest(range(k)) AS i FROM counted) WHERE i NOT IN (SELECT qid::BIGINT FROM ranked)""")
def run_violations(fx):
    items = fx.read("benchmark").select("item_id")
    ranking = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    ranking = F.when(F.col("item_id") % 5 == 0, F.concat(F.slice(ranking, 1, F.size(ranking) - 1), F.array(F.lit("a")))).otherwise(ranking)
    return sources.run_violations(items.select(F.col("item_id").cast("string").alias("qid"), ranking.alias("ranking")), items.count(), 3)


@query("""SELECT sha256(string_agg('{"qid":"' || qid || '","ranking":[' || r || ']}' || chr(10), '' ORDER BY qid::BIGINT)) AS sha256, count(*) AS queries FROM (SELECT qid, string_agg('"' || ordinal || '"', ',' ORDER BY rank) AS r FROM pool GROUP BY qid)""")
def pool_digest(fx):
    """One digest of the whole pool, in the order of qid."""
    pool = fx.pool.select("qid", "ordinal", "rank")
    return fx.spark.createDataFrame([(sinks.pool_digest(pool, "ordinal"), pool.select("qid").distinct().count())], "sha256 string, queries long")


@query("""SELECT '$.counts.' || template AS path, n || ' != ' || (n + 1) AS difference FROM (SELECT template, count(*) AS n FROM queries GROUP BY template) WHERE n % 2 = 0
UNION ALL SELECT '$.sizes[' || (n - 1) || ']', 'left only' FROM (SELECT count(DISTINCT attr) AS n FROM facts) UNION ALL SELECT '$.exact', 'True != 1' UNION ALL SELECT '$.more', 'right only'""")
def manifest_differences(fx):
    """Differences of two nested objects over the collection: counts moved, the last size left out, a truth value as a number; a mean within the tolerance is none."""
    counts = {r.template: r.n for r in fx.queries.groupBy("template").agg(F.count("*").alias("n")).collect()}
    sizes = [r.posting_size for r in sources.postings(fx.facts).orderBy("attr").select("posting_size").collect()]
    mean = sum(sizes) / len(sizes)
    left = {"counts": counts, "sizes": sizes, "mean": mean, "exact": True}
    right = {"counts": {t: n + (n % 2 == 0) for t, n in counts.items()}, "sizes": sizes[:-1], "mean": mean * (1 + 1e-13), "exact": 1, "more": []}
    return fx.spark.createDataFrame(finished.differences(finished.leaves(left), finished.leaves(right)), "path string, difference string")


@query("""SELECT sum(n)::BIGINT AS pairs, round(sum(s), 9) AS seconds, round(sum(n) / sum(s), 9) AS pairs_per_second, round(count(*) * 200 / (sum(n) / sum(s)) / 3600, 9) AS projected_hours
FROM (SELECT qid, count(*) AS n, (1 + min(ordinal) % 7) / 4.0::DOUBLE AS s FROM pool WHERE rank > 1 GROUP BY qid)""")
def throughput(fx):
    """Of checkpoints over the pool without its first documents, with times made from its ids; projected to whole pools."""
    spent = (1 + F.min("ordinal").over(Window.partitionBy("qid")) % 7) / 4.0
    done = fx.pool.where("rank > 1").withColumn("seconds", spent)
    return _rounded(rerank.measured(done, fx.pool.select("qid").distinct(), POOL))


@query("SELECT attr AS qid, 'posting_size' AS \"column\", posting_size::VARCHAR AS left_value, (posting_size + 1)::VARCHAR AS right_value FROM (SELECT attr, count(*) AS posting_size FROM facts GROUP BY attr) WHERE posting_size % 2 = 0 UNION ALL SELECT attr, 'left_only', NULL, NULL FROM facts GROUP BY attr HAVING count(*) % 5 = 1 AND count(*) % 2 = 1")
def result_diff(fx):
    left = sources.postings(fx.facts).select(F.col("attr").alias("qid"), "posting_size")
    right = left.where("not (posting_size % 5 = 1 and posting_size % 2 = 1)").withColumn("posting_size", F.col("posting_size") + (F.col("posting_size") % 2 == 0).cast("long"))
    return report.result_diff(left, right, ["qid"])


@query(f"""SELECT 'pool_size' AS check_name, count(*) AS n, bool_and(n = least(200, (SELECT count(*) FROM corpus))) AS holds FROM (SELECT count(*) AS n FROM pool GROUP BY qid)
UNION ALL SELECT 'misses_sum', count(*), bool_and(lost = outside + late + beyond) FROM (
  SELECT gold_size - coalesce(hits, 0) AS lost, gold_size - coalesce(inside, 0) AS outside, least(100, coalesce(inside, 0)) - coalesce(hits, 0) AS late, coalesce(inside, 0) - least(100, coalesce(inside, 0)) AS beyond
  FROM (SELECT DISTINCT method FROM results WHERE family IN ('full_verify', 'hybrid_verify')) CROSS JOIN descr LEFT JOIN (SELECT method, qid, count(*) AS inside, count(*) FILTER (WHERE rank <= 100) AS hits FROM results SEMI JOIN exact USING (qid, ordinal) GROUP BY ALL) USING (method, qid))
UNION ALL SELECT 'three_methods_one_pool', count(*), bool_and(n = 3 AND a = b AND c = d) FROM (SELECT count(DISTINCT method) AS n, min(candidate_recall) AS a, max(candidate_recall) AS b, min(candidate_size) AS c, max(candidate_size) AS d FROM ({_measured_sql(SAME_POOL, "SELECT qid, ordinal FROM pool")}) GROUP BY qid)
UNION ALL SELECT 'delta_is_difference', count(*), bool_and(abs(d - (t - b)) <= 1e-12) FROM (SELECT treatment, metric, avg(delta) AS d FROM deltas GROUP BY ALL)
  JOIN (SELECT method AS treatment, metric, avg(value) AS t FROM long GROUP BY ALL) USING (treatment, metric) JOIN (SELECT metric, avg(value) AS b FROM long WHERE method = 'bm25' GROUP BY ALL) USING (metric)
UNION ALL SELECT 'exact_beats_pool', count(*), bool_and(e >= p) FROM (SELECT qid, max(recall_at_100) FILTER (WHERE family = 'exact') AS e, max(recall_at_100) FILTER (WHERE family = 'full_verify') AS p FROM measured GROUP BY qid)""")
def consistency_checks(fx):
    """Invariants as rows: full pools, miss kinds that add up, one pool for three methods, deltas that are differences of means."""
    size = F.least(F.lit(POOL).cast("long"), F.lit(fx.corpus.count()))
    row = lambda name, df, holds: df.agg(F.lit(name).alias("check_name"), F.count("*").alias("n"), F.bool_and(holds).alias("holds"))
    errors = _missed(fx, "full_verify", "hybrid_verify")
    three = _same_pool(fx).groupBy("qid").agg(F.count_distinct("method").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("candidate_recall", "candidate_size") for f in (F.min, F.max)))
    main = written(_main(fx))
    mean = main.select("method", F.expr(f"stack({len(HEADLINE)}, {', '.join(f"'{m}', {m}" for m in HEADLINE)}) as (metric, value)")).groupBy("method", "metric").agg(F.avg("value").alias("mean"))
    deltas = metrics.paired_deltas(main, "bm25", HEADLINE).groupBy("treatment", "metric").agg(F.avg("delta").alias("d"))
    deltas = deltas.join(mean.withColumnRenamed("method", "treatment"), ["treatment", "metric"]).join(mean.where("method = 'bm25'").select("metric", F.col("mean").alias("base")), "metric")
    best = main.groupBy("qid").agg(*(F.max(F.when(F.col("method") == m, F.col("recall_at_100"))).alias(m) for m in ("exact", "full_verify")))
    return _union([
        row("pool_size", fx.pool.groupBy("qid").agg(F.count("*").alias("size")), F.col("size") == size),
        row("misses_sum", errors, F.col("total_misses") == F.col("candidate_miss") + F.col("avoidable_ranking_miss") + F.col("structural_cutoff_miss")),
        row("three_methods_one_pool", three, (F.col("n") == 3) & (F.col("min_candidate_recall") == F.col("max_candidate_recall")) & (F.col("min_candidate_size") == F.col("max_candidate_size"))),
        row("delta_is_difference", deltas, F.abs(F.col("d") - (F.col("mean") - F.col("base"))) <= 1e-12),
        row("exact_beats_pool", best, F.col("exact") >= F.col("full_verify")),
    ])


@query(r"""WITH toks AS (SELECT doc_id AS ordinal, regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[-''’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]') AS l FROM documents
), dl AS (SELECT ordinal, len(l)::INT AS dl FROM toks), st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl
), tf AS (SELECT ordinal, term, count(*) AS tf FROM (SELECT ordinal, unnest(l) AS term FROM toks) GROUP BY ALL
), raw AS (SELECT term, ln(n_docs - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw_idf FROM tf, st GROUP BY term, n_docs
), idf AS (SELECT term, CASE WHEN raw_idf >= 0 THEN raw_idf ELSE 0.25::DOUBLE * (SELECT avg(raw_idf) FROM raw) END AS idf FROM raw
), asked AS (SELECT item_id::VARCHAR AS qid, text FROM benchmark
), qt AS (SELECT qid, term, min(pos) AS pos, count(*) AS qf FROM (SELECT qid, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM (SELECT qid, regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[-''’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]') AS l FROM asked)) GROUP BY ALL
), scored AS (SELECT qid, ordinal, sum(idf * qf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ORDER BY pos) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (ordinal), st GROUP BY qid, ordinal)
SELECT qid, ordinal, round(score, 6) AS score, rank FROM (SELECT a.qid, d.ordinal, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY a.qid ORDER BY round(coalesce(score, 0), 9) DESC, d.ordinal)::INT AS rank
  FROM asked a CROSS JOIN dl d LEFT JOIN scored s ON s.qid = a.qid AND s.ordinal = d.ordinal) WHERE rank <= 100""")
def free_text_topk(fx):
    """BM25 over the documents table: each benchmark text as a query, whole."""
    docs = fx.read("documents").select(F.col("doc_id").alias("ordinal"), "text")
    asked = fx.read("benchmark").select(F.col("item_id").cast("string").alias("qid"), "text")
    # the mean over a vocabulary of tens of thousands depends on the order of its sum in the last digits
    return _rounded(bm25.search(bm25.build(docs), asked, FINAL), 6)


#: Figures of the release, and what is planted in its files: a mean moved, one that is no number, a method left out, an interval moved.
RELEASED = ("recall_at_100", "norm_recall_at_100", "ndcg_at_20", "candidate_recall")


def _release(fx: Fixture) -> DataFrame:
    """Claims of per-query rows, of a summary written as CSV and read back, of an object written as JSON and read back, and of two interval tables."""
    rows = written(_main(fx))
    at = f"{shared_dir(fx.spark)}/release-{uuid.uuid4().hex}"
    moved = (F.col("method") == "full_verify") & (F.col("group_value") == "all")
    sinks.write_csv(metrics.summarise(rows).select("method", "group_value", *(F.when(moved, F.col(m) + 1e-9).otherwise(F.col(m)).alias(m) if m == "ndcg_at_20" else m for m in RELEASED)), f"{at}/summary")
    means = report.model_means(rows, RELEASED).where("method <> 'union_verify_L5'")
    odd = F.when(F.col("method") == "exact", F.lit(float("nan"))).otherwise(F.col("recall_at_100"))
    named = F.create_map(*(x for m in RELEASED for x in (F.lit(m), odd.cast("string") if m == "recall_at_100" else F.col(m).cast("string"))))
    means.agg(F.map_from_entries(F.collect_list(F.struct("method", named.alias("m")))).alias("means")).write.json(f"{at}/object")
    claims = evidence.row_claims(rows, RELEASED, "rows").unionByName(evidence.summary_claims(finished.read_csv(fx.spark, f"{at}/summary"), RELEASED, "summary"))
    claims = claims.unionByName(evidence.object_claims(fx.spark.read.schema("means map<string,map<string,string>>").json(f"{at}/object"), "means", "object"))
    stored = written(bootstrap.bootstrap(metrics.paired_deltas(rows.where("method in ('bm25', 'full_verify')"), "bm25", ("recall_at_100",)), 500))
    stored = stored.withColumn("ci_high", F.col("ci_high") + 1e-9)
    intervals = evidence.interval_claims(stored, "stored").unionByName(evidence.recomputed(rows, stored, ("recall_at_100",)))
    return claims.unionByName(intervals).unionByName(evidence.difference_claims(claims.where("source = 'rows' and method in ('bm25', 'full_verify') and metric = 'recall_at_100'"), "bm25"))


@query("""SELECT scope, method, metric, CASE WHEN scope <> 'all' THEN 2 WHEN method = 'union_verify_L5' THEN 2 ELSE 3 END::INT AS n_sources, NOT (scope = 'all' AND (method = 'full_verify' AND metric = 'ndcg_at_20' OR method = 'exact' AND metric = 'recall_at_100')) AS agree
FROM (SELECT DISTINCT method, unnest(['all', template, gold_size_bin]) AS scope FROM main), (SELECT unnest(['recall_at_100', 'norm_recall_at_100', 'ndcg_at_20', 'candidate_recall']) AS metric)
UNION ALL SELECT 'minus bm25', 'full_verify', 'recall_at_100' || s, 2 + (s = '')::INT, s <> '.ci_high' FROM (SELECT unnest(['', '.ci_low', '.ci_high', '.probability_positive']) AS s)""")
def release_evidence(fx):
    """Every figure of a release with the number of files that state it and whether they agree."""
    return evidence.evidence(_release(fx)).select("scope", "method", "metric", F.size("sources").alias("n_sources"), "agree")


@query("""SELECT qid AS subject, rule FROM (SELECT qid, 'wrong_pool' AS rule FROM pool GROUP BY qid HAVING count(*) <> 200 UNION ALL SELECT qid, 'metadata_differs' FROM queries WHERE ordinal % 10 = 0
UNION ALL SELECT qid, 'wrong_models' FROM queries WHERE ordinal % 7 = 0) UNION ALL SELECT DISTINCT template, 'wrong_template_count' FROM (SELECT template, count(*) AS n, count(*) FILTER (WHERE ordinal % 7 <> 0) AS m FROM queries GROUP BY template) WHERE n <> 64 OR m <> 64""")
def release_shape(fx):
    """What the per-query rows of three methods over one pool break: rows left out, and gold sizes changed, on purpose."""
    rows = _same_pool(fx).join(fx.queries.select("qid", "ordinal"), "qid").where("not (method = 'bm25' and ordinal % 7 = 0)")
    changed = (F.col("method") == THREE[2]) & (F.col("ordinal") % 10 == 0)
    return evidence.shape_violations(rows.withColumn("gold_size", F.col("gold_size") + changed.cast("int")), list(THREE), POOL, 64)


_fixtures: dict[tuple[str, str], Fixture] = {}


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    """One for each application and directory: its queries share tables. clear() forgets them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fixtures:
        _fixtures[key] = Fixture(spark, sf_dir)
    return _fixtures[key]


def clear() -> None:
    _fixtures.clear()


def _callable(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(fixture(spark, sf_dir))

    return run


@lru_cache(maxsize=1)
def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _callable(f) for name, f in Q.items()}


@lru_cache(maxsize=1)
def oracle_sql() -> dict[str, str]:
    return {name: sql if sql.startswith("WITH ") else BASE + sql for name, sql in SQL.items()}
