"""The retrieval operators on small tables with known answers."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline import catalog
from sieveline.functions.text import gold_size_bin, likes, regex_tokens, tokens, treebank_tokens
from sieveline.operators import bm25, boolean, bootstrap, diagnostics, fusion, metrics, report, rerank
from sieveline.plans import templates
from sieveline.sources import corpus as sources
from sieveline.sources import sinks

POSTINGS = {"Apple": [1, 2, 4], "Pineapple": [3], "Blue": [2, 3, 4], "Round": [1, 2, 3]}
PLANS = [
    (templates.ATOM, ["Apple"], {1, 2, 4}), (templates.OR_2, ["Apple", "Pineapple"], {1, 2, 3, 4}), (templates.OR_3, ["Apple", "Pineapple", "Blue"], {1, 2, 3, 4}),
    (templates.AND_2, ["Apple", "Blue"], {2, 4}), (templates.AND_3, ["Apple", "Blue", "Round"], {2}), (templates.AND_NOT_3, ["Apple", "Blue", "Round"], {4}), (templates.NOT_2, ["Apple", "Blue"], {1}),
]


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([(d, a) for a, ds in POSTINGS.items() for d in ds], "ordinal long, attr string")


def plan_table(spark, *plans):
    return spark.createDataFrame([(str(i), i, t, a) for i, (t, a) in enumerate(plans)], "qid string, ordinal long, template string, attrs array<string>")


def test_likes(spark):
    cases = {
        "Ada Example likes Apples, Candy Canes, Research and Jazz.": ["Apples", "Candy Canes", "Research", "Jazz"],
        "Ada Example likes Rock and Roll, Apples, Jazz and Tea.": ["Rock and Roll", "Apples", "Jazz", "Tea"],
        "No predicate here.": [], "A likes B and C.": ["B and C"], "A likes B, and C.": ["B", "C"], "A likes B, And C and D...": ["B", "C", "D"], "A likes ,,B.": ["B"], "A dislikes B, C.": ["B", "C"],
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", likes("t").alias("a")).collect()
    assert {r.t: r.a for r in got} == cases


def test_tokenizers(spark):
    row = spark.createDataFrame([("Ada's well-known Apple, apple: don't! (ok) 3.5 ä.",)], "t string").select(regex_tokens("t").alias("r"), treebank_tokens("t").alias("b")).first()
    assert row.r == ["Ada's", "well-known", "Apple", ",", "apple", ":", "don't", "!", "(", "ok", ")", "3", ".", "5", "ä", "."]
    assert row.b == ["Ada", "'s", "well-known", "Apple", ",", "apple", ":", "do", "n't", "!", "(", "ok", ")", "3.5", "ä", "."]
    with pytest.raises(ValueError):
        tokens("t", "no such")


def test_plans_and_boolean_forms(spark, facts):
    plans = plan_table(spark, *[(t, a) for t, a, _ in PLANS])
    exact = {}
    for r in boolean.execute(templates.atoms(plans), facts).collect():
        exact.setdefault(int(r.qid), set()).add(r.ordinal)
    assert exact == {i: w for i, (_, _, w) in enumerate(PLANS)}
    for i, (t, a, want) in enumerate(PLANS):
        one = plans.where(F.col("qid") == str(i))
        form = {templates.ATOM: lambda: boolean.atom(one, facts), templates.OR_2: lambda: boolean.union(one, facts, 2), templates.OR_3: lambda: boolean.union(one, facts, 3), templates.AND_2: lambda: boolean.intersection(one, facts, 2), templates.AND_3: lambda: boolean.intersection(one, facts, 3), templates.AND_NOT_3: lambda: boolean.difference(one, facts, 3), templates.NOT_2: lambda: boolean.difference(one, facts, 2)}[t]
        assert {r.ordinal for r in form().collect()} == want
    text = {r.qid: r.q for r in plan_table(spark, (templates.AND_NOT_3, ["A", "B", "C"]), (templates.AND_3, ["A", "B", "C"])).select("qid", templates.render().alias("q")).collect()}
    assert text == {"0": "Who likes A and also likes B but not C?", "1": "Who likes A and also likes both B and C?"}


def _lists(spark, **rankings):
    return spark.createDataFrame([(a, d, k + 1, 1) for a, ds in rankings.items() for k, d in enumerate(ds[:1])], "attr string, ordinal long, rank int, depth int")


def test_composition(spark, facts):
    atoms = templates.atoms(plan_table(spark, (templates.NOT_2, ["Apple", "Blue"])))
    lists = _lists(spark, Apple=[4, 1, 2], Blue=[3, 4, 2])
    assert fusion.compose_exact_not(atoms, lists, facts, 10).count() == 0
    assert [r.ordinal for r in fusion.compose_truncated_not(atoms, lists, 10).collect()] == [4]
    both = templates.atoms(plan_table(spark, (templates.AND_2, ["Apple", "Blue"])))
    lists = _lists(spark, Apple=[4], Blue=[3])
    assert fusion.compose_exact_not(both, lists, facts, 10).count() == 0
    assert [r.ordinal for r in fusion.union_verify(both, lists, boolean.execute(both, facts), 10).collect()] == [4]
    with pytest.raises(ValueError):
        fusion.prefixes(lists, [0])


def test_bm25(spark):
    corpus = spark.createDataFrame([(0, "Ada likes Apples."), (1, "Bea likes Apples."), (2, "Cal likes Pears.")], "ordinal long, text string")
    asked = spark.createDataFrame([("q", "Who likes Apples?")], "qid string, text string")
    index = bm25.build(corpus)
    got = [(r.rank, r.ordinal) for r in bm25.top_k(bm25.scores(index, asked), asked, index.docs, 3).orderBy("rank").collect()]
    assert [r for r, _ in got] == [1, 2, 3] and {o for _, o in got} == {0, 1, 2} and [o for _, o in got if o < 2] == [0, 1]
    same = spark.createDataFrame([(i, "alpha") for i in range(20)], "ordinal long, text string")
    alpha = spark.createDataFrame([("a", "alpha"), ("b", "nothing known")], "qid string, text string")
    index = bm25.build(same)
    found = bm25.top_k(bm25.scores(index, alpha), alpha, index.docs, 10)
    for q in "ab":
        assert [r.ordinal for r in found.where(F.col("qid") == q).orderBy("rank").collect()] == list(range(10))
    with pytest.raises(ValueError, match="ties go by"):
        bm25.top_k(found, alpha, index.docs, 3, "not-a-mode")


def _evaluate(spark, ranking, gold, candidates=None):
    queries = plan_table(spark, (templates.ATOM, ["x"]))
    qrels = spark.createDataFrame([("0", g) for g in gold], "qid string, ordinal long")
    ranks = {d: k + 1 for k, d in enumerate(dict.fromkeys(ranking))}
    rows = [("m", "0", d, ranks.get(d)) for d in dict.fromkeys([*ranking, *(candidates or [])])]
    results = spark.createDataFrame(rows, "method string, qid string, ordinal long, rank int")
    return metrics.evaluate(results, queries, qrels).first(), metrics.ranking_errors(results, queries, qrels, 100).first(), results, queries, qrels


def test_metrics(spark):
    row, *_ = _evaluate(spark, [1, 1, 9], [1, 2])
    assert row.recall_at_5 == 0.5
    row, errors, *_ = _evaluate(spark, list(range(100)), list(range(171)), list(range(171)))
    assert row.recall_at_100 == pytest.approx(100 / 171) and row.norm_recall_at_100 == 1 and row.ndcg_at_100 == pytest.approx(1)
    assert (errors.candidate_miss, errors.avoidable_ranking_miss, errors.structural_cutoff_miss, errors.total_misses) == (0, 0, 71, 71)
    *_, results, queries, qrels = _evaluate(spark, [1, 24], [1, 2, 3, 4, 5], [1, 2, 3, 4, 24])
    e = metrics.ranking_errors(results, queries, qrels, 2).first()
    assert (e.total_misses, e.candidate_miss, e.avoidable_ranking_miss, e.structural_cutoff_miss) == (4, 1, 1, 2)
    assert [r.b for r in spark.createDataFrame([(n,) for n in (1, 5, 6, 50, 100, 500)], "n int").select(gold_size_bin("n").alias("b")).collect()] == ["01-02", "03-05", "06-20", "21-50", "51-100", "101-200"]


def test_atomic_diagnostics(spark):
    facts = spark.createDataFrame([(0, "A"), (2, "A"), (1, "B")], "ordinal long, attr string")
    atoms = templates.atoms(plan_table(spark, (templates.ATOM, ["A"]), (templates.NOT_2, ["A", "B"])))
    full = spark.createDataFrame([("A", d, k + 1) for k, d in enumerate([1, 0, 2])] + [("B", d, k + 1) for k, d in enumerate([0, 1, 2])], "attr string, ordinal long, rank int")
    table = diagnostics.atomic_diagnostics(atoms, fusion.prefixes(full, [1, 2, 3]), facts, [1, 2, 3])
    a = table.where("attr = 'A' and depth = 2").first()
    assert (a.posting_size, a.relevant_retrieved, a.structural_misses, a.avoidable_misses, a.first_relevant_rank, a.recall, a.positive_occurrences) == (2, 1, 0, 1, 2, 0.5, 2)
    s = diagnostics.atomic_summary(table).where("depth = 2").first()
    assert s.unique_attrs == 2 and s.posting_weighted_recall == pytest.approx(2 / 3) and s.macro_recall == 0.75 and s.positive_weighted_recall == 0.5 and s.negative_weighted_recall == 1.0


def test_bootstrap(spark):
    rows = [("t", "m", str(i), s, 0.1) for i, s in enumerate("aabb")]
    r = bootstrap.bootstrap(spark.createDataFrame(rows, "treatment string, metric string, qid string, template string, delta double"), 500, 7).first()
    assert r.delta == pytest.approx(0.1) and r.ci_low > 0
    assert bootstrap.resampled_means(np.array([1.0, 3.0]), np.array(["a", "b"]), 5, 1).tolist() == [2.0] * 5


def test_rerank_checkpoints(spark):
    pool = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("p", 1, 1)], "qid string, ordinal long, rank int")
    done = spark.createDataFrame([("q", 1, 1, 0.5), ("q", 2, 2, float("nan"))], "qid string, ordinal long, source_rank int, score double")
    assert [r.qid for r in rerank.incompatible(pool, done).collect()] == ["q"]
    assert sorted(r.qid for r in rerank.pending(pool, done).collect()) == ["p", "q"]
    assert rerank.incompatible(pool.where("qid = 'q'"), done.withColumn("score", F.lit(1.0))).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    good = tmp_path / "c.jsonl"
    good.write_text('{"_id": "a", "text": "A likes B."}\n\n{"_id": "b", "text": "x"}\n{"_id": "b", "text": ""}\n')
    rows = sources.jsonl(spark, str(good), sources.CORPUS)
    assert rows.count() == 3
    found = {(r.doc_id, r.rule) for r in sources.corpus_violations(rows.withColumnRenamed("_id", "doc_id")).collect()}
    assert found == {("b", "duplicate_id"), ("b", "no_facts"), ("b", "empty_text")}
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"_id": "a", "text": "t"}\nnot json\n')
    assert [r._corrupt for r in sources.corrupt_lines(spark, str(bad), sources.CORPUS).collect()] == ["not json"]
    sums = sources.checksums(spark, [str(good), str(bad)])
    want = spark.createDataFrame([("c.jsonl", "0" * 64), ("gone.jsonl", "0" * 64)], "file string, sha256 string")
    assert {(r.file, r.rule) for r in sources.checksum_violations(sums, want).collect()} == {("c.jsonl", "mismatch"), ("gone.jsonl", "missing")}
    run = spark.createDataFrame([("q", 1, "a", 0.5), ("q", 2, "b", 0.25)], "qid string, rank int, doc_id string, score double")
    sinks.write_run(run, str(tmp_path / "run"))
    assert [(r.rank, r.doc_id, r.score) for r in sources.load_run(spark, str(tmp_path / "run")).orderBy("rank").collect()] == [(1, "a", 0.5), (2, "b", 0.25)]
    with pytest.raises(ValueError):
        sinks.write_csv(run.limit(0), str(tmp_path / "none"))


def test_result_diff_rejects_other_columns(spark):
    a = spark.createDataFrame([("k", 1.0)], "k string, v double")
    assert report.result_diff(a, a.withColumn("v", F.col("v") + 1e-14), ["k"]).count() == 0
    assert report.result_diff(a, a.withColumn("v", F.lit(float("nan"))), ["k"]).count() == 1
    with pytest.raises(ValueError):
        report.result_diff(a, a.withColumnRenamed("v", "w"), ["k"])


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["facts", "exact_oracle", "bm25_topk", "hybrid_verify", "metrics_per_query", "summary_metrics", "atomic_summary", "composition_errors", "bootstrap_native", "result_diff"])
def test_catalog_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want, got = con.sql(catalog.oracle_sql()[name]).df(), catalog.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns) and len(want) == len(got)
    plain = lambda df: df[cols].map(lambda v: None if v is None or v != v else round(float(v), 8) if isinstance(v, float) else v).astype(str).sort_values(cols).values.tolist()
    assert sorted(plain(want)) == sorted(plain(got))


def test_plans_are_executed_once(spark, monkeypatch):
    calls, execute = [], catalog.boolean.execute
    monkeypatch.setattr(catalog.boolean, "execute", lambda *a: calls.append(a) or execute(*a))
    fx = catalog.Fixture(spark, "/root/testdata/sf0.001")
    asked, exact = fx.queries, fx.exact
    assert len(calls) == 1
    assert exact.count() and sorted(exact.collect()) == sorted(execute(fx.atoms, fx.facts).collect())
    assert {r.qid for r in asked.collect()} == {r.qid for r in exact.collect()}


def test_errors_count_a_repeated_document_once_and_refuse_outsiders(spark):
    queries = spark.createDataFrame([("q", "_", ["a"])], "qid string, template string, attrs array<string>")
    qrels = spark.createDataFrame([("q", 1), ("q", 2)], "qid string, ordinal long")
    ranked = spark.createDataFrame([("m", "q", 1, r) for r in (1, 2, 3)] + [("m", "q", 7, 4)], "method string, qid string, ordinal long, rank int")
    e = metrics.ranking_errors(ranked, queries, qrels, 5).first()
    assert (e.total_misses, e.candidate_miss, e.avoidable_ranking_miss, e.structural_cutoff_miss) == (1, 1, 0, 0)
    pool = spark.createDataFrame([("q", 1), ("q", 2), ("q", 7), ("q", 1)], "qid string, ordinal long")
    e = metrics.ranking_errors(ranked, queries, qrels, 5, pool).first()
    assert (e.total_misses, e.candidate_miss, e.avoidable_ranking_miss, e.structural_cutoff_miss) == (1, 0, 1, 0)
    with pytest.raises(ValueError, match="outside the candidates"):
        metrics.ranking_errors(ranked, queries, qrels, 5, pool.where("ordinal <> 7"))


def test_what_plans_find_is_not_shuffled(spark, facts):
    """Plans that are few go to the facts; a document's facts are together before they meet them."""
    plans = plan_table(spark, *[(t, a) for t, a, _ in PLANS])
    found = boolean.execute(templates.atoms(plans), facts)
    assert {(int(r.qid), r.ordinal) for r in found.collect()} == {(i, d) for i, (_, _, want) in enumerate(PLANS) for d in want}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ordinal" in plan and "hashpartitioning(qid" not in plan


def test_many_plans_find_the_same(spark, facts, monkeypatch):
    atoms = templates.atoms(plan_table(spark, *[(t, a) for t, a, _ in PLANS]))
    few = sorted(boolean.execute(atoms, facts).collect())
    monkeypatch.setattr(boolean, "BROADCAST", 0)
    assert sorted(boolean.execute(atoms, facts).collect()) == few


def test_oracle_ranking_sorts_only_what_it_ranks(spark):
    sets = {"a": [5, 1, 9, 3], "b": [2], "c": [4, 7]}
    exact = spark.createDataFrame([(q, d) for q, ds in sets.items() for d in ds], "qid string, ordinal long")
    ranked = boolean.oracle_ranking(exact, 2)
    assert ranked.columns == ["qid", "ordinal", "rank"] and dict(ranked.dtypes)["rank"] == "int"
    assert {(r.qid, r.ordinal, r.rank) for r in ranked.collect()} == {("a", 1, 1), ("a", 3, 2), ("a", 5, None), ("a", 9, None), ("b", 2, 1), ("c", 4, 1), ("c", 7, 2)}
    assert "Window" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_metrics_of_rankings_need_only_the_gold_they_can_have(spark):
    """With the sizes of all gold at hand, gold that no ranking has can be left out; a document twice in a ranking and one without a rank count as before."""
    queries = plan_table(spark, (templates.ATOM, ["x"]), (templates.ATOM, ["y"]))
    qrels = spark.createDataFrame([("0", d) for d in (1, 2, 3, 50, 60)] + [("1", 7)], "qid string, ordinal long")
    results = spark.createDataFrame([("m", "0", 9, 1), ("m", "0", 1, 2), ("m", "0", 1, 5), ("m", "0", 2, 7), ("m", "0", 3, None)], "method string, qid string, ordinal long, rank int")
    known, about = qrels.where("ordinal < 10 and qid = '0'"), metrics.described(queries, qrels, distinct=True)
    assert sorted(about.collect()) == sorted(metrics.described(queries, qrels).collect())
    rows = sorted(metrics.evaluate(results, queries, qrels).collect())
    assert sorted(metrics.evaluate(results, queries, known, about=about).collect()) == rows
    assert [(r.qid, r.gold_size, r.recall_at_5, r.candidate_recall, r.retrieved_size, r.candidate_size) for r in rows] == [("0", 5, 0.4, 0.6, 3, 4), ("1", 1, 0.0, 0.0, 0, 0)]
    errors = sorted(metrics.ranking_errors(results, queries, qrels, 2).collect())
    assert sorted(metrics.ranking_errors(results, queries, known, 2, about=about).collect()) == errors
    assert [(e.total_misses, e.candidate_miss, e.avoidable_ranking_miss, e.structural_cutoff_miss) for e in errors] == [(4, 2, 1, 1), (1, 1, 0, 0)]


def test_methods_find_the_same_in_the_gold_they_are_offered(spark, monkeypatch):
    """Gold that the pool and the lists do not have changes no method, error or metric."""
    monkeypatch.setattr(catalog, "POOL", 20)  # of 150 documents
    monkeypatch.setattr(catalog, "DEPTHS", (2, 5))
    fx = catalog.Fixture(spark, SF)
    assert 0 < fx.offered("hybrid_verify").count() < fx.exact.count()
    whole = {
        "union_verify": fusion.union_verify(fx.atoms, fx.lists, fx.exact, catalog.FINAL), "full_verify": fusion.full_verify(fx.pool, fx.exact, catalog.FINAL),
        "hybrid_verify": fusion.hybrid_verify(fx.atoms, fx.lists, fx.pool, fx.exact, catalog.DEPTHS, catalog.FINAL),
    }
    made = catalog.results(fx, *whole)
    for name, df in whole.items():
        assert sorted(map(str, made[name].collect())) == sorted(map(str, catalog._method(name, df).collect()))
    names = [*whole, "bm25", "compose_exact_not"]
    rankings = catalog._union(catalog.results(fx, *names).values())
    assert sorted(metrics.evaluate(rankings, fx.queries, fx.qrels).collect()) == sorted(catalog._evaluated(fx, *names).collect())
    assert sorted(metrics.ranking_errors(rankings, fx.queries, fx.qrels, catalog.FINAL).collect()) == sorted(catalog._missed(fx, *names).collect())


def test_method_bm25_ranks_the_whole_corpus(spark, monkeypatch):
    """No pool cuts its candidates: the measures are those of every document ranked by all scores, whatever the pool. Gold without a document is not found; candidates that are only counted count alike."""
    monkeypatch.setattr(catalog, "POOL", 20)  # of 150 documents
    monkeypatch.setattr(catalog, "FINAL", 30)
    read = catalog.Fixture.read
    monkeypatch.setattr(catalog.Fixture, "read", lambda fx, name: read(fx, name).where("c_custkey % 9 <> 0") if name == "customer" else read(fx, name))
    fx = catalog.Fixture(spark, SF)
    n = fx.corpus.count()
    ranked = bm25.top_k(catalog.written(bm25.scores(fx.index, fx.queries)), fx.queries, fx.index.docs, n)
    assert n > 100 and ranked.count() == n * fx.queries.count()
    every = ranked.select(F.lit("bm25").alias("method"), "qid", "ordinal", F.when(F.col("rank") <= 30, F.col("rank")).alias("rank"))
    rows = sorted(catalog.method_bm25(fx).collect())
    assert rows == sorted(catalog._rounded(metrics.evaluate(every, fx.queries, fx.exact)).collect())
    assert {(r.candidate_size, r.retrieved_size) for r in rows} == {(n, 30)}
    found = {r.qid: r["count"] for r in fx.exact.join(fx.corpus, "ordinal").groupBy("qid").count().collect()}
    assert {r.qid: round(r.candidate_recall * r.gold_size) for r in rows if r.candidate_recall} == found and 0 < sum(r.candidate_recall < 1 for r in rows) < len(rows)
    assert "pool" not in vars(fx) and "atomic" not in vars(fx)
    queries = plan_table(spark, (templates.ATOM, ["x"]), (templates.ATOM, ["y"]))
    qrels = spark.createDataFrame([("0", 1), ("0", 2), ("1", 7)], "qid string, ordinal long")
    results = spark.createDataFrame([("m", "0", 9, 1), ("m", "0", 1, 2)], "method string, qid string, ordinal long, rank int")
    counted = spark.createDataFrame([("0", 2, 9), ("1", 0, 9)], "qid string, found long, candidate_size long")
    got = metrics.evaluate(results, queries, qrels, counted=counted).orderBy("qid").collect()
    assert [(r.recall_at_5, r.candidate_recall, r.candidate_precision, r.retrieved_size, r.candidate_size) for r in got] == [(0.5, 1.0, 2 / 9, 2, 9), (0.0, 0.0, 0.0, 0, 9)]


def test_a_method_alone_asks_no_lists(spark):
    fx = catalog.Fixture(spark, SF)
    assert catalog._evaluated(fx, "bm25").count() == fx.queries.count()
    assert "atomic" not in vars(fx) and "list_gold" not in vars(fx)


def test_intervals_of_one_method_ask_for_no_other(spark):
    fx = catalog.Fixture(spark, SF)
    assert [tuple(r) for r in catalog.interval_check(fx).collect()] == [("full_verify", "ndcg_at_20", "ci_high")]
    assert "atomic" not in vars(fx) and "list_gold" not in vars(fx)
    whole = catalog._treated(fx).where("treatment = 'full_verify'")
    assert sorted(catalog._treated(fx, "full_verify").collect()) == sorted(whole.collect())


def _shuffled(spark, run) -> int:
    """Rows that stages of run write to shuffles."""
    sc, java = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    stages = lambda: sc.statusStore().stageList(None, False, False, java.new_array(java.jvm.double, 0), None)
    last = max((s.stageId() for s in map(stages().apply, range(stages().size()))), default=-1)
    run()
    sc.listenerBus().waitUntilEmpty()
    found = stages()
    return sum(s.shuffleWriteRecords() for s in map(found.apply, range(found.size())) if s.stageId() > last)


def test_exact_exclusion_shuffles_only_what_lists_have(spark):
    """Documents of the negated posting that no list has are not shuffled, however many."""
    atoms = templates.atoms(plan_table(spark, (templates.NOT_2, ["x", "y"])))
    lists = spark.createDataFrame([("x", 1, 1, 5), ("x", 2, 2, 5), ("x", 3, 3, 5), ("y", 3, 1, 5)], "attr string, ordinal long, rank int, depth int")
    posting = spark.range(2, 5002).selectExpr("'y' as attr", "id as ordinal").where("ordinal <> 3")
    facts = posting.union(spark.createDataFrame([("x", 1), ("x", 2), ("x", 3)], "attr string, ordinal long"))
    found = []
    assert _shuffled(spark, lambda: found.extend(fusion.compose_exact_not(atoms, lists, facts, 5).collect())) < 1000
    assert [(r.ordinal, r["rank"]) for r in found] == [(1, 1), (3, 2)]


def test_rankings_meet_gold_in_one_shuffle_of_each(spark):
    qrels = spark.createDataFrame([("0", d) for d in (1, 2, 3)], "qid string, ordinal long")
    results = spark.createDataFrame([("m", "0", 1, 1), ("m", "0", 9, 2), ("m", "0", 1, 3)], "method string, qid string, ordinal long, rank int")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where gold is large
    try:
        marked = metrics._marked(results, qrels)
        assert {(r.ordinal, r.first, r.hit) for r in marked.collect()} == {(1, 1, True), (9, 2, False)}
        plan = marked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert plan.count(" Exchange ") == 2
