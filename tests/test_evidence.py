"""Cross-checks of a release on small tables with planted faults."""

import math

import pytest

from sieveline.operators import bootstrap, evidence, metrics

ROW = "method string, qid string, template string, gold_size_bin string, gold_size long, candidate_size long, candidate_recall double, ndcg_at_20 double"


def rows(spark, n=8):
    value = lambda m, i: ((i * 7 + {"a": 0, "b": 3, "c": 5}[m]) % 10) / 10
    return spark.createDataFrame([(m, str(i), f"t{i % 2}", "01-02", 2, 4, 0.5, value(m, i)) for m in "abc" for i in range(n)], ROW)


def claims(spark, *got):
    return spark.createDataFrame([("all", m, "x", s, v) for m, s, v in got], "scope string, method string, metric string, source string, value double")


def test_agreement_is_within_tolerance_and_finite(spark):
    given = claims(spark, ("same", "p", 0.5), ("same", "q", 0.5 + 4e-13), ("off", "p", 0.5), ("off", "q", 0.5 + 3e-12), ("large", "p", 1e6), ("large", "q", 1e6 + 1e-7), ("nan", "p", math.nan), ("nan", "q", 0.5), ("inf", "p", math.inf), ("null", "p", None), ("alone", "p", 1.0), ("twice", "p", 1.0), ("twice", "p", 2.0))
    found = evidence.evidence(given)
    assert {r.method: r.agree for r in found.collect()} == {"same": True, "off": False, "large": True, "nan": False, "inf": False, "null": False, "alone": True, "twice": False}
    broken = {(r.method, r.rule) for r in evidence.violations(found, 2).collect()}
    assert broken == {(m, "disagrees") for m in ("off", "nan", "inf", "null", "twice")} | {(m, "too_few_sources") for m in ("inf", "null", "alone", "twice")}
    assert evidence.evidence(given.limit(0)).count() == 0


def test_means_summaries_and_objects_are_the_same_claims(spark):
    table = rows(spark)
    own = evidence.row_claims(table, ("ndcg_at_20",), "rows")
    summary = table.groupBy("method").agg({"ndcg_at_20": "avg"}).toDF("method", "ndcg_at_20").selectExpr("method", "'all' as group_value", "ndcg_at_20")
    means = {r.method: {"ndcg_at_20": r.ndcg_at_20} for r in summary.collect()}
    means["b"]["ndcg_at_20"] += 1e-6
    listed = spark.createDataFrame([(means,)], "m map<string,map<string,double>>")
    whole = own.unionByName(evidence.summary_claims(summary, ("ndcg_at_20",), "summary")).unionByName(evidence.object_claims(listed, "m", "object"))
    found = {(r.scope, r.method): (len(r.sources), r.agree) for r in evidence.evidence(whole).collect()}
    assert found[("all", "a")] == (3, True) and found[("all", "b")] == (3, False) and found[("t0", "a")] == (1, True) and ("01-02", "c") in found


def test_intervals_are_recomputed_by_their_own_draws_and_seed(spark):
    table = rows(spark, 20)
    stored = bootstrap.bootstrap(metrics.paired_deltas(table, "a", ("ndcg_at_20",)), 200, 7, "a")
    again = evidence.recomputed(table, stored, ("ndcg_at_20",))
    whole = evidence.interval_claims(stored, "stored").unionByName(again).unionByName(evidence.difference_claims(evidence.row_claims(table, ("ndcg_at_20",), "rows"), "a"))
    found = {(r.method, r.metric): (len(r.sources), r.agree) for r in evidence.evidence(whole).collect()}
    assert found == {(m, f"ndcg_at_20{s}"): (3 if not s else 2, True) for m in "bc" for s in ("", ".ci_low", ".ci_high", ".probability_positive")}
    other = evidence.interval_claims(stored.selectExpr("*").withColumn("ci_low", stored.ci_low + 1e-9), "stored").unionByName(again)
    assert {(r.method, r.metric) for r in evidence.violations(evidence.evidence(other)).collect()} == {("b", "ndcg_at_20.ci_low"), ("c", "ndcg_at_20.ci_low")}


def test_quoted_values(spark):
    given = claims(spark, ("a", "p", 0.63249), ("b", "p", 0.7336), ("b", "q", 0.7324))
    quoted = spark.createDataFrame([("all", "a", "x", "0.632"), ("all", "b", "x", "0.734"), ("all", "c", "x", "1.000")], "scope string, method string, metric string, quoted string")
    assert {(r.method, r.actual) for r in evidence.misquoted(given, quoted).collect()} == {("b", "0.732"), ("c", None)}


@pytest.mark.parametrize(
    ("fault", "want"),
    [
        ("true", set()), ("not (method = 'c' and qid = '3')", {("3", "wrong_models"), ("t1", "wrong_template_count")}),
        ("method <> 'c'", {(str(i), "wrong_models") for i in range(8)}),
    ],
)
def test_shape(spark, fault, want):
    table = rows(spark).where(fault)
    assert {tuple(r) for r in evidence.shape_violations(table, ["c", "a", "b"], 4, 4).collect()} == want


def test_shape_of_pools_and_metadata(spark):
    table = rows(spark)
    odd = table.selectExpr("method", "qid", "if(method = 'a' and qid = '1', 't0', template) as template", "gold_size", "candidate_size + int(qid = '2') as candidate_size", "if(method = 'b' and qid = '5', 0.4, candidate_recall) as candidate_recall")
    assert {tuple(r) for r in evidence.shape_violations(odd, ["a", "b", "c"], 4).collect()} == {("1", "metadata_differs"), ("5", "metadata_differs"), ("2", "wrong_pool")}
    twice = table.unionByName(table.where("method = 'a' and qid = '0'"))
    assert {tuple(r) for r in evidence.shape_violations(twice, ["a", "b", "c"], 4).collect()} == {("0", "wrong_models")}
    assert evidence.shape_violations(table.limit(0), ["a"], 4, 4).count() == 0


def test_numbers(spark):
    given = spark.createDataFrame([("0",), ("2",), ("x",), ("7",), ("2",)], "qid string")
    assert {tuple(r) for r in evidence.misnumbered(given, 4).collect()} == {("x", "unexpected"), ("7", "unexpected"), ("1", "missing"), ("3", "missing")}
