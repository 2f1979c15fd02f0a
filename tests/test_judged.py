"""A gold that is independent of the engine: judged in plain Python on the orders of the smallest tables."""

from pyspark.sql import functions as F

from sieveline import catalog

SF = "/root/testdata/sf0.001"


def test_judged_gold_is_that_of_the_orders(spark):
    fx = catalog.fixture(spark, SF)
    part = {r.p_partkey: r.p_name for r in fx.read("part").collect()}
    customer = {r.o_orderkey: r.o_custkey for r in fx.read("orders").collect()}
    has: dict[int, set[str]] = {}
    for r in fx.read("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag").collect():
        if r.l_quantity >= 46 and r.l_returnflag != "R":
            has.setdefault(customer[r.l_orderkey], set()).add(part[r.l_partkey])
    want = set()
    for q in fx.queries.collect():
        negated = q.template in catalog.NEGATED
        asked, barred = (q.attrs[:-1], q.attrs[-1:]) if negated else (q.attrs, [])
        every = any if " or " in q.template else all
        want |= {(q.qid, c) for c, own in has.items() if every(a in own for a in asked) and not any(a in own for a in barred)}
    assert {(r.qid, r.ordinal) for r in fx.judged.collect()} == want


def test_exact_methods_are_not_perfect_by_it(spark):
    rows = catalog.queries()["judged_metrics"](spark, SF).where(F.col("method") == "exact").agg(F.avg("candidate_precision").alias("p"), F.avg("candidate_recall").alias("r")).first()
    assert 0 < rows.p < 1 and 0 < rows.r < 1


def test_errors_add_up(spark):
    rows = catalog.queries()["judged_errors"](spark, SF)
    assert rows.where("candidate_miss + avoidable_ranking_miss + structural_cutoff_miss <> total_misses or candidate_miss < 0").isEmpty()
    assert not rows.where("method = 'exact' and candidate_miss > 0").isEmpty()
