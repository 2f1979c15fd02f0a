"""Runs, checkpoints, results and their comparison; search against scores of everything; the bootstrap's draws."""

import gzip
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline import __main__ as cli
from sieveline.operators import bm25, bootstrap, metrics, rerank
from sieveline.plans import templates
from sieveline.sources import corpus as sources
from sieveline.sources import files, results, sinks
from test_cli import _collection


def test_search_is_the_top_k_of_all_scores(spark):
    """Templated queries of common words, free queries of rare ones, and queries that hardly anything answers."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, "who likes " + " ".join(rng.choice(words, rng.integers(1, 12), p=(p := 1 / np.arange(1, 401)) / p.sum())) + (" ." if i % 3 else "")) for i in range(1500)]
    asked = [(f"t{i}", f"who likes w{i} .") for i in range(0, 400, 25)] + [(f"f{i}", " ".join(rng.choice(words, 20))) for i in range(8)] + [("none", "nothing here"), ("one", "w399 w399 unknown"), ("w", "likes")]
    corpus, queries = spark.createDataFrame(docs, "ordinal long, text string"), spark.createDataFrame(asked, "qid string, text string")
    index = bm25.build(corpus)
    for k in (1, 10, 200):
        whole = bm25.top_k(bm25.scores(index, queries), queries, index.docs, k)
        found = bm25.search(index, queries, k)
        key = lambda df: sorted((r.qid, r.rank, r.ordinal, round(r.score, 9)) for r in df.collect())
        assert key(found) == key(whole) and found.count() == k * len(asked)


def test_equal_scores_add_no_rows_to_what_a_search_shuffles(spark, monkeypatch):
    """Half of the documents have the same words; the first k of a shard are all that leaves it, and blocks and shards change no row."""
    docs = [(i, "same words" if i % 2 else f"other w{i}") for i in range(600)]
    corpus, asked = spark.createDataFrame(docs, "ordinal long, text string"), spark.createDataFrame([("a", "same words"), ("b", "other w2 same"), ("c", "w4")], "qid string, text string")
    index = bm25.build(corpus)
    assert bm25._scored(index, asked, "regex", 5).where("qid = 'a'").count() == 5
    key = lambda: sorted(tuple(r) for r in bm25.search(index, asked, 5).collect())
    one = key()
    assert [r[1] for r in one if r[0] == "a"] == [1, 3, 5, 7, 9] and sum(r[0] == "c" for r in one) == 5
    monkeypatch.setattr(bm25, "POSTINGS", 100)
    monkeypatch.setattr(bm25, "BLOCK", 2)
    monkeypatch.setattr(bm25, "BROADCAST", 1)
    assert key() == one


def test_unscored_documents_fill_in_corpus_order(spark):
    docs = spark.createDataFrame([(i * 3,) for i in range(20)], "ordinal long")
    scored = spark.createDataFrame([("a", 0, 1.0), ("a", 9, 1.0), ("a", 57, -1.0)], "qid string, ordinal long, score double")
    asked = spark.createDataFrame([("a",), ("b",)], "qid string")
    got = {q: sorted(r.ordinal for r in bm25.unscored(scored, asked, docs, 4).where(F.col("qid") == q).collect()) for q in "ab"}
    assert got == {"a": [3, 6, 12, 15], "b": [0, 3, 6, 9]}
    ranked = bm25.top_k(scored, asked, docs, 5).where("qid = 'a'").orderBy("rank").collect()
    assert [r.ordinal for r in ranked] == [0, 9, 3, 6, 12]


def test_draws_are_single_choices_in_order():
    """Draw by draw, in a draw stratum by stratum in order of first appearance, each pick by Generator.choice."""
    rng = np.random.default_rng(11)
    delta, strata = rng.normal(size=23), np.array([["b", "a", "c"][i % 3] for i in range(23)])
    want, stream = [], np.random.default_rng(5)
    for _ in range(40):
        total = 0.0
        for name in ("b", "a", "c"):
            own = np.flatnonzero(strata == name)
            total += float(np.sum(delta[stream.choice(own, size=own.size, replace=True)]))
        want.append(total / 23)
    assert bootstrap.resampled_means(delta, strata, 40, 5).tolist() == want


def test_draws_do_not_depend_on_the_chunk(monkeypatch):
    delta, strata = np.arange(10.0), np.array(list("aabbbcccca"))
    whole = bootstrap.resampled_means(delta, strata, 30, 2)
    monkeypatch.setattr(bootstrap, "CHUNK", 35)
    assert (bootstrap.resampled_means(delta, strata, 30, 2) == whole).all()
    assert np.round(whole[:3], 6).tolist() == FIXED


def test_draws_over_tasks_are_those_of_one_generator(spark):
    """Strata of sizes that reject numbers of the generator, in any step, and comparisons of unlike shapes."""
    rng = np.random.default_rng(3)
    rows = [(t, m, str(q), f"s{q * q % k}", float(rng.normal())) for t, k in (("a", 3), ("b", 3), ("c", 5)) for m in ("x", "y") for q in range(40 + (t == "b"))]
    deltas = spark.createDataFrame(rows, "treatment string, metric string, qid string, template string, delta double").repartition(5)
    for draws, step in ((101, 7), (101, 1), (20, 500)):
        got = {(r.treatment, r.metric): r for r in bootstrap.bootstrap(deltas, draws, 11, step=step).collect()}
        assert len(got) == 6
        for (t, m), r in got.items():
            own = [x for x in rows if x[:2] == (t, m)]
            means = bootstrap.resampled_means(np.array([x[4] for x in own]), np.array([x[3] for x in own]), draws, 11)
            assert np.allclose([r.ci_low, r.ci_high], np.quantile(means, [0.025, 0.975]), rtol=0, atol=1e-15)
            assert r.probability_positive == (means > 0).mean() and abs(r.delta - np.mean([x[4] for x in own])) < 1e-12
    with pytest.raises(ValueError):
        bootstrap.bootstrap(deltas, 10, step=0)


#: Means of the first draws that single choices give with seed 2.
FIXED = [4.2, 6.0, 3.8]


def _one(spark, ranking):
    queries = spark.createDataFrame([("0", 0, templates.ATOM, ["x"])], "qid string, ordinal long, template string, attrs array<string>")
    qrels = spark.createDataFrame([("0", g) for g in (1, 2)], "qid string, ordinal long")
    return spark.createDataFrame([("m", "0", d, k + 1) for k, d in enumerate(ranking)], "method string, qid string, ordinal long, rank int"), queries, qrels


def test_repeated_documents_count_once(spark):
    row = metrics.evaluate(*_one(spark, [1, 1, 9, 2, 1])).first()
    assert (row.retrieved_size, row.candidate_size, row.candidate_recall) == (3, 3, 1.0)
    assert row.ndcg_at_5 == pytest.approx((1 + 1 / np.log2(4)) / (1 + 1 / np.log2(3)))


def test_candidates_of_all_methods(spark):
    results_, queries, qrels = _one(spark, [1, 9])
    pool = spark.createDataFrame([("0", d) for d in (1, 2, 9, 10)], "qid string, ordinal long")
    row = metrics.evaluate(results_, queries, qrels, pool).first()
    assert (row.candidate_size, row.candidate_recall, row.candidate_precision, row.recall_at_5) == (4, 1.0, 0.5, 0.5)
    with pytest.raises(ValueError, match="outside"):
        metrics.evaluate(results_, queries, qrels, pool.where("ordinal <> 9"))


def test_a_method_that_ranks_nothing_had_the_same_candidates(spark):
    results_, queries, qrels = _one(spark, [1, 9])
    queries = queries.unionByName(queries.withColumn("qid", F.lit("1")))
    qrels = qrels.unionByName(qrels.withColumn("qid", F.lit("1")))
    pool = spark.createDataFrame([(q, d) for q in "01" for d in (1, 2, 9, 10)], "qid string, ordinal long")
    rows = {r.qid: r for r in metrics.evaluate(results_, queries, qrels, pool).collect()}
    assert (rows["1"].candidate_size, rows["1"].candidate_recall, rows["1"].candidate_precision) == (4, 1.0, 0.5)
    assert (rows["1"].retrieved_size, rows["1"].recall_at_5) == (0, 0.0)


def test_raw_rows_and_ids(spark):
    rows = [
        ("0", "q", ["a"], 1, ("t", ["x"])), ("1", "", ["a", "a"], 2, ("t", ["x"])), ("1", "q", None, None, ("t", [""])), ("x", "q", ["a", None], 3, (None, None)),
    ]
    raw = spark.createDataFrame(rows, "id string, query string, docs array<string>, num_docs long, metadata struct<template:string,attrs:array<string>>")
    found = sorted((r.id, r.rule) for r in sources.raw_query_violations(raw).collect())
    assert found == [("1", "duplicate_gold"), ("1", "empty_attribute"), ("1", "invalid_docs"), ("1", "no_text"), ("x", "invalid_docs"), ("x", "no_plan"), ("x", "wrong_num_docs")]
    ids = sources.id_violations(raw.select(F.col("id").alias("qid")), 3)
    assert sorted((r.qid, r.rule) for r in ids.collect()) == [("1", "duplicate_qid"), ("2", "missing_qid"), ("x", "qid_out_of_range")]


def test_pool_export_and_digest(spark, tmp_path):
    pool = spark.createDataFrame([(str(q), r, f"d{q}-{r}é") for q in (10, 2) for r in (1, 2)], "qid string, rank int, doc_id string")
    told = sinks.export_pool(pool, str(tmp_path / "p" / "pool.jsonl.gz"))
    lines = '{"qid":"2","ranking":["d2-1é","d2-2é"]}\n{"qid":"10","ranking":["d10-1é","d10-2é"]}\n'.encode()
    assert gzip.decompress((tmp_path / "p" / "pool.jsonl.gz").read_bytes()) == lines
    assert told["uncompressed_sha256"] == hashlib.sha256(lines).hexdigest() == sinks.pool_digest(pool) and (told["queries"], told["candidate_ids"]) == (2, 4)
    again = sinks.export_pool(pool.orderBy("rank"), str(tmp_path / "again.gz"))
    assert again["compressed_sha256"] == told["compressed_sha256"]


def test_reranking_resumes_and_fails_closed(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "red apple."), (2, "green pear"), (3, "red")], "ordinal long, text string")
    queries = spark.createDataFrame([("0", "red apple"), ("1", "pear")], "qid string, text string")
    pool = spark.createDataFrame([(q, d, r) for q in "01" for r, d in enumerate((2, 1, 3), 1)], "qid string, ordinal long, rank int")
    path, calls = str(tmp_path / "scores"), []
    whole = sorted(map(tuple, rerank.rerank(pool, queries, corpus).collect()))
    first = rerank.resumed(pool.where("qid = '0'"), queries, corpus, path, "p1")
    assert [r.ordinal for r in first.orderBy("rank").collect()] == [1, 3, 2]

    one = rerank.Model(lambda weights, limit: lambda q, d: np.full(len(q), weights), 1.0)
    both = rerank.resumed(pool, queries, corpus, path, "p1", one)
    got = sorted(map(tuple, both.select("qid", "ordinal", "source_rank", "score", "rank").collect()))
    assert [r for r in got if r[0] == "0"] == [r for r in whole if r[0] == "0"] and {r[3] for r in got if r[0] == "1"} == {1.0}
    assert sorted(map(tuple, rerank.resumed(pool, queries, corpus, path, "p1").collect())) == sorted(map(tuple, both.collect()))
    with pytest.raises(ValueError, match="another pool or protocol"):
        rerank.resumed(pool, queries, corpus, path, "p2")
    with pytest.raises(ValueError, match="another pool or protocol"):
        rerank.resumed(pool.where("rank < 3"), queries, corpus, path, "p1")


def _refusing(*words):
    """A model that fails on queries with one of the words."""

    def load(weights, limit):
        def score(queries, documents):
            if any(w in q.split() for q in queries for w in words):
                raise RuntimeError("the scorer died")
            return np.array([len(q) * 1.0 + len(d) for q, d in zip(queries, documents, strict=True)])

        return score

    return rerank.Model(load, None, batch=4)


def test_a_cut_off_run_keeps_whole_groups(spark, tmp_path):
    corpus = spark.createDataFrame([(d, "word " * d) for d in range(6)], "ordinal long, text string")
    queries = spark.createDataFrame([(f"q{i}", f"query {i}") for i in range(10)], "qid string, text string")
    pool = spark.createDataFrame([(f"q{i}", (i + r) % 6, r + 1) for i in range(10) for r in range(5)], "qid string, ordinal long, rank int")
    path = str(tmp_path / "scores")
    with pytest.raises(Exception, match="the scorer died"):
        rerank.resumed(pool, queries, corpus, path, "p", _refusing("5"), group=2)
    done = spark.read.parquet(path)
    assert {(r.qid, r["count"]) for r in done.groupBy("qid").count().collect()} == {(f"q{i}", 5) for i in range(4)}
    # those that are kept are not scored again: this model would die of them
    whole = rerank.resumed(pool, queries, corpus, path, "p", _refusing("0", "1", "2", "3"), group=2)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, rerank.rerank(pool, queries, corpus, _refusing()).collect()))
    spent = spark.read.parquet(path).groupBy("qid").agg(F.count_distinct("seconds").alias("n"), F.min("seconds").alias("s")).collect()
    assert len(spent) == 10 and all(r.n == 1 and 0 < r.s < 60 for r in spent)


def test_seconds_are_elapsed(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "a b"), (2, "b")], "ordinal long, text string")
    queries = spark.createDataFrame([("0", "a"), ("1", "b")], "qid string, text string")
    pool = spark.createDataFrame([("0", 1, 1), ("0", 2, 2), ("1", 2, 1)], "qid string, ordinal long, rank int")
    ticks = iter([100.0, 106.0])
    rerank.resumed(pool, queries, corpus, str(tmp_path / "s"), "p", clock=lambda: next(ticks))
    assert {(r.qid, r.seconds) for r in spark.read.schema(rerank.CHECKPOINT).parquet(str(tmp_path / "s")).collect()} == {("0", 4.0), ("1", 2.0)}


def test_batches_are_of_about_one_size_and_limits_hold(spark):
    sizes = np.array([5, 1, 9, 1, 7, 3, 3])
    got = list(rerank.batches(sizes, 3))
    assert [sizes[g].tolist() for g in got] == [[1, 1, 3], [3, 5, 7], [9]] and sorted(np.concatenate(got)) == list(range(7))
    score = rerank.overlap_model().load(rerank.overlap_weights(), 4)
    # the query's two tokens leave room for two of the document
    assert score(["red pear", "red pear", "", "x y z w v"], ["red pear blue", "blue green red pear", "red", "x y"]).tolist() == [1.0, 0.0, 0.0, 0.0]


def test_throughput():
    assert rerank.throughput(100, 0, 7, 10) == {"pairs_per_second": None, "projected_hours": None}
    assert rerank.throughput(7200, 2, 720, 10) == {"pairs_per_second": 3600.0, "projected_hours": 7200 / 3600 / 3600}


def test_results_are_read_and_compared(spark, tmp_path):
    sinks.write_json(spark, {"b": 1, "a": {"é": [1, 2]}}, str(tmp_path / "o" / "x.json"))
    assert (tmp_path / "o" / "x.json").read_text() == '{\n  "a": {\n    "é": [\n      1,\n      2\n    ]\n  },\n  "b": 1\n}\n'
    assert results.read_json(spark, str(tmp_path / "o" / "x.json"))["b"] == 1
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError):
        results.read_json(spark, str(tmp_path / "list.json"))
    table = spark.createDataFrame([("m", *[0.5] * 5)], "method string, " + ", ".join(f"{m} double" for m in results.METRICS))
    sinks.write_csv(table, str(tmp_path / "t"))
    read = results.read_csv(spark, str(tmp_path / "t"))
    assert results.method_values(read).first().ndcg_at_20 == 0.5 and results.method_of(read.first().asDict())["ndcg_at_20"] == 0.5
    with pytest.raises(ValueError):
        results.method_values(table.withColumn("ndcg_at_20", F.lit("inf")))
    (tmp_path / "none.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        results.read_csv(spark, str(tmp_path / "none.csv"))
    assert results.deltas_of({"m": dict.fromkeys(results.DELTAS, 1)}, ("m",)) == {"m": dict.fromkeys(results.DELTAS, 1.0)}
    with pytest.raises(ValueError):
        results.deltas_of({"m": 3}, ("m",))
    differ = lambda a, b: results.differences(results.leaves(a), results.leaves(b))
    assert differ({"a": [1, 2.0]}, {"a": [1, 2.0 + 1e-13]}) == []
    assert [p for p, _ in differ({"a": True, "b": [1], "c": None}, {"a": 1, "b": [2], "d": 0})] == ["$.a", "$.b[0]", "$.c", "$.d"]
    assert differ({"a": [1, 2], "b": {}, "c": 0}, {"a": [1], "b": {"x": 1}, "c": False}) == [("$.a[1]", "left only"), ("$.b", "left only"), ("$.b.x", "right only"), ("$.c", "0 != False")]


def test_manifests_and_outputs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    _collection(tmp_path)
    outs = [str(tmp_path / n) for n in "ab"]
    for out in outs:
        assert cli.main(["run", "--data-dir", str(tmp_path), "--output-dir", out, "--depths", "2,3", "--bootstrap-samples", "20"]) == 0
    one, two = (results.manifest_leaves(results.read_json(spark, f"{out}/manifest.json")) for out in outs)
    assert results.differences(one, two) == [] and one["$.runtime.python"].count(".") == 1 and "$.runtime.total_seconds" not in one
    with pytest.raises(ValueError):
        results.manifest_leaves({"runtime": {}})
    tables, runs = ("per_query_metrics", "bootstrap_deltas", "atomic_summary", "error_decomposition", "gone"), ("runs/exact", "runs/bm25", "runs/atomic", "runs/composed")
    assert [tuple(r) for r in results.absent_outputs(spark, outs[0], tables, runs).collect()] == [("gone", "missing")]
    audit = results.read_json(spark, f"{outs[0]}/data_audit.json")
    assert audit["n_documents"] == 3 and audit["exact_mismatches"] == 0 and len(audit["checksums"]) == 2
    rows = results.read_csv(spark, f"{outs[0]}/per_query_metrics")
    assert {r.method: r.nominal_atomic_budget for r in rows.where("qid = '2'").collect()}["union_verify_L3"] == "6"
    errors = results.read_csv(spark, f"{outs[0]}/error_decomposition")
    assert errors.where("method like 'full%' and atomic_miss is not null").isEmpty() and errors.where("method = 'bm25'").isEmpty()
    assert {r.treatment for r in results.read_csv(spark, f"{outs[0]}/bootstrap_deltas").collect()} == {"full_verify", *(f"{m}_L{d}" for m in ("compose_exact_not", "union_verify", "hybrid_verify") for d in (2, 3))}


def test_checksums_gate(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    _collection(tmp_path)
    sums = {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("corpus.jsonl", "queries.jsonl")}
    (tmp_path / "SHA256SUMS").write_text("".join(f"{v}  {k}\n" for k, v in sums.items()))
    assert cli.main(["audit", "--data-dir", str(tmp_path)]) == 0
    (tmp_path / "SHA256SUMS").write_text(f"{'0' * 64}  corpus.jsonl\n{'0' * 64}  gone.jsonl\n")
    assert cli.main(["audit", "--data-dir", str(tmp_path)]) == 1
    assert cli.main(["audit", "--data-dir", str(tmp_path), "--no-checksums"]) == 0


@pytest.mark.parametrize("change", [lambda q: q | {"docs": [*q["docs"], "nobody"], "num_docs": len(q["docs"]) + 1}, lambda q: q | {"num_docs": 9}, lambda q: q | {"id": "7"}])
def test_audit_fails_on(spark, tmp_path, monkeypatch, change):
    monkeypatch.setattr(spark, "stop", lambda: None)
    _collection(tmp_path)
    lines = [json.loads(x) for x in (tmp_path / "queries.jsonl").read_text().splitlines()]
    (tmp_path / "queries.jsonl").write_text("".join(json.dumps(change(q) if k == 1 else q) + "\n" for k, q in enumerate(lines)))
    assert cli.main(["audit", "--data-dir", str(tmp_path)]) == 1


@pytest.fixture
def mounted(spark, tmp_path):
    """A path that only Spark opens."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(f"fs.viewfs.mounttable.{tmp_path.name.replace('_', '-')}.link./in", f"file://{tmp_path}")
    return f"viewfs://{tmp_path.name.replace('_', '-')}/in"


def test_files_by_a_path_that_only_spark_opens(spark, tmp_path, mounted, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    _collection(tmp_path)
    sums = {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("corpus.jsonl", "queries.jsonl")}
    (tmp_path / "SHA256SUMS").write_text("".join(f"{v}  {k}\n" for k, v in sums.items()))
    assert cli.main(["audit", "--data-dir", mounted]) == 0
    (tmp_path / "SHA256SUMS").write_text(f"{'0' * 64}  corpus.jsonl\n")
    assert cli.main(["audit", "--data-dir", mounted]) == 1
    for row in ({"b": "é"}, {"b": 2}):
        sinks.write_json(spark, row, f"{mounted}/o/x.json")
        assert results.read_json(spark, f"{mounted}/o/x.json") == row
    pool = spark.createDataFrame([("1", 1, "d")], "qid string, rank int, doc_id string")
    told = sinks.export_pool(pool, f"{mounted}/o/pool.gz")
    assert told["compressed_sha256"] == hashlib.sha256((tmp_path / "o" / "pool.gz").read_bytes()).hexdigest()
    with pytest.raises(RuntimeError), files.writer(spark, f"{mounted}/o/x.json") as out:
        out.write(b"half")
        raise RuntimeError
    assert results.read_json(spark, f"{mounted}/o/x.json") == {"b": 2} and {p.name for p in (tmp_path / "o").iterdir() if p.suffix != ".crc"} == {"x.json", "pool.gz"}


def test_checksums_of_files_beyond_a_row(spark, tmp_path):
    for name, end in (("small", 10), ("large", (1 << 31) + 5)):
        with open(tmp_path / name, "wb") as f:
            f.seek(end)
            f.write(b"x")
    want = {}
    for name in ("small", "large"):
        with open(tmp_path / name, "rb") as f:
            want[name] = hashlib.file_digest(f, "sha256").hexdigest()
    assert {r.file: r.sha256 for r in sources.checksums(spark, [str(tmp_path / n) for n in want]).collect()} == want
    (tmp_path / "large").unlink()
