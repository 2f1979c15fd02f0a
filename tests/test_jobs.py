"""The jobs: reruns, growing input, cut-off batches, odd rows and the command lines."""

import json
import os
import random
import re
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import grow_index, passage_report
from sieveline.operators import bm25, passages
from sieveline.sources.tables import shared_dir

ROOT = Path(__file__).resolve().parents[1]
DOCS = "doc_id long, text string, lang string, rank int, term string"
TOKEN = re.compile(r"\w+(?:[-'’]\w+)*|[^\w\s]")


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 40))), "en" if i % 3 else None, 1, "x") for i in range(n)]


def put(spark, rows, folder, mode="append"):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode(mode).parquet(str(folder))


def state(spark, out, *names):
    return {n: sorted((tuple(r) for r in grow_index.table(spark, out, n).drop("batch").collect()), key=repr) for n in names or ("documents", "postings", "vocabulary")}


def test_growing_input_is_taken_once(spark, tmp_path):
    rows, source, out, mark = texts(90), tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    config = grow_index.Config(files_per_batch=1, buckets=3)
    settings = set(spark.conf.getAll.items())
    put(spark, rows[:30], source)
    put(spark, rows[30:50], source)
    first = grow_index.run(spark, str(source), out, mark, config)
    assert (first["documents"], first["new_documents"], first["batches"]) == (50, 50, 2)
    seen = {r.doc_id: r.batch for r in grow_index.table(spark, out, "documents").collect()}
    again = grow_index.run(spark, str(source), out, mark, config)
    assert again == first | {"new_documents": 0}
    # new files, one of them with documents that are there already
    put(spark, rows[50:], source)
    put(spark, [(i, "other words", "de", 1, "x") for i in range(5)], source)
    last = grow_index.run(spark, str(source), out, mark, config)
    assert (last["documents"], last["new_documents"]) == (90, 40)
    after = {r.doc_id: r.batch for r in grow_index.table(spark, out, "documents").collect()}
    assert {k: after[k] for k in seen} == seen and min(after[i] for i in range(50, 90)) > max(seen.values())
    # as one run over everything
    put(spark, rows, tmp_path / "whole")
    grow_index.run(spark, str(tmp_path / "whole"), str(tmp_path / "one"), str(tmp_path / "onemark"), config)
    assert state(spark, out) == state(spark, str(tmp_path / "one"))
    assert settings ^ set(spark.conf.getAll.items()) == set()


def test_a_batch_that_was_cut_off_is_repeated(spark, tmp_path, monkeypatch):
    rows, source = texts(40, 2), tmp_path / "in"
    put(spark, rows[:20], source)
    put(spark, rows[20:], source)
    out, mark, config = str(tmp_path / "out"), str(tmp_path / "mark"), grow_index.Config(files_per_batch=1)
    real, calls = grow_index._replaced, []

    def broken(df, where, name):
        calls.append(name)
        if calls.count("counts") == 2 and name == "counts":
            raise RuntimeError("cut off")
        real(df, where, name)

    monkeypatch.setattr(grow_index, "_replaced", broken)
    with pytest.raises(Exception, match="cut off"):
        grow_index.run(spark, str(source), out, mark, config)
    monkeypatch.setattr(grow_index, "_replaced", real)
    assert grow_index.run(spark, str(source), out, mark, config)["documents"] == 40
    put(spark, rows, tmp_path / "whole")
    grow_index.run(spark, str(tmp_path / "whole"), str(tmp_path / "one"), str(tmp_path / "onemark"), config)
    assert state(spark, out) == state(spark, str(tmp_path / "one"))


def test_odd_rows_and_the_index(spark, tmp_path):
    rows = [*texts(60, 3), (None, "no id", "en", 1, "x"), (100, None, None, 1, "x"), (101, "", "en", 1, "x"), (102, "b twice", "en", 1, "x"), (102, "a twice", "en", 1, "x"), (103, "long " * 200_000, "en", 1, "x")]
    put(spark, rows, tmp_path / "in")
    grow_index.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"))
    lengths = {r.doc_id: r.dl for r in grow_index.table(spark, str(tmp_path / "out"), "documents").collect()}
    assert lengths[100] == lengths[101] == 0 and lengths[102] == 2 and lengths[103] == 200_000 and None not in lengths
    assert grow_index.table(spark, str(tmp_path / "out"), "postings").where("doc_id = 102").select("term").distinct().count() == 2
    asked = spark.createDataFrame([("q", "alpha1 beta2 gamma3 twice long"), ("none", "nothing")], "qid string, text string")
    corpus = spark.createDataFrame([(i, t or "") for i, t, *_ in rows if i is not None and t != "b twice"], "ordinal long, text string")
    key = lambda df: sorted((r.qid, r.rank, r.ordinal, round(r.score, 9)) for r in df.collect())
    assert key(bm25.search(grow_index.index(spark, str(tmp_path / "out")), asked, 12)) == key(bm25.search(bm25.build(corpus), asked, 12))


def test_no_files_yet(spark, tmp_path):
    put(spark, [], tmp_path / "in")
    assert grow_index.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"))["documents"] == 0
    assert grow_index.table(spark, str(tmp_path / "out"), "vocabulary").count() == 0


def test_passages_are_found_by_all_their_tokens(spark):
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice(["a", "b", "c.", "d-e", "f's", "(g)"]) for _ in range(n))
    docs, asked = [(i, line(rng.randint(0, 30))) for i in range(200)], [(str(i), line(rng.randint(0, 5))) for i in range(40)] + [("z", "a zz"), ("y", "")]
    corpus = spark.createDataFrame(docs, "ordinal long, text string")
    got = {tuple(r) for r in passages.containing(bm25.build(corpus), corpus, spark.createDataFrame(asked, "qid string, text string")).collect()}

    def inside(p, t):
        p, t = TOKEN.findall(p), TOKEN.findall(t)
        return bool(p) and any(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1))

    assert got == {(q, d) for q, p in asked for d, t in docs if inside(p, t)} and got


def test_report_is_whole_and_the_same_again(spark, tmp_path):
    docs = [*texts(80, 7), (None, "no id", "en", 1, "x"), (200, None, "en", 1, "x"), (201, "", "en", 1, "x")]
    part = lambda i: " ".join(docs[i][1].split()[:6])
    items = [(i, part(i)) for i in range(0, 40, 4)] + [(90, "not in any document"), (91, None), (None, part(3)), (92, "")]
    put(spark, docs, tmp_path / "docs")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "items"))
    run = lambda: passage_report.run(spark, str(tmp_path / "docs"), str(tmp_path / "items"), str(tmp_path / "out"), passage_report.Config(pool_k=10, final_k=3, buckets=2))
    first = run()
    read = lambda name: sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / name)).collect()), key=repr)
    tables = {n: read(n) for n in ("run", "gold", "report")}
    assert run() == first and {n: read(n) for n in tables} == tables
    gold = {}
    for q, p in items:
        own = {i for i, t, *_ in docs if q is not None and i is not None and t and p and TOKEN.findall(p) and f" {' '.join(TOKEN.findall(p))} " in f" {' '.join(TOKEN.findall(t))} "}
        if own:
            gold[str(q)] = own
    by = {(r.method, r.qid): r for r in passage_report.report(spark, str(tmp_path / "out")).collect()}
    assert {q for _, q in by} == set(gold) and {m for m, _ in by} == {"bm25", "full_verify"}
    ranked = {}
    for r in spark.read.parquet(str(tmp_path / "out" / "run")).orderBy("rank").collect():
        ranked.setdefault(r.qid, []).append(r.doc_id)
    for q, own in gold.items():
        row = by["bm25", q]
        assert row.gold_size == len(own) and row.candidate_miss == len(own - set(ranked[q])) and row.recall_at_5 == len(own & set(ranked[q][:3])) / len(own)
        assert by["full_verify", q].total_misses == len(own) - min(3, len(own & set(ranked[q])))
    with pytest.raises(ValueError):
        passage_report.Config(pool_k=1, final_k=2)


def test_jobs_do_not_need_the_corpus_operators():
    for name in ("grow_index.py", "passage_report.py", "registry.py"):
        assert not re.search(r"llm|corpus_pipeline", (ROOT / "jobs" / name).read_text())


@pytest.mark.parametrize("job", ["grow_index", "passage_report"])
def test_command_lines(spark, tmp_path, job):
    put(spark, texts(30, 9), tmp_path / "docs")
    spark.createDataFrame([(1, texts(30, 9)[4][1])], "item_id long, text string").write.parquet(str(tmp_path / "items"))
    more = ["--checkpoint", str(tmp_path / "mark")] if job == "grow_index" else ["--passages", str(tmp_path / "items")]
    call = [sys.executable, str(ROOT / "jobs" / f"{job}.py"), "--config", str(ROOT / "jobs" / f"{job}.json"), "--documents", str(tmp_path / "docs"), "--out", str(tmp_path / "out"), *more]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --driver-memory 1g --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run(call, capture_output=True, text=True, timeout=300, env=env, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads(done.stdout.strip().splitlines()[-1])["documents"] == 30
    assert re.search(r"(wrote|read) \d+", done.stderr)


def test_a_report_leaves_no_tables_on_its_way(spark, tmp_path):
    spark.createDataFrame([(1, "one two three"), (1, "a one two"), (2, "two three four"), (2, "two three four"), (None, "one two")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(5, "one two"), (6, "three four"), (6, "two three")], "item_id long, text string").write.parquet(str(tmp_path / "p"))
    left = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("table-*"))
    before = left()
    counts = passage_report.run(spark, str(tmp_path / "d"), str(tmp_path / "p"), str(tmp_path / "out"), passage_report.Config(pool_k=2, final_k=1))
    assert left() == before
    assert (counts["documents"], counts["passages"]) == (2, 2)
    gold = spark.read.parquet(str(tmp_path / "out" / "gold")).select("qid", "doc_id").collect()
    assert sorted(tuple(r) for r in gold) == [("5", 1), ("6", 2)]
