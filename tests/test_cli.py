import json

import pytest

from sieveline import __main__ as cli
from sieveline.sources import sinks
from sieveline.streaming import intake


def _collection(path):
    docs = [("a", "Ada likes Apples, Pears."), ("b", "Bea likes Apples, Plums."), ("c", "Cal likes Pears, Plums.")]
    (path / "corpus.jsonl").write_text("".join(json.dumps({"_id": i, "text": t}) + "\n" for i, t in docs))
    asked = [
        ("0", "Who likes Apples?", ["a", "b"], "_", ["Apples"]), ("1", "Who likes Apples but not Pears?", ["b"], "_ that are not _", ["Apples", "Pears"]),
        ("2", "Who likes Apples and also likes Plums?", ["b"], "_ that are also _", ["Apples", "Plums"]),
    ]
    (path / "queries.jsonl").write_text("".join(json.dumps({"id": i, "query": q, "docs": d, "num_docs": len(d), "metadata": {"template": t, "attrs": a}}) + "\n" for i, q, d, t, a in asked))


def test_audit_and_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    _collection(tmp_path)
    assert cli.main(["audit", "--data-dir", str(tmp_path)]) == 0
    out = tmp_path / "out"
    assert cli.main(["run", "--data-dir", str(tmp_path), "--output-dir", str(out), "--depths", "2,3", "--bootstrap-samples", "50"]) == 0
    rows = spark.read.option("header", True).option("inferSchema", True).csv(str(out / "per_query_metrics"))
    assert rows.where("method = 'exact'").agg({"recall_at_100": "min"}).first()[0] == 1.0
    assert rows.select("method").distinct().count() == 3 + 4 * 2
    assert cli.main(["check", "--output-dir", str(out)]) == 0
    # a mean that the rows do not have, and an interval that their bootstrap does not give
    for name, column in (("summary_metrics", "ndcg_at_20"), ("bootstrap_deltas", "ci_high")):
        was = spark.read.option("header", True).csv(str(out / name))
        moved = was.withColumn(column, (was[column].cast("double") + 1e-6).cast("string"))
        sinks.write_csv(moved, str(tmp_path / "moved"))
        kept = (out / name).rename(out / f"{name}-kept")
        (tmp_path / "moved").rename(out / name)
        assert cli.main(["check", "--output-dir", str(out)]) == 1
        assert {r.metric.partition(".")[2] or r.metric for r in cli.check(spark, str(out)).collect()} == {column}
        (out / name).rename(tmp_path / f"{name}-moved")
        kept.rename(out / name)
    for bad in (["run", "--data-dir", "x"], ["run", "--data-dir", "x", "--output-dir", "y", "--depths", "0"], ["run", "--data-dir", "x", "--output-dir", "y", "--tie-break", "quick"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_audit_reports_wrong_gold(spark, tmp_path):
    _collection(tmp_path)
    text = (tmp_path / "queries.jsonl").read_text()
    (tmp_path / "queries.jsonl").write_text(text.replace('["a", "b"]', '["a", "c"]'))
    assert cli.main(["audit", "--data-dir", str(tmp_path)]) == 1


def test_intake_takes_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, text in enumerate(["Ada likes Apples, Pears.", "Bea likes Plums, Figs."]):
        (source / f"{k}.jsonl").write_text(json.dumps({"_id": str(k), "text": text}) + "\n")
        intake.start(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * (k + 1)
