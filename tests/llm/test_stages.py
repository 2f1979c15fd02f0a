"""The pipeline's stages on odd tables: nulls, repeats, clashing names, empty tables, texts of several MB."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import language_id, substring_dedup

STAGES = dict(corpus_pipeline.STAGES)
KEPT = [name for name, _ in corpus_pipeline.STAGES[:-1]]
WORDS = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
PASSAGE = " ".join(WORDS[:70])
CLASH = "doc_id long, text string, lang string, source string, n_chars long, tid string, spans int, n_words long, n_removed string, kept_sha256 string, _text string, _lang_pred string, _score double, row int, size string, key int, target string, `key word` string"
MORE = ("t", 7, 77, "nr", "sha", "x", "y", 0.5, 3, "big", 9, "aim", "kw")


def _rows():
    texts = [PASSAGE + " " + " ".join(WORDS[100:130]), " ".join(WORDS[200:230]) + " " + PASSAGE, None, "", "§ 12 --", " ".join(WORDS[230:300])]
    rows = [(i, t, "en" if i % 2 else None, "s", 5, *MORE) for i, t in enumerate(texts)]
    return [*rows, rows[1], rows[1], (None, PASSAGE, "en", None, None, *MORE)]


@pytest.mark.parametrize("name", KEPT)
def test_stage_keeps_columns_of_any_name(spark, name):
    docs = spark.createDataFrame(_rows(), CLASH)
    out = STAGES[name](spark, docs, "")
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    got = out.collect()
    assert got and all(tuple(r)[5:] == MORE for r in got)
    if name == "language ID":
        assert sorted(r.doc_id for r in got if r.doc_id is not None) == [0, 1, 1, 1, 5]
    if name == "MinHash near-dedup":
        assert sum(r.doc_id is None for r in got) == 1 and len(got) == len(_rows())
    if name == "substring dedup":
        assert sorted((r.doc_id or 0, len((r.text or "").split()), r.n_chars) for r in got) == sorted([(0, 100, 5), (0, 70, None), (1, 30, len(" ".join(WORDS[200:230])))] + [(1, 30, len(" ".join(WORDS[200:230])))] * 2 + [(2, 0, 5), (3, 0, 5), (4, 3, 5), (5, 70, 5)])


def test_last_stage_packs_every_row(spark):
    rows = STAGES["best-fit packing"](spark, spark.createDataFrame(_rows(), CLASH), "").collect()
    assert len(rows) == len(_rows()) and {r.ids_crc32 for r in rows if r.doc_id in (2, 3)} == {zlib.crc32(bytes(4))}


@pytest.mark.parametrize("name", [*KEPT, "best-fit packing"])
def test_stage_of_an_empty_table(spark, name):
    assert STAGES[name](spark, spark.createDataFrame([], CLASH), "").count() == 0


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_foreign_texts_go_and_short_ones_stay(spark):
    rows = [(i, " ".join(WORDS[i : i + 40]), "en") for i in range(60)] + [(100, "日本語のテキストは学習した言語のどれでもない" * 5, None), (101, "Ok.", None)]
    kept = {r.doc_id for r in STAGES["language ID"](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    assert 100 not in kept and 101 in kept and set(range(60)) <= kept


def test_nothing_learned_keeps_texts_with_letters(spark):
    rows = [(1, "some text", None), (2, "123", None), (3, "é", None)]
    assert sorted(r.doc_id for r in STAGES["language ID"](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()) == [1, 3]


def test_windows_do_not_grow_with_repeated_rows(spark, monkeypatch):
    cut, other, counts = substring_dedup.cut, " ".join(WORDS[:45] + WORDS[150:190] + WORDS[:60]), []
    for repeats in (1, 20, 200):
        seen = []
        monkeypatch.setattr(substring_dedup, "cut", lambda df, *a, seen=seen: seen.append((df.columns, cut(df, *a))) or seen[-1][1])
        docs = spark.createDataFrame([(1, PASSAGE + " " + other)] + [(2, other + " " + PASSAGE)] * repeats, "doc_id long, text string")
        found = substring_dedup.substring_report(docs).collect()
        assert len(found) == 1 + repeats and {r.n_removed for r in found} == {0, 215}
        counts.append([df.count() for columns, df in seen if columns[0] == "window" and "tid" in columns])
    assert counts[0] == counts[1] == counts[2] and 0 < counts[0][0] <= 2 * (215 - 49)


def test_factors_are_the_parse(spark):
    """A long passage is one factor with its source's place; the next source starts another."""
    a, b = " ".join(WORDS[:120]), " ".join(WORDS[150:260])
    docs = spark.createDataFrame([(1, "x1 x2 " + a), (2, b), (3, f"y1 {a} {b}")], "doc_id long, text string")
    rows = [r for r in substring_dedup.parse(docs).collect() if r.doc_id == 3]
    cover = {1: set(), 2: set()}
    for r in rows:
        cover[r.source] |= set(range(r.start, r.start + r.n))
        assert r.start - r.source_start == (-1 if r.source == 1 else 121) and r.n >= 50
    assert cover[1] == set(range(1, 121)) and cover[2] == set(range(121, 231))
    assert max(r.n for r in rows) > 60


def test_texts_of_several_megabytes(spark):
    rng = np.random.default_rng(0)
    long = " ".join(WORDS[i] for i in rng.integers(0, 300, 700_000))
    docs = spark.createDataFrame([(1, long, "en"), (2, "one " + long, "en"), (3, "x" * 3_000_000, "en")], "doc_id long, text string, lang string")
    docs = docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()} == {1: "en", 2: "en", 3: "en"}
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_report(docs).collect()) == [(1, 700_000, 0), (2, 700_001, 700_000), (3, 1, 0)]
    for name in KEPT:
        docs = STAGES[name](spark, docs, "")
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {1, 3}


def test_steps_do_not_change_a_decision(monkeypatch):
    import pyarrow as pa

    rows = [("en", " ".join(WORDS[:150])), ("de", " ".join(WORDS[150:]))]
    model = language_id.train(rows)
    texts = pa.array([" ".join(WORDS[100:200]), None, "", " ".join(WORDS[140:290]) * 3, "a"])
    whole = language_id.decide(model, texts)
    monkeypatch.setattr(language_id, "STEP", 61)
    steps = language_id.decide(model, texts)
    assert whole[0] == steps[0] and np.allclose(whole[1], steps[1]) and (whole[2] == steps[2]).all()
