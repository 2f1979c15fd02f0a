"""Decontamination against brute force over word lists."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sieveline.llm import decontamination

DOCS = "doc_id long, text string, item_id string, w string, pos int, n_hit double"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(len(v), window)
            for i in range(len(v) - n + 1 if n and item_id is not None else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[i : i + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def check(spark, docs, items, window=10, shingle=3):
    d = spark.createDataFrame([(i, t, "x", "y", 1, 0.5) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontamination.contamination(d, b, window, shingle).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, items, window)
    return got


LONG = " ".join(f"w{i}" for i in range(2000))
ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away"), (2, "short Item"), (3, "ONE"), (4, ""), (5, None), (6, " .,;- "), (None, "alpha beta gamma"),
    (7, "a b a b a b a b a b a b"), (8, "the quick brown fox jumps over the lazy dog and RUNS far away"), (1, "second text of one"), (9, "Über ñandú ΑΣ σας İstanbul été naïve façade Straße ß 日本語 x1 y2"), (10, "w50 " * 3),
]


def test_odd_rows(spark):
    docs = [
        (1, "so the quick, brown FOX jumps over the lazy dog and runs far away!"), (2, "the quick brown fox jumps over the lazy"), (3, None), (4, ""), (5, "  \n\t "), (6, "a short\nitem; another short item"), (7, "one One ONE"),
        (8, "a b a b a b a b a b a b a b a b"), (None, "one"), (None, "one"), (9, "short item"), (9, "short item"), (10, LONG + " w50 w50\x00w50 " + LONG), (11, "xx Über ñandú ΑΣ σας İstanbul été naïve façade Straße ß 日本語 x1 y2"),
        (12, "über ñandú ας σας istanbul été naïve façade straße ß 日本語 x1 y2"), (13, "runs far away the quick brown fox jumps over the lazy dog and"), (14, "alpha beta gamma"), (15, "second text of one quick brown fox"),
    ]
    check(spark, docs, ITEMS)


@pytest.mark.parametrize("rows", [None, 0])
@pytest.mark.parametrize(("window", "shingle"), [(10, 3), (4, 2), (3, 1), (2, 3)])
def test_random_texts_by_broadcast_and_by_shuffle(spark, monkeypatch, rows, window, shingle):
    if rows is not None:
        monkeypatch.setattr(decontamination, "ROWS", rows)
    rng = random.Random(window * 10 + shingle)
    line = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(i, line(rng.randint(0, 14), 3 + i % 5)) for i in range(25)]
    docs = [(i, line(rng.randint(0, 60), 2 + i % 6) + " " + rng.choice(items)[1]) for i in range(50)]
    got = check(spark, docs, items, window, shingle)
    assert any(r.contaminated for r in got)


def test_empty_tables(spark):
    assert check(spark, [], ITEMS) == []
    assert not check(spark, [(1, "a b c")], [])[0].contaminated
    assert not check(spark, [(1, "a b c"), (2, None)], [(1, None), (2, "..")])[0].contaminated


def test_long_text_of_one_word_and_of_many(spark):
    docs = [(1, "a" * 2_000_000), (2, "the lazy dog " * 50_000), (3, "x\n" * 300_000), (4, "\n" * 2_000_000)]
    items = [(1, "the lazy dog"), (2, "a" * 2_000_000), (3, "x x x x x x x x x x")]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: (1, 1, 1), 2: (150_000, 150_000, 1), 3: (300_000, 300_000, 1), 4: (0, 0, 0)}


def test_whole_table_and_native_plan(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    out = decontamination.contamination(docs, items)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 10)
    found = decontamination.places(docs.select("doc_id", F.xxhash64("text").alias("tid"), "text"), [3])
    for df in (out, found):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
