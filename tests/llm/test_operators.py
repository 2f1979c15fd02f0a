"""Edge cases of every corpus operator, and brute force where SQL cannot check it."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import class_lm, components, language_id, mixing, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, topk, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string"
LONG = " ".join(f"w{i}" for i in range(3000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s1", 5, 0.1, "x"),
    (2, "ALPHA beta gamma delta epsilon zeta", "en", "s1", 5, 0.1, "x"),
    (3, None, None, None, None, None, None),
    (4, "", "en", "s2", 0, None, None),
    (5, " \n\t ", "en", None, 4, None, None),
    (6, "one two", "en", "s1", 7, None, None),
    (7, "ONE TWO", "de", "s1", 7, None, None),
    (8, LONG, "en", "s2", 9, None, None),
    (9, "start " + LONG + " end", "en", "s2", 9, None, None),
    (9, "start " + LONG + " end", "en", "s2", 9, None, None),
    (None, "alpha beta gamma delta epsilon zeta", "en", "s1", 5, None, None),
    (10, "$$$ 123 ###", "en", "s3", 11, None, None),
]
LABELS = [(1, 1, 0), (2, 0, 1), (6, None, None), (8, 1, 0), (8, 0, 1), (99, 1, 1), (None, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


@pytest.fixture(scope="module")
def real_labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_near_duplicates(docs):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(-1, 2, None, False), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (8, 2996, 8, True), (9, 2998, 8, False), (9, 2998, 8, False), (10, 1, 10, True)]


def test_a_large_family_of_near_copies(spark, monkeypatch):
    """Copies of one text with 1 to 40 of 146 words changed: brute force over all pairs, and through every kind of round."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        words = list(base)
        for k in rng.choice(150, rng.integers(1, 12), replace=False):
            words[k] = f"c{rng.integers(0, 400)}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(146)} for i, t in rows}
    want = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in range(20):
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
    for linear, probes in ((4, 128), (0, 10_000), (0, 1)):
        monkeypatch.setattr(near_dedup, "LINEAR", linear)
        monkeypatch.setattr(near_dedup, "PROBES", probes)
        if probes == 1:
            rows, want = rows[:25], None
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        if want is None:
            small = {i: i for i in range(25)}
            for _ in range(20):
                for i, j in links:
                    if j < 25:
                        small[i] = small[j] = min(small[i], small[j])
            assert got == small
        else:
            assert got == want


def test_components_by_stars(spark):
    edges = [(5, 1), (1, 5), (5, 9), (9, 9), (20, 30), (30, 40), (40, 50), (50, 60), (None, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    for few in (0, 100):
        got = {r.node: r.label for r in components.components(frame, few).collect()}
        assert got == {1: 1, 5: 1, 9: 1, 20: 20, 30: 20, 40: 20, 50: 20, 60: 20}
    assert components.components(frame.limit(0)).count() == 0


def test_substring_report(docs):
    rows = substring_dedup.substring_report(docs).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in rows)
    assert got == [(-1, 6, 0), (1, 6, 0), (2, 6, 0), (3, 0, 0), (4, 0, 0), (5, 0, 0), (6, 2, 0), (7, 2, 0), (8, 3000, 0), (9, 3002, 3000), (9, 3002, 3000), (10, 3, 0)]
    assert {r.kept_sha256 for r in rows if r.doc_id == 9} == {hashlib.sha256(b"start end").hexdigest()}


def test_substring_windows_by_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(40)]
    passages = [[str(x) for x in rng.choice(vocabulary, n)] for n in (49, 50, 51, 80, 120, 300)] + [["same"] * 130, ["x", "y"] * 60]
    rows = []
    for i in range(60):
        words: list[str] = []
        for _ in range(rng.integers(0, 5)):
            p = passages[rng.integers(0, len(passages))]
            a, b = sorted(rng.integers(0, len(p) + 1, 2))
            words += [str(x) for x in rng.choice(vocabulary, rng.integers(0, 30))] + p[a:b] + ([] if rng.integers(0, 2) else p)
        rows.append((i, " ".join(words)))
    first: dict[tuple, int] = {}
    want = {}
    for i, text in rows:
        words = text.split()
        gone = set()
        for k in range(len(words) - 49):
            if first.get(tuple(words[k : k + 50]), i) < i:
                gone.update(range(k, k + 50))
        for k in range(len(words) - 49):
            first.setdefault(tuple(words[k : k + 50]), i)
        want[i] = (len(words), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_packing(docs):
    rows = packing.pack(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length >= 1
            at += length
        assert at <= 2048
    assert sorted(r.doc_id for r in rows if r.doc_id in (3, 4)) == [3, 4]
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 8)
    assert [p[0] for p in long] == list(range(len(long))) and all(p[2] == 2048 for p in long[1:]) and long[0][1] == 0


def test_packing_ids_are_the_tokenizer_s(real):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in real.collect()} | {-1: "a<|endoftext|>b", -2: "  x \n\n y's  "}
    frame = real.sparkSession.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack(frame).collect()
    ids = {k: np.array([*exact.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in texts.items()}
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length])
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    size = {r.doc_id: r.size for r in rows}
    assert size[3] == size[4] == size[5] == 0 and size[8] == 3000
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by = defaultdict(lambda: [0, 0.0])
    for r, source in zip(sorted(rows, key=lambda r: (r.doc_id or 0, r.size)), [s[3] for s in sorted(ROWS, key=lambda s: (s[0] or 0, len(WORD.findall(s[1] or ""))))], strict=True):
        by[source][0] += r.taken
        by[source][1] = r.target
    total = sum(r.size for r in rows)
    assert math.isclose(sum(t for _, t in by.values()), 1.5 * total)
    for taken, target in by.values():
        assert abs(taken - target) <= 2
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = sum(len(WORD.findall(r.text or "")) for r in out.collect())
    assert words == sum(r.taken for r in rows)


@pytest.mark.parametrize(("size", "dim"), [(1.0, 6), (3e5, 16), (1e6, 64), (1e150, 3)])
def test_top_k(spark, size, dim):
    """Brute force in Python's integers, with equal rows under other ids, repeated rows and vectors that take no part."""
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(700, dim)) * size).round(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(17, rows[17][1])] * 3 + [(100, rows[100][1]), (2100, [1.0, 2.0]), (2101, [3.5, -1.0])]
    odd = [(5000, None), (5100, []), (5200, [1.0, None] + [0.0] * (dim - 2)), (5300, [float("nan")] * dim), (5400, [float("inf")] * dim), (None, rows[0][1])]
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), shard=128, block=3).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    fine = [(i, [int(math.floor(Fraction(x) * 1024)) for x in v]) for i, v in rows]
    asked = {i: v for i, v in fine if i % 100 == 0}
    assert set(got) == set(asked) - {5000}
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    for q, found in got.items():
        want = sorted((-clip(sum(a * b for a, b in zip(asked[q], v, strict=True))), i) for i, v in fine if i != q and len(v) == len(asked[q]))[:10]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_top_k_of_one_shard(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(0, 300)]
    got = sorted((r.rank, r.vec_id) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() if r.query_id == 100)
    assert [i for _, i in got] == sorted((i for i, v in rows if i != 100), key=lambda i: (-(1024 * 1024 * (i % 7 * (100 % 7) + 1)), i))[:10]


def _fold(i, parts):
    return zlib.crc32((str(i) if i is not None else "").encode()) % parts


@pytest.mark.parametrize(("module", "label", "parts", "held"), [(toxicity, "toxic", 4, 2), (quality_classifier, "quality", 5, 0)])
def test_classifiers(docs, labels, real, real_labels, module, label, parts, held):
    rows = module.classify(docs, labels).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (_fold(r.doc_id, parts) == held)
    assert module.classify(docs.limit(0), labels.limit(0)).count() == 0
    got = {r.doc_id: r for r in module.classify(real, real_labels).collect()}
    y = {r.doc_id: r[label] for r in real_labels.collect()}
    pairs = [(got[a].score > got[b].score) + 0.5 * (got[a].score == got[b].score) for a in y if y[a] == 1 for b in y if y[b] == 0]
    assert sum(pairs) / len(pairs) > 0.8


def test_language_id(docs, real):
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} >= {3, 4, 5, 10}
    assert language_id.identify(docs.limit(0)).count() == 0
    lang = {r.doc_id: r.lang for r in real.collect()}
    rows = [r for r in language_id.identify(real).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) > 0.9


def test_quality_rules(docs, labels, real, real_labels):
    rows = quality_rules.judge(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(not r.kept for r in rows if r.base_failed) and all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    for r in quality_rules.judge(real, real_labels).join(real.select("doc_id", "text"), "doc_id").collect():
        words = WORD.findall(r.text)
        lines = [x for x in r.text.split("\n") if WORD.search(x)]
        grams = Counter(zip(words, words[1:], words[2:]))
        twice = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in r.text), len(lines) - len(set(lines)), len(twice))


def test_decision_lists_learn_thresholds():
    rng = np.random.default_rng(0)
    x = {"n_words": rng.integers(50, 500, 600).astype(float), "symbols_per_word": rng.random(600)}
    bad = (x["symbols_per_word"] > 0.7) & (x["n_words"] <= 300)
    rules = quality_rules.learn(x, bad)
    told = np.zeros(600, bool)
    for rule in rules:
        told |= quality_rules._covers(rule, x, 600)
    assert (told == bad).mean() > 0.97


def test_class_lm(docs, real):
    assert class_lm.score(docs.limit(0)).count() == 0
    for frame in (docs, real.select("doc_id", "text")):
        rows = frame.select("doc_id", "text").collect()
        fold_case = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
        tokens = [[*WORD.findall((r.text or "").translate(fold_case)), None] for r in rows]
        count = Counter(t for r, ts in zip(rows, tokens, strict=True) if _fold(r.doc_id, 5) != 1 for t in ts)
        total, kinds = sum(count.values()), len(count)
        want = Counter((r.doc_id, len(ts), sum(count[t] > 0 for t in ts), round(sum(math.log10((count[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in ts), 5)) for r, ts in zip(rows, tokens, strict=True))
        scored = class_lm.score(frame).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in scored) == want
        assert {r.train_tokens for r in scored} == {total} and all(r.score < 0 for r in scored)
    held = [r for r in scored if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_exchange_finds_alternating_classes():
    """Units 0-3 and 4-7 follow each other: two classes explain the bigrams."""
    pairs, n = [], []
    for a in range(8):
        for b in range(8):
            if (a < 4) != (b < 4):
                pairs.append(a * 9 + b), n.append(10.0 + a + b)
    own = class_lm.exchange(np.array(pairs), np.array(n), 9, classes=3, rounds=8)
    assert len(set(own[:4])) == 1 and len(set(own[4:8])) == 1 and own[0] != own[4] and own[8] == 2


def test_empty_tables(spark, docs, labels):
    none = docs.limit(0)
    assert near_dedup.near_duplicates(none).count() == 0
    assert substring_dedup.substring_report(none).count() == 0
    assert packing.pack(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert quality_rules.judge(none, labels.limit(0)).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_native_mixing_has_no_python(real):
    plan = mixing.mix(real)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.limit(1).select(F.lit(10**6).alias("doc_id"), F.lit("§ 12 --").alias("text"), "lang", "source", "n_chars"))
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
    assert counts[0] == 200 and counts[1] < 200 and counts[2] == counts[1] and counts[4] >= counts[3]
