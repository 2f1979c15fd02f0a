"""Scores of learned models, held against plain Python that is given the same model."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.llm import class_lm, language_id, quality_classifier, quality_rules, toxicity
from sieveline.llm import kernels as K

SF = "/root/testdata/sf0.01"
MASK = (1 << 64) - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x20\x09-\x0D0-9A-Za-z\x80-\xff]+")
RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
ODD = ["", " \n ", "a", "$$$", "One, TWO 3rd 44!! Ünïcode", "the cat the cat", "x" * 40, "Ab9 " * 30, None]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").persist()


@pytest.fixture(scope="module")
def texts(real):
    return [r.text for r in real.orderBy("doc_id").limit(40).collect()] + ODD


@pytest.fixture(scope="module")
def label_rows(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").collect()


def _mix(x):
    return int(K.mix(np.array([x & MASK], K.U64))[0])


def _hash(token, fold_case=False):
    return int(K.span_hashes(np.frombuffer(token, np.uint8), np.array([0]), np.array([len(token)]), fold_case)[0])


def _gram(a, b):
    return _mix(a * int(K.GRAM) + b)


def _logistic(x):
    return 1 / (1 + math.exp(-min(max(x, -30), 30)))


def _shape(token):
    capital, digits = (sum(lo <= c <= hi for c in token) for lo, hi in ((65, 90), (48, 57)))
    case = 0 if not capital else 1 if capital == len(token) else 2 if capital == 1 else 3
    number = 0 if not digits else 1 if digits == len(token) else 2
    return _mix(((min(len(token), 24) // 3 * 4 + case) * 3 + number) * int(K.GRAM) + (1 if RUN.fullmatch(token) else 2) + 7)


def _slots(text):
    tokens = TOKEN.findall((text or "").encode())
    h, shape = [_hash(t) for t in tokens], [_shape(t) for t in tokens]
    coarse = [a if not RUN.fullmatch(t) else b for t, a, b in zip(tokens, h, shape, strict=True)]
    pairs = [_gram(a, b) for a, b in zip(h, h[1:])] + [_mix(_gram(a, b)) for a, b in zip(coarse, coarse[1:])]
    return [x % quality_classifier.SLOTS for x in h + shape + pairs]


def test_quality_scores(spark, texts):
    y = np.arange(len(texts)) % 2.0
    model = quality_classifier.train([t or "" for t in texts], y)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_classifier.score(rows, model).collect():
        slots = _slots(texts[r.doc_id])
        margin = model["bias"] + sum(float(model["weights"][s]) for s in slots) / math.sqrt(max(len(slots), 1))
        assert r.score == pytest.approx(_logistic(model["a"] * margin + model["b"]), abs=1e-9)


@pytest.mark.parametrize("step", [1, 7, 64])
def test_steps_keep_every_feature(monkeypatch, texts, step):
    long = ["a" * 300, " " * 300 + "b" + " " * 300 + "c", "a.b!" * 80, *[t or "" for t in texts if len(t or "") < 3000]]
    monkeypatch.setattr(quality_classifier, "STEP", step)
    for t in long:
        got = np.concatenate([np.zeros(0, np.int64), *(slots for slots, _ in quality_classifier._steps(pa.array([t])))])
        assert sorted(got.tolist()) == sorted(_slots(t))


def test_toxicity_scores(spark, texts):
    y = np.arange(len(texts)) % 2.0
    model = toxicity.train([t or "" for t in texts], y, epochs=1)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    for r in toxicity.score(rows, model).collect():
        words = [w.translate(lower) for w in RUN.findall((texts[r.doc_id] or "").encode())]
        vectors = []
        for w in words:
            buckets = [_hash(w) % toxicity.BUCKETS] + [_mix(_hash(w[:k]) + k) % toxicity.BUCKETS for k in toxicity.PREFIXES]
            vectors.append(sum(model["embedding"][model["index"][b]].astype(float) for b in buckets))
        pooled = []
        for width, filters, bias in zip(toxicity.WIDTHS, model["filters"], model["bias"]):
            for f in range(toxicity.FILTERS):
                pooled.append(max([0.0, *(bias[f] + sum(vectors[i + k] @ filters[k, :, f] for k in range(width)) for i in range(len(words) - width + 1))]))
        for f in range(toxicity.WIDE_FILTERS):
            pooled.append(max([0.0, *(model["bias"][-1][f] + sum(v @ model["filters"][-1][:, f] for v in vectors[i : i + toxicity.WIDE]) for i in range(len(words)))]))
        votes = [sum(w.decode(errors="replace") in own for w in words) for own in toxicity.FUNCTION_WORDS.values()]
        a, b = model["curves"][votes.index(max(votes)) if max(votes) else len(votes)]
        assert r.score == pytest.approx(_logistic(a * (np.array(pooled) @ model["out"] + model["base"]) + b), abs=1e-5)


def _letter_grams(text):
    """The n-grams of a lower-cased text: white space is a blank, symbols and digits are in none, the middle byte is a letter."""
    letter = lambda c: 97 <= c <= 122 or 65 <= c <= 90 or c >= 128
    data = text.lower().encode()
    for size in language_id.SIZES:
        for i in range(len(data) - size + 1):
            part = data[i : i + size]
            if letter(part[size // 2]) and all(letter(c) or c in b" \t\n\x0b\x0c\r" for c in part):
                yield _mix(int.from_bytes(bytes(c if letter(c) else 32 for c in part), "big") * int(K.GRAM) + size)


def test_language_decisions(texts):
    rows = [(name, t) for name, t in zip(["a", "b", "c"] * len(texts), texts) if t and len(t) < 3000]
    model = language_id.train(rows)
    size = model["slots"].shape[1]
    for t, got, score in zip(texts, *language_id.decide(model, pa.array(texts, pa.string()))[:2], strict=True):
        if not t or not any(c.isalpha() for c in t):
            assert (got, score) == ("und", 0)
            continue
        if len(t) > 3000:
            continue
        grams = list(_letter_grams(t))
        share = []
        for bit, chance in enumerate(model["chance"]):
            hits = sum(all(int(model["slots"][0][(g >> 32 * p) % size]) >> bit & 1 for p in range(language_id.HASHES)) for g in grams)
            share.append(min(max((hits - chance * len(grams)) / max((1 - chance) * len(grams), 1e-9), 0), 1))
        best = share.index(max(share))
        assert got == model["langs"][best]
        assert score == pytest.approx(share[best] / sum(share) * share[best] ** 0.25 if sum(share) else 0, abs=1e-9)


def test_ties_go_to_the_first_language():
    model = language_id.train([("b", "same words here"), ("a", "same words here"), ("c", "other")])
    assert language_id.decide(model, pa.array(["same words here", "words"]))[0] == ["a", "a"]


def test_kept_is_the_rules_verdict(spark, real):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    x, bad = quality_rules.training_rows(real, labels)
    rules = quality_rules.learn(x, bad)
    assert rules
    stats = {r.doc_id: r for r in quality_rules.text_statistics(real).collect()}
    features = {
        "n_words": lambda s: s.n_words,
        "chars_per_word": lambda s: s.word_chars / s.n_words,
        "symbols_per_word": lambda s: s.n_symbols / s.n_words,
        "dup_lines_share": lambda s: s.n_dup_lines / max(s.n_lines, 1),
        "repeat_words_share": lambda s: s.n_repeat_words / s.n_words,
        "upper_share": lambda s: s.n_upper / max(s.n_letters, 1),
        "words_per_line": lambda s: s.n_words / max(s.n_lines, 1),
        "distinct_share": lambda s: s.n_distinct_words / s.n_words,
        "stops_per_word": lambda s: s.n_stops / s.n_words,
    }
    assert set(features) == set(quality_rules.FEATURES)

    def holds(c, s):
        value = features[c.feature](s)
        return value > c.threshold if c.above else value <= c.threshold

    got = quality_rules.judge(real, labels).collect()
    for r in got:
        s = stats[r.doc_id]
        failed = s.n_words < 50 or 100 * s.n_repeat_words > 50 * s.n_words
        assert r.kept == (not failed and not any(all(holds(c, s) for c in rule) for rule in rules))
    assert {r.kept for r in got if not r.base_failed} == {True, False}


def test_class_model_scores(real, monkeypatch):
    """The score is the sum of the class transitions and the smoothed shares of the words in their classes."""
    seen, scores = [], class_lm._scores
    monkeypatch.setattr(class_lm, "_scores", lambda shared: seen.append(shared.value) or scores(shared))
    got = {r.doc_id: r for r in class_lm.score(real).collect()}
    m = seen[0]
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    rows = {r.doc_id: [w.translate(lower) for w in WORD.findall(r.text.encode())] for r in real.collect() if r.text is not None}
    held = lambda i: zlib.crc32(str(i).encode()) % class_lm.PARTS == class_lm.HELD
    count: dict[bytes, int] = {}
    for i, words in rows.items():
        for w in words if not held(i) else ():
            count[w] = count.get(w, 0) + 1
    ends = sum(not held(i) for i in got)
    own = {int(w): int(u) for w, u in zip(m["w"], m["unit"], strict=True) if u >= 0}
    classes: dict[bytes, int] = {}

    def class_of(w):
        if w not in classes:
            unit = own.get(_hash(w))
            if unit is None:
                value = 0
                for k in range(1, 4):
                    value = value << 8 | (w[-k] if len(w) >= k else 0)
                unit = m["words"] + _mix(value + 1) % class_lm.SUFFIXES
            classes[w] = int(m["class"][unit])
        return classes[w]

    size, kinds = [0] * class_lm.CLASSES, [0] * class_lm.CLASSES
    for w, n in count.items():
        size[class_of(w)] += n
        kinds[class_of(w)] += 1
    end = class_lm.CLASSES - 1
    size[end], kinds[end] = ends, int(ends > 0)
    after = np.zeros((class_lm.CLASSES, class_lm.CLASSES))
    for i, words in rows.items():
        if not held(i):
            path = [end, *map(class_of, words), end]
            np.add.at(after, (path[:-1], path[1:]), 1)
    alone = (after.sum(0) + 0.5) / (after.sum() + 0.5 * class_lm.CLASSES)
    step = (after + class_lm.PRIOR * alone) / (after.sum(1, keepdims=True) + class_lm.PRIOR)
    for i, words in list(rows.items())[:300]:
        path = [end, *map(class_of, words), end]
        n = [*(count.get(w, 0) for w in words), ends]
        want = sum(math.log10(step[a, b]) + math.log10((c + 0.5) / (size[b] + 0.5 * (kinds[b] + 1))) for a, b, c in zip(path, path[1:], n))
        assert got[i].score == pytest.approx(want, abs=1e-6 * len(path))


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.8), (quality_classifier, "quality", 0.95)])
def test_ranks_of_held_out_rows(spark, real, label_rows, module, label, least):
    got = {r.doc_id: r.score for r in module.classify(real, spark.createDataFrame(label_rows)).where("held_out").collect()}
    y = {r.doc_id: r[label] for r in label_rows if r.doc_id in got}
    one, zero = [got[i] for i in y if y[i] == 1], [got[i] for i in y if y[i] == 0]
    assert len(one) > 3 and len(zero) > 3
    assert sum((a > b) + 0.5 * (a == b) for a in one for b in zero) / (len(one) * len(zero)) > least


def test_run_is_its_stages(spark, tmp_path):
    """The pipeline's rows are those of its stages, one after the other, each on all rows of the one before."""
    import corpus_pipeline

    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    # which sequence a piece is in may depend on the order of equal pieces
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    want, got = docs.select(names), corpus_pipeline.run(spark, small).persist()
    assert got.select(names).exceptAll(want).isEmpty() and want.exceptAll(got.select(names)).isEmpty()
    filled = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert filled.where("n <> end or n > 2048").isEmpty()
