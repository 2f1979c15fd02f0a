"""Cases in which the operators once did less than the whole job."""

from __future__ import annotations

import numpy as np

from sieveline.llm import class_lm, language_id


def test_words_after_the_top_have_classes_of_their_own(spark):
    """Two kinds of words alternate. All end alike, and more than TOP words are more frequent."""
    rng = np.random.default_rng(0)
    filler = [" ".join(f"f{i}" for i in rng.permutation(class_lm.TOP + 50)) for _ in range(100)]
    first, second = [f"a{i}zzz" for i in range(20)], [f"b{i}zzz" for i in range(20)]
    pairs = [" ".join(w for i, j in zip(rng.permutation(20), rng.permutation(20), strict=True) for w in (first[i], second[j])) for _ in range(90)]
    good, bad = " ".join(w for p in zip(first, second, strict=True) for w in p), " ".join(first + second)
    rows = list(enumerate([*filler, *pairs, good, bad]))
    got = {r.doc_id: r.score for r in class_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[len(rows) - 2] > got[len(rows) - 1] + 1


def test_best_classes_are_those_of_the_likelihood():
    """The chosen class is the one whose whole class matrix has the highest likelihood."""
    rng = np.random.default_rng(1)
    units, classes = 12, 5
    n = rng.integers(0, 9, (units + 1, units + 1))
    own = np.append(rng.integers(0, classes - 1, units), classes - 1)

    def matrix(own):
        out = np.zeros((classes, classes))
        np.add.at(out, (own[:, None].repeat(units + 1, 1), own[None, :].repeat(units + 1, 0)), n)
        return out

    a, b = np.nonzero(n)
    key, count = class_lm._contexts(a, b, n[a, b], {"own": own, "units": units + 1, "turns": 1, "turn": 0})
    key, _, count = class_lm._merged([key], [count])
    got = class_lm.best_classes(key, count, own, matrix(own))
    for u, c in zip(*got, strict=True):
        value = [class_lm.likelihood(matrix(np.where(np.arange(units + 1) == u, k, own))) for k in range(classes - 1)]
        assert value[c] >= max(value) - 1e-6


def test_more_languages_than_bits_of_a_word(spark):
    """Seventy languages, each of its own words: all are learned and told apart."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(70 * 8)]
    rows = [(i, " ".join(words[i % 70 * 8 : i % 70 * 8 + 8]), f"l{i % 70:02}") for i in range(700)]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id: r.lang_pred for r in found} == {i: lang for i, _, lang in rows}
