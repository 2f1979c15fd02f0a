"""Words whose polynomial hashes modulo 2**64 collide for every odd base are different words to every operator."""

import math

from sieveline.llm import class_lm, near_dedup, substring_dedup


def _structured(first: str, other: str, length: int = 1024) -> str:
    """A Thue-Morse string."""
    return "".join((first, other)[bin(i).count("1") % 2] for i in range(length))


X, Y = _structured("a", "b"), _structured("b", "a")


def test_near_duplicates_keeps_both(spark):
    rows = near_dedup.near_duplicates(spark.createDataFrame([(1, X), (2, Y)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(1, 1, True), (2, 2, True)]


def test_windows_with_either_word_differ(spark):
    around = [f"w{i}" for i in range(60)]
    texts = [" ".join([*around[:30], word, *around[30:]]) for word in (X, Y, X)]
    rows = substring_dedup.substring_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(0, 0), (1, 0), (2, 61)]


def test_counts_are_apart(spark):
    # doc_ids 0 and 1 are in the training part
    rows = {r.doc_id: r for r in class_lm.score(spark.createDataFrame([(0, X), (1, f"{X} {X} {Y}")], "doc_id long, text string")).collect()}
    total, kinds = 6, 3
    one = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    assert rows[0].train_tokens == total and not rows[0].held_out and not rows[1].held_out
    assert math.isclose(rows[0].base_score, one(3) + one(2)) and math.isclose(rows[1].base_score, 2 * one(3) + one(1) + one(2))
