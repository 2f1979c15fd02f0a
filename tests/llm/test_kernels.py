import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import components, kernels as K, substring_dedup
from sieveline.llm.quality_rules import statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab Aé\n\t |", max_size=60)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_the_pattern_s(texts):
    words = K.Words(pa.array(texts, pa.string()))
    raw = bytes(words.data)
    for i, text in enumerate(texts):
        got = [raw[a:b].decode() for a, b in zip(words.start[words.first[i] : words.first[i + 1]], words.end[words.first[i] : words.first[i + 1]], strict=True)]
        assert got == WORD.findall(text or "")


def test_equal_words_have_equal_hashes_and_others_do_not():
    words = K.Words(pa.array(["a b ab a", None, "", "A  ab\tba b"]))
    h = words.hashes()
    raw = bytes(words.data)
    names = [raw[a:b] for a, b in zip(words.start, words.end, strict=True)]
    assert len(set(zip(names, h.tolist()))) == len(set(names)) == len(set(h.tolist()))
    assert words.hashes(fold_case=True)[4] == h[0]


def test_hash_does_not_depend_on_place_or_piece(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    one = K.Words(pa.array([text])).hashes()
    monkeypatch.setattr(K, "PIECE", 1 << 10)
    two = K.Words(pa.array(["x " + text])).hashes()[1:]
    assert (one == two).all()


def test_slices_keep_every_row_and_long_texts_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 5000, "", "c"])], names=["text"])
    parts = list(K.slices([batch], most=100))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    assert max(p.num_rows for p in parts) < 5


def test_least_of_windows():
    x = np.array([5, 3, 8, 1, 9, 2, 7])
    for width in (1, 2, 3, 5, 7):
        assert substring_dedup._least(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=25))
def test_joined_links(pairs):
    a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    node, label = components.joined(a, b)
    want = {int(n): int(n) for n in np.concatenate([a, b])}
    for _ in range(30):
        for x, y in pairs:
            want[x] = want[y] = min(want[x], want[y])
    assert dict(zip(node.tolist(), label.tolist())) == want


def test_statistics_of_odd_texts():
    got = statistics(pa.array(["", None, "x\n\nx\n y\n y\nx ", "a b c a b c", "#* é|"]))
    assert got[:, :5].tolist() == [[0] * 5, [0] * 5, [5, 5, 0, 2, 0], [6, 6, 0, 0, 6], [2, 4, 3, 0, 0]]
