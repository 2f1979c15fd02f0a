"""Supersteps of best-fit packing against a plain stack and against best-fit decreasing."""

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sieveline.llm import packing
from sieveline.llm.common import cut


def best_fit_decreasing(lengths, most):
    gaps, made = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(gaps, n)
        room = gaps.pop(at) if at < len(gaps) else most
        made += room == most
        if room > n:
            insort(gaps, room - n)
    return made


def placed(spark, lengths, most):
    pieces = cut(spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "pid long, length long"))
    return sorted(tuple(r) for r in packing.place(pieces, most).collect())


def check_whole(rows, lengths, most):
    assert [r[0] for r in rows] == list(range(len(lengths)))
    by = defaultdict(list)
    for pid, sequence, offset in rows:
        by[sequence].append((offset, lengths[pid]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= most
    return len(by)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.booleans(), max_size=8), max_size=8))
def test_ranges_carry_as_one_stack_would(ranges):
    # True a piece, False a slot; whole: one stack over all ranges
    stack, want = [], set()
    left, pieces, slots = {}, {}, {}
    at = 0
    for part, marks in enumerate(ranges):
        mine, free = [], []
        for piece in marks:
            if piece:
                stack.append(at)
                mine.append(at)
            else:
                if stack:
                    want.add((stack.pop(), at))
                if mine:
                    mine.pop()
                else:
                    free.append(at)
            at += 1
        left[part], pieces[part], slots[part] = (len(mine), len(free)), mine, free
    got, met = set(), set()
    for source, low, high, target, first, last, base in packing.carried(left):
        assert source < target and high - low == last - first
        for k in range(high - low):
            got.add((pieces[source][high - 1 - k], slots[target][first + k]))
            met.add(base + k)
    part_of = {x: p for p in left for x in pieces[p] + slots[p]}
    assert got == {(a, b) for a, b in want if part_of.get(a) is not None and part_of.get(b) is not None and a in pieces[part_of[a]] and b in slots[part_of[b]]}
    assert met == set(range(len(got)))


def test_ranges_do_not_change_the_places_and_few_sequences_are_made(spark, monkeypatch):
    rng = np.random.default_rng(3)
    lengths = [int(n) for n in np.clip(rng.lognormal(3.2, 0.9, 700), 1, 64)] + [64] * 40 + [1] * 60
    whole = placed(spark, lengths, 64)
    monkeypatch.setattr(packing, "ROWS", 40)
    assert placed(spark, lengths, 64) == whole
    made = check_whole(whole, lengths, 64)
    assert made <= 1.005 * best_fit_decreasing(lengths, 64) + 1


@pytest.mark.parametrize("lengths", [[], [64], [1] * 130, [33] * 5, [64, 32, 32, 1]], ids=str)
def test_small_tables(spark, lengths):
    made = check_whole(placed(spark, lengths, 64), lengths, 64)
    assert made <= best_fit_decreasing(lengths, 64)


@pytest.mark.parametrize("unit", ["\n", " ", "\t", "\x0b", "\x0c", "\r", "\u3000", "\xa0", "x", "\n ", "é", "7", "-"])
def test_long_runs_have_the_ids_of_the_named_tokenizer(unit):
    import public_tokenizers
    import tokenizers

    exact = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing._tokenizer(*packing_paths())
    for n in (packing.RUN - 1, packing.RUN, 2_000_000):
        text = "a" + unit * (n // len(unit)) + "b"
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_plain_texts_do_not_load_the_named_tokenizer():
    import tokenizers

    packing._tokenizer.cache_clear(), packing._exact.cache_clear()
    encode = packing._tokenizer(*packing_paths())
    exact = tokenizers.Tokenizer.from_file(packing_paths()[0])
    plain = "Two words, and\n\n some\u3000more's."
    assert encode(plain).tolist() == exact.encode(plain, add_special_tokens=False).ids
    assert packing._exact.cache_info().currsize == 0
    for special in exact.get_added_tokens_decoder().values():
        text = f"a{special.content}b"
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids
    assert packing._exact.cache_info().currsize == 1


def packing_paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_long_runs_pack(spark):
    texts = ["a" + c * 2_000_000 + "b" for c in "\n \t\x0b\x0c\rx"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows} == set(range(len(texts)))
    assert all(r.length <= packing.SEQUENCE for r in rows)
