"""Toxicity: a convolutional text classifier trained in numpy.

Words (runs of letters and digits, A-Z lower-cased) and their first 4, 5 and 6 bytes
are hashed to ``BUCKETS``; a bucket seen in training has an embedding of ``DIM``
numbers, all others zeros, and a word's embedding is the sum of its four. Filters of
widths 1, 2, 3 and ``WIDE`` run over the word sequence (the wide ones weigh all
their words alike, so they see density), each is pooled by its maximum over the
text (and 0), and a logistic unit reads the pooled values. Training is minibatch
AdaGrad; the first embedding dimension starts from how much oftener a bucket is in
label 1, which the first filters of width 1 and ``WIDE`` read.

For scoring, every filter row is multiplied into the embeddings of a batch's distinct
words once, so a word costs lookups and additions. Training runs in one task over
the bounded sample. Thresholds are calibrated by language: the language is
guessed from the text's own function words, and each one's scores are shifted so
that the cut of best F1 on texts kept out of training is ``CUT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import documents, fold, prepare
from .quality_classifier import _kind
from .training import best_cut, fit_in_task, labelled, platt, sample_rows

PARTS, HELD, CUT = 4, 2, 0.3
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 20, 8, (1, 2, 3), 6
WIDE, WIDE_FILTERS, PREFIXES = 32, 4, (4, 5, 6)
POOLED = len(WIDTHS) * FILTERS + WIDE_FILTERS
#: Documents of either label to learn from at most; words of each that training reads at a time.
SAMPLE, EPOCHS, BATCH, RATE = 3000, 6, 32, 0.05
#: Function words by language.
FUNCTION_WORDS = {
    "en": "the and of to in is that for it with as was on be are by this at from".split(),
    "de": "der die und den das von zu mit sich des ist im dem nicht ein eine als auch es".split(),
    "fr": "le la les et de des du un une en que qui dans pour est par sur au plus".split(),
    "es": "el la los las de que y en un una por con para del se al lo como su".split(),
}


def tokens(col: pa.Array) -> K.Words:
    """The letter-and-digit runs of the documents, as words."""
    words = K.Words(col)
    run = _kind[words.data] == 1
    edge = np.ones(len(run) + 1, bool)
    edge[1:-1] = run[1:] != run[:-1]
    edge[words.doc_at] = True
    words.start = np.flatnonzero(edge[:-1] & run)
    words.end = np.flatnonzero(edge[1:] & run) + 1
    words.first = np.searchsorted(words.start, words.doc_at)
    return words


def vocabulary(words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes of a slice, each word's index among them, and their buckets: the word's and its prefixes'."""
    h = K.span_hashes(words.data, words.start, words.end, fold_case=True)
    distinct, at, index = np.unique(h, return_index=True, return_inverse=True)
    start, end = words.start[at], words.end[at]
    order = np.argsort(start)
    buckets = np.empty((len(distinct), 1 + len(PREFIXES)), np.int64)
    buckets[:, 0] = (distinct & K.U64(BUCKETS - 1)).astype(np.int64)
    for k, size in enumerate(PREFIXES):
        p = K.span_hashes(words.data, start[order], np.minimum(end, start + size)[order], fold_case=True)
        buckets[order, 1 + k] = (K.mix(p + K.U64(size)) & K.U64(BUCKETS - 1)).astype(np.int64)
    return distinct, index, buckets


@lru_cache(maxsize=1)
def _function_hashes() -> list[np.ndarray]:
    lists = [" ".join(v) for v in FUNCTION_WORDS.values()]
    words = tokens(pa.array(lists))
    h = K.span_hashes(words.data, words.start, words.end, fold_case=True)
    return [h[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def languages(distinct: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index of the language with most function words in each document; one past the last if none."""
    votes = np.stack([K.sums(np.isin(distinct, own)[index], first) for own in _function_hashes()], axis=1)
    return np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(FUNCTION_WORDS))


def _offsets() -> list[tuple[int, int, int]]:
    """(width, place in the filter, first column of that row's outputs)."""
    out, at = [], 0
    for width in WIDTHS:
        for k in range(width):
            out.append((width, k, at))
            at += FILTERS
    return out


def _pooled(table: np.ndarray, bias: list[np.ndarray], rows: np.ndarray, first: np.ndarray, where: bool = False):
    """Pooled filter outputs of each document, and, if asked, the word at which each maximum starts (-1: none)."""
    n = len(first) - 1
    pooled, at = np.zeros((n, POOLED)), np.full((n, POOLED), -1)
    counts = np.diff(first)

    def keep(conv: np.ndarray, starts: np.ndarray, many: np.ndarray, own: slice, add: np.ndarray) -> None:
        some = np.flatnonzero(many > 0)
        if not len(some):
            return
        begin = (np.cumsum(many) - many)[some]
        pooled[some, own] = np.maximum(np.maximum.reduceat(conv, begin, axis=0) + add, 0)
        if where:
            for d, a, b in zip(some, begin, np.append(begin[1:], len(starts)), strict=True):
                at[d, own] = starts[a + conv[a:b].argmax(axis=0)]

    for i, width in enumerate(WIDTHS):
        starts, many = K.gram_starts(first, width)
        conv = np.zeros((len(starts), FILTERS), table.dtype)
        for w, k, col in _offsets():
            if w == width:
                conv += table[rows[starts + k], col : col + FILTERS]
        keep(conv, starts, many, slice(i * FILTERS, (i + 1) * FILTERS), bias[i])
    total = np.zeros((len(rows) + 1, WIDE_FILTERS))
    np.cumsum(table[rows, -WIDE_FILTERS:], axis=0, out=total[1:])
    starts = np.arange(len(rows))
    ends = np.minimum(starts + WIDE, np.repeat(first[1:], counts))
    keep(total[ends] - total[starts], starts, counts, slice(POOLED - WIDE_FILTERS, POOLED), bias[-1])
    at[pooled <= 0] = -1
    return pooled, at


def _table(embedding: np.ndarray, filters: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([*(embedding @ filters[i][k] for i, width in enumerate(WIDTHS) for k in range(width)), embedding @ filters[-1]], axis=1)


def train(texts: list[str], y: np.ndarray, epochs: int = EPOCHS) -> dict:
    """The network and its calibration; every fourth text calibrates and is not trained on."""
    words = tokens(pa.array(texts, pa.large_string()))
    distinct, rows, buckets = vocabulary(words)
    first = words.first
    known = np.unique(buckets)
    parts = (np.searchsorted(known, buckets) + 1).astype(np.int32)  # row 0: buckets not seen
    calibrate = np.arange(len(texts)) % 4 == 0
    rng = np.random.default_rng(7)
    embedding = rng.normal(0, 0.02, (len(known) + 1, DIM))
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    hot, cold = np.zeros(len(embedding)), np.zeros(len(embedding))
    pair = np.unique(doc * max(len(distinct), 1) + rows)
    for k in range(parts.shape[1]):
        seen = np.unique(pair // max(len(distinct), 1) * len(embedding) + parts[pair % max(len(distinct), 1), k])
        d, b = seen // len(embedding), seen % len(embedding)
        use = ~calibrate[d]
        hot += np.bincount(b[use & (y[d] == 1)], minlength=len(embedding))
        cold += np.bincount(b[use & (y[d] == 0)], minlength=len(embedding))
    ones, zeros = max((y[~calibrate] == 1).sum(), 1), max((y[~calibrate] == 0).sum(), 1)
    # how far the log odds of being in label 1 are above chance, less two standard errors
    odds = np.log((hot + 0.5) / (ones + 1)) - np.log((cold + 0.5) / (zeros + 1)) - 2 / np.sqrt(hot + cold + 1)
    embedding[:, 0] = np.maximum(odds, 0)
    embedding[0] = 0
    filters = [*(rng.normal(0, 0.1, (width, DIM, FILTERS)) for width in WIDTHS), rng.normal(0, 0.02, (DIM, WIDE_FILTERS))]
    filters[0][0][:, 0] = filters[-1][:, 0] = 0
    filters[0][0][0, 0] = filters[-1][0, 0] = 1.0
    bias, out, base = [np.zeros(FILTERS) for _ in WIDTHS] + [np.zeros(WIDE_FILTERS)], np.full(POOLED, 0.1), -3.0
    out[0] = out[POOLED - WIDE_FILTERS] = 0.5
    memory = [np.full_like(x, 1e-2) for x in (embedding, *filters, *bias, out)]
    base_memory = 1e-2
    train_docs = np.flatnonzero(~calibrate)
    for _ in range(epochs if len(train_docs) and y.min() != y.max() else 0):
        for part in np.array_split(rng.permutation(train_docs), -(-len(train_docs) // BATCH)):
            mine = np.concatenate([rows[first[d] : first[d + 1]] for d in part])
            at_first = np.concatenate([[0], np.cumsum(first[part + 1] - first[part])])
            used, local = np.unique(mine, return_inverse=True)
            vectors = embedding[parts[used]].sum(axis=1)
            pooled, at = _pooled(_table(vectors, filters), bias, local, at_first, where=True)
            error = (1 / (1 + np.exp(-np.clip(pooled @ out + base, -30, 30))) - y[part]) / len(part)
            grads = [np.zeros((len(used), DIM)), *(np.zeros_like(f) for f in filters), *(np.zeros_like(b) for b in bias), error @ pooled]
            back = error[:, None] * out[None, :] * (pooled > 0)
            for c in range(POOLED):
                i = min(c // FILTERS, len(WIDTHS))
                f = c - i * FILTERS
                d = np.flatnonzero(at[:, c] >= 0)
                if not len(d):
                    continue
                grads[1 + len(filters) + i][f] = back[d, c].sum()
                if i < len(WIDTHS):
                    for k in range(WIDTHS[i]):
                        which = local[at[d, c] + k]
                        np.add.at(grads[0], which, back[d, c, None] * filters[i][k, :, f])
                        grads[1 + i][k, :, f] = back[d, c] @ vectors[which]
                else:
                    span = np.minimum(WIDE, at_first[d + 1] - at[d, c])
                    which = local[np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span) + np.repeat(at[d, c], span)]
                    weight = np.repeat(back[d, c], span)
                    np.add.at(grads[0], which, weight[:, None] * filters[-1][:, f])
                    grads[1 + i][:, f] = weight @ vectors[which]
            touched, to = np.unique(parts[used], return_inverse=True)
            step = np.zeros((len(touched), DIM))
            np.add.at(step, to.reshape(-1), np.repeat(grads[0], parts.shape[1], axis=0))
            memory[0][touched] += step**2
            embedding[touched] -= RATE * step / np.sqrt(memory[0][touched])
            for x, g, m in zip([*filters, *bias, out], grads[1:], memory[1:], strict=True):
                m += g * g
                x -= RATE * g / np.sqrt(m)
            base_memory += error.sum() ** 2
            base -= RATE * error.sum() / np.sqrt(base_memory)
    embedding[0] = 0
    index = np.zeros(BUCKETS, np.int32)
    index[known] = np.arange(1, len(known) + 1)
    model = {"index": index, "embedding": embedding.astype(np.float32), "filters": filters, "bias": bias, "out": out, "base": base, "curves": None}
    margin = np.zeros(len(texts))
    for a in range(0, len(texts), 200):
        b = min(a + 200, len(texts))
        margin[a:b] = _margins(model, rows[first[a] : first[b]], buckets, first[a : b + 1] - first[a])
    group = languages(distinct, rows, first)
    curves = []
    for g in range(len(FUNCTION_WORDS) + 1):
        own = calibrate & (group == g)
        if y[own].sum() < 20 or (1 - y[own]).sum() < 20:
            own = calibrate
        a, b = platt(margin[own], y[own])
        if own.any() and y[own].min() != y[own].max():
            a = max(a, 1e-3)
            b = float(np.log(CUT / (1 - CUT)) - a * best_cut(margin[own], y[own]))
        curves.append((a, b))
    model["curves"] = np.array(curves)
    return model


def _margins(model: dict, rows: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """rows: index of each word into buckets."""
    table = _table(model["embedding"][model["index"][buckets]].sum(axis=1), model["filters"])
    pooled, _ = _pooled(table, model["bias"], rows, first)
    return pooled @ model["out"] + model["base"]


def score(docs: DataFrame, model: dict, parts: int = PARTS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null text scores as an empty one."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in K.slices(batches):
            words = tokens(batch.column("text"))
            distinct, index, buckets = vocabulary(words)
            curve = m["curves"][languages(distinct, index, words.first)]
            p = 1 / (1 + np.exp(-np.clip(curve[:, 0] * _margins(m, index, buckets, words.first) + curve[:, 1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents(docs).withColumn("held_out", fold(F.col("doc_id"), parts) == held)
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from a bounded sample of the labelled rows outside the held-out fold, score every row of docs.

    sample: most documents of either label to learn from. Null labels and texts are not
    learned from; without both labels the network stays as it starts. Columns of docs
    besides doc_id and text are ignored. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = labelled(documents(docs), labels, "toxic", PARTS, HELD, sample)
    return score(docs, fit_in_task(rows, lambda t: train(*sample_rows(t))))
