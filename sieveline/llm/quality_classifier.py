"""Quality classifier: hashed word n-gram logistic regression, learned by follow-the-regularised-leader.

Tokens are runs of letters and digits, and runs of other symbols; a text's features
are its token n-grams of 1 and 2 tokens and the case-and-length shapes of its
tokens, hashed to ``SLOTS`` slots, each with its share of the text's n-grams. FTRL-
proximal updates, one document at a time, leave a sparse weight vector; scoring is
a sparse dot product, a gather and a sum per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import documents, fold, prepare
from .training import best_cut, fit_in_task, labelled, platt, sample_rows

PARTS, HELD, CUT = 5, 0, 0.3
SLOTS, SAMPLE, EPOCHS = 1 << 18, 6000, 3
#: Bytes of a long text whose features are taken at a time: they need about forty times as much.
STEP = K.PIECE
#: FTRL-proximal: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1.0

_kind = np.full(256, 2, np.uint8)  # 0 white space, 1 letters, digits and UTF-8 bytes, 2 symbols
_kind[K._space] = 0
_kind[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_upper = np.zeros(256, bool)
_upper[65:91] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True


def features(data: np.ndarray, doc_at: np.ndarray, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all documents of a slice, and the first of each document; the ``lead`` first tokens count in pairs only."""
    n = len(doc_at) - 1
    kind = _kind[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[doc_at] = True
    start = np.flatnonzero(edge[:-1] & (kind > 0))
    end = np.flatnonzero(edge[1:] & (kind > 0)) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    token = K.Words.__new__(K.Words)
    token.data, token.doc_at, token.start, token.end = data, doc_at, start, end
    token.first = np.searchsorted(start, doc_at)
    h = token.hashes()
    upper, digit = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
    np.cumsum(_upper[data], out=upper[1:])
    np.cumsum(_digit[data], out=digit[1:])
    size, capital, digits = end - start, upper[end] - upper[start], digit[end] - digit[start]
    case = np.where(capital == 0, 0, np.where(capital == size, 1, np.where(capital == 1, 2, 3)))
    shape = (np.minimum(size, 24) // 3 * 4 + case) * 3 + np.where(digits == 0, 0, np.where(digits == size, 1, 2))
    shape = K.mix(shape.astype(K.U64) * K.GRAM + kind[start].astype(K.U64) + K.U64(7))
    symbol = kind[start] == 2
    coarse = np.where(symbol, h, shape)
    at, many = K.gram_starts(token.first, 2)
    parts = [h[lead:], shape[lead:], K.grams(h, 2)[at], K.mix(K.grams(coarse, 2)[at])]
    doc = token.doc()
    owners = [doc[lead:], doc[lead:], doc[at], doc[at]] if len(at) else [doc[lead:], doc[lead:], at, at]
    slots, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner.astype(np.int32), kind="stable")
    return (slots[order] & K.U64(SLOTS - 1)).astype(np.int64), np.searchsorted(owner[order], np.arange(n + 1))


def _pieces(data: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in parts of about ``STEP`` bytes, cut between tokens, each behind the token before it; and how many tokens that is."""
    begin, last = 0, data[:0]
    for a in range(0, len(data), STEP):
        b, before = min(a + STEP, len(data)), max(a - 1, 0)
        kind = _kind[data[before:b]]
        edges = np.flatnonzero(kind[1:] != kind[:-1]) + before + 1
        cut = b if b == len(data) else int(edges[-1]) if len(edges) else begin
        part = data[begin:cut]
        begin = cut
        kind = _kind[part]
        filled = np.flatnonzero(kind)
        if not len(filled):
            continue
        # a blank between two tokens changes no feature
        yield np.concatenate([last, np.full(1, 32, np.uint8), part]), int(len(last) > 0)
        end = int(filled[-1])
        other = np.flatnonzero(kind[:end] != kind[end])
        last = part[int(other[-1]) + 1 if len(other) else 0 : end + 1]


def _steps(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """features() of a slice, at once if it is short, else in steps over its one long text."""
    data, doc_at = K.raw(col)
    if len(col) > 1 or len(data) <= STEP:
        yield features(data, doc_at)
        return
    for part, lead in _pieces(data):
        yield features(part, np.array([0, len(part)]), lead)


def _margins(weights: np.ndarray, bias: float, col: pa.Array) -> np.ndarray:
    total, count = np.zeros(len(col)), np.zeros(len(col), np.int64)
    for slots, first in _steps(col):
        total += K.sums(weights[slots], first)
        count += np.diff(first)
    return bias + total / np.sqrt(np.maximum(count, 1))


def _sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for batch in K.slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])]):
        if batch.num_rows == 1:
            n = np.zeros(SLOTS, np.int64)
            for slots, _ in _steps(batch.column("text")):
                n += np.bincount(slots, minlength=SLOTS)
            ids = np.flatnonzero(n)
            out.append((ids, n[ids] / np.sqrt(max(n.sum(), 1))))
            continue
        slots, first = features(*K.raw(batch.column("text")))
        for a, b in zip(first[:-1], first[1:], strict=True):
            ids, n = np.unique(slots[a:b], return_counts=True)
            out.append((ids, n / np.sqrt(max(b - a, 1))))
    return out


def train(texts: list[str], y: np.ndarray, epochs: int = EPOCHS) -> dict:
    """Weights of FTRL-proximal over the documents in their order, and the calibration of the margins.

    Every fifth document is left out of the updates; on these the margins are calibrated
    so that the cut of best F1 has score ``CUT``.
    """
    rows = _sparse(texts)
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)
    bias_z = bias_n = 0.0
    weigh = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(epochs):
        for k, (ids, x) in enumerate(rows):
            if k % 5 == 0:
                continue
            w = weigh(z[ids], n[ids])
            b = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w @ x + b, -30, 30)))
            g = (p - y[k]) * x
            s = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA
            z[ids] += g - s * w
            n[ids] += g * g
            g0 = p - y[k]
            bias_z += g0 - (np.sqrt(bias_n + g0 * g0) - np.sqrt(bias_n)) / ALPHA * b
            bias_n += g0 * g0
    weights, bias = weigh(z, n), -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
    kept = np.arange(len(rows)) % 5 == 0
    margins = np.array([bias + weights[ids] @ x for ids, x in rows])
    if not len(rows):
        return {"weights": weights.astype(np.float32), "bias": 0.0, "a": 1.0, "b": 0.0}
    a, b = platt(margins[kept], y[kept])
    a = max(a, 1e-3)
    b = float(np.log(CUT / (1 - CUT)) - a * best_cut(margins[kept], y[kept])) if y[kept].min() != y[kept].max() else b
    return {"weights": weights.astype(np.float32), "bias": float(bias), "a": a, "b": b}


def score(docs: DataFrame, model: dict, parts: int = PARTS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null text scores as an empty one."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = m["weights"].astype(np.float64)
        for batch in K.slices(batches):
            margin = _margins(weights, m["bias"], batch.column("text"))
            p = 1 / (1 + np.exp(-np.clip(m["a"] * margin + m["b"], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents(docs).withColumn("held_out", fold(F.col("doc_id"), parts) == held)
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from a bounded sample of the labelled rows outside the held-out fold, score every row of docs.

    sample: most documents of either label to learn from. Null labels and texts are not
    learned from; without labels of both kinds the scores are the prior's. Columns of
    docs besides doc_id and text are ignored. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = labelled(documents(docs), labels, "quality", PARTS, HELD, sample)
    return score(docs, fit_in_task(rows, lambda t: train(*sample_rows(t))))
