"""What the learned operators share: bounded labelled samples, held-out folds, calibration."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: int) -> DataFrame:
    """(o, doc_id, y, text) of at most ``most`` documents of each label, outside the held-out fold.

    A bounded sample by a hash of doc_id: the same rows on every run. Documents without
    text or label are left out; of a doc_id labelled more than once the largest label
    counts, of one with several rows the least text.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(fold(F.col("doc_id"), parts) != held)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("y") == v).select("doc_id", "y", order.alias("o")).orderBy("o", "doc_id").limit(most) for v in (0, 1)]
    return docs.where("text is not null").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").groupBy("o", "doc_id", "y").agg(F.min("text").alias("text"))


def fit_in_task(rows: DataFrame, fit: Callable[[pa.Table], Any]) -> Any:
    """fit of a bounded table, run in one task of an executor: the driver gets the model, not the rows."""
    schema = rows.limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows], schema)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(table))], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found[0]) if found else fit(pa.Table.from_batches([], schema))


def sample_rows(table: pa.Table) -> tuple[list[str], np.ndarray]:
    """Texts and labels of labelled() rows, in the order of the hash, one row a doc_id."""
    rows = table.sort_by([("o", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    ids = rows["doc_id"].to_numpy()
    first = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, bool)
    rows = rows.filter(pa.array(first))
    return rows["text"].to_pylist(), rows["y"].to_numpy().astype(np.float64)


def platt(score: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """a, b of the logistic curve sigmoid(a * score + b) that fits the labels; Newton steps with a small penalty."""
    a, b = 1.0, 0.0
    if not len(y) or y.min() == y.max():
        return a, b
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        w, r = p * (1 - p) + 1e-6, p - y
        g = np.array([(r * score).sum() + 1e-2 * (a - 1), r.sum() + 1e-2 * b])
        h = np.array([[(w * score * score).sum() + 1e-2, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the highest F1 of label 1, halfway to the next lower score; 0 without both labels."""
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    last = np.append(s[1:] != s[:-1], True)
    f1 = np.where(last, 2 * hit / (np.arange(1, len(s) + 1) + y.sum()), -1)
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] - 1e-3)
