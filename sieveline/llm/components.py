"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on node ids; nothing reaches the driver. A
star's centre is only ever joined, never gathered, so a hub with millions of links
is split by Spark's skew-join handling like any hot key. Each step is written to the
shared folder, in as few files as its rows need. A link table small enough for one
task, which is counted first, is joined there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Rows a written file; links that one task may join (16 MB).
FILE_ROWS, FEW = 500_000, 1 << 20


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.where("b < a")
    low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = around.join(low, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their labels: minima spread over links, halving paths each time."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if parts:
        node, label = joined(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], names=["node", "label"])


def components(edges: DataFrame, few: int = FEW, files: int | None = None) -> DataFrame:
    """(node, label) of every node with a link: label is the smallest node id it reaches.

    edges: (a, b), any order, repeats allowed; null ends and self-links are ignored. At
    most ``few`` distinct links are joined in one task, more by star steps; the labels
    are the same. files: of the first table, if the caller knows about how large it is.
    """
    now = cut(edges.select("a", "b").where("a <> b").distinct(), files)
    rows, before = now.count(), None
    if rows <= few:
        return cut(now.repartition(1).mapInArrow(_joined, "node long, label long"))
    while True:
        # a step makes no more rows than twice its input: few files for few rows
        now = cut(_star(_star(now, large=True), large=False), 1 + 2 * rows // FILE_ROWS)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        rows, before = state[0], state
    spread = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return cut(spread.union(spread.select(F.col("label").alias("node"), "label").distinct()), 1 + 2 * rows // FILE_ROWS)
