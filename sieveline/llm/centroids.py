"""Centroid clustering: Lloyd's rounds by two trees.

The vectors are written once as cover trees, one for each Arrow batch of at most
``BATCH`` of them, so no row is shuffled and no task holds more than a batch. A round
builds a cover tree over the centroids as well, and every batch walks both trees
together. A pair of nodes is dropped when the least distance between anything in them
exceeds the largest distance to some other node of centroids. Nodes left with one
centroid are assigned whole; pairs of leaves are compared exactly, in integers.

A task adds up its vectors by cluster and gives at most clusters x components sums, in
limbs so that they are exact at any size; Spark adds the tasks' sums, and the driver
turns them into the next centroids. It holds the centroids and their sums only, whose
number is a parameter.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare
from .topk import whole

SCALE, DIM, CENTROIDS, ROUNDS, SEED = 256, 64, 40, 5, "2"
#: Vectors of a tree; points of a leaf; pairs compared at once; bits of a limb.
BATCH, LEAF, PAIRS, LIMB = 1024, 8, 1 << 14, 40
HIGH = (1 << 63) - 1


def _largest(v: np.ndarray) -> int:
    return max(abs(int(v.max())), abs(int(v.min()))) if v.size else 0


class CoverTree:
    """Nodes in arrays, a node's points in ``order[low:high]``, its centre first.

    A node's children cover it by balls of half its radius around points of it that are
    further apart than that; the first child has the node's own centre. Leaves have at most ``leaf``
    points or equal ones; with ``single`` every leaf is one point.
    """

    def __init__(self, v: np.ndarray, leaf: int = LEAF, single: bool = False):
        self.v, self.most = v, _largest(v)
        n = len(v)
        self.order = np.arange(n)
        low, high, radius, first, count = [], [], [], [], []
        # beyond this, squares overflow: nothing can be told by a bound
        huge = self.most >= 1 << 500
        if huge:
            far = np.full((n, n), np.inf)
        else:
            x = v.astype(float)
            size = (x * x).sum(axis=1)
            far = np.sqrt(np.maximum(size[:, None] + size[None, :] - 2 * (x @ x.T), 0))
        np.fill_diagonal(far, 0)
        open_ = [(0, n)] if n else []
        at = 0
        while at < len(open_):
            a, b = open_[at]
            mine = self.order[a:b]
            reach = float(far[mine[0], mine].max())
            low.append(a), high.append(b), radius.append(reach), first.append(len(open_)), count.append(0)
            at += 1
            if b - a <= (1 if single else leaf) or not (single or 0 < reach < np.inf):
                continue
            groups, rest = [], mine
            if 0 < reach < np.inf:
                while len(rest):
                    near = far[rest[0], rest] <= reach / 2
                    groups.append(rest[near])
                    rest = rest[~near]
            else:
                groups = list(mine[:, None])
            self.order[a:b] = np.concatenate(groups)
            ends = a + np.cumsum([0, *map(len, groups)])
            open_ += list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            count[-1] = len(groups)
        self.low, self.high, self.radius = np.array(low, np.int64), np.array(high, np.int64), np.array(radius)
        self.first, self.count = np.array(first, np.int64), np.array(count, np.int64)

    def centres(self) -> np.ndarray:
        """The centre of every node as doubles, zeros where bounds are of no use."""
        x = self.v[self.order[self.low]]
        return np.zeros(x.shape) if self.most >= 1 << 500 else x.astype(float)


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the owner and place within it, for count[i] places of every i."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows: int64, or Python integers where they need more."""
    most = max(_largest(a), _largest(b))
    if a.dtype == object or b.dtype == object or most >= 1 << 27:
        d = a.astype(object) - b.astype(object)
        return (d * d).sum(axis=1)
    kind = float if most < 1 << 22 else np.int64
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), PAIRS):
        d = a[i : i + PAIRS].astype(kind) - b[i : i + PAIRS].astype(kind)
        out[i : i + PAIRS] = np.einsum("ij,ij->i", d, d)
    return out


def _closest(points: np.ndarray, centroids: np.ndarray, point: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points compared and the nearest centroid of each, ties to the smaller number; pairs come sorted by point."""
    if not len(point):
        return point, centroid
    edge = np.flatnonzero(np.append(True, point[1:] != point[:-1]))
    kept, label = point[edge], np.empty(len(edge), np.int64)
    i = 0
    bounds = np.append(edge, len(point))
    while i < len(edge):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PAIRS, "right")) - 1)
        a, b = bounds[i], bounds[j]
        d, c, heads = squared(points[point[a:b]], centroids[centroid[a:b]]), centroid[a:b], edge[i:j] - a
        least = np.minimum.reduceat(d, heads)
        tied = d == np.repeat(least, np.diff(np.append(heads, b - a)))
        label[i:j] = np.minimum.reduceat(np.where(tied, c, len(centroids)), heads)
        i = j
    return kept, label


def assign(tree: CoverTree, centroids: np.ndarray, over: CoverTree) -> np.ndarray:
    """The nearest centroid of every vector of a tree, by a walk of both trees; over: the tree of the centroids."""
    label = np.zeros(len(tree.v), np.int64)
    if len(centroids) == 1:
        return label
    x, y = tree.centres(), over.centres()
    slack = 1e-6 * (1 + np.sqrt((x * x).sum(axis=1).max()) + np.sqrt((y * y).sum(axis=1).max()))
    name = over.order[over.low]  # of the centroid of a leaf
    vn, cn = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(vn):
        d = np.empty(len(vn))
        for i in range(0, len(vn), PAIRS):
            step = x[vn[i : i + PAIRS]] - y[cn[i : i + PAIRS]]
            d[i : i + PAIRS] = np.sqrt(np.einsum("ij,ij->i", step, step))
        reach = tree.radius[vn] + over.radius[cn] + slack
        heads = np.flatnonzero(np.append(True, vn[1:] != vn[:-1]))
        best = np.repeat(np.minimum.reduceat(d + reach, heads), np.diff(np.append(heads, len(vn))))
        near = ~(d - reach > best)  # an endless radius says nothing
        vn, cn = vn[near], cn[near]
        heads = np.flatnonzero(np.append(True, vn[1:] != vn[:-1]))
        size = np.diff(np.append(heads, len(vn)))
        single = over.count[cn] == 0
        # one centroid left: all points of the node have it
        sure = heads[(size == 1) & single[heads]]
        owner, place = _spread(tree.high[vn[sure]] - tree.low[vn[sure]])
        label[tree.order[tree.low[vn[sure]][owner] + place]] = name[cn[sure]][owner]
        # leaves of both: compared exactly
        done = np.repeat(np.logical_and.reduceat(single, heads), size) & (tree.count[vn] == 0)
        gone = done.copy()
        gone[sure] = True
        exact = np.flatnonzero(done & ~np.isin(np.arange(len(vn)), sure))
        if len(exact):
            owner, place = _spread(tree.high[vn[exact]] - tree.low[vn[exact]])
            point, centroid = tree.order[tree.low[vn[exact]][owner] + place], name[cn[exact]][owner]
            by = np.lexsort((centroid, point))
            point, centroid = _closest(tree.v, centroids, point[by], centroid[by])
            label[point] = centroid
        vn, cn = vn[~gone], cn[~gone]
        # both go down at once; a leaf waits for the other tree
        down = np.maximum(tree.count[vn], 1)
        across = np.maximum(over.count[cn], 1)
        owner, place = _spread(down * across)
        v, c = vn[owner], cn[owner]
        vn = np.where(tree.count[v] > 0, tree.first[v] + place // across[owner], v)
        cn = np.where(over.count[c] > 0, over.first[c] + place % across[owner], c)
        by = np.lexsort((cn, vn))
        vn, cn = vn[by], cn[by]
    return label


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH):
            part = batch.slice(i, BATCH)
            v = whole(part.column("e").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), SCALE)
            if v.dtype != object:
                v = v.astype(next(t for t in (np.int16, np.int32, np.int64) if _largest(v) <= np.iinfo(t).max))
            tree = pickle.dumps((part.column("vec_id").to_numpy(), CoverTree(v)))
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.binary())], names=["tree"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, CoverTree]]:
    for batch in batches:
        for row in batch.column("tree"):
            yield pickle.loads(row.as_py())


def _summed(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = CoverTree(centroids, single=True)
        total, count = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for _, tree in _trees(batches):
            label = assign(tree, centroids, over)
            for c in np.unique(label).tolist():
                own = tree.v[label == c]
                total[c] += (own if own.dtype == object else own.astype(np.int64)).sum(axis=0).astype(object)
                count[c] += len(own)
        rows = [(c, -1, 0, int(n)) for c, n in enumerate(count.tolist()) if n]
        for (c, j), x in np.ndenumerate(total):
            sign, x, limb = (-1 if x < 0 else 1), abs(int(x)), 0
            while x:
                rows.append((c, j, limb, sign * (x & ((1 << LIMB) - 1))))
                x, limb = x >> LIMB, limb + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["c", "j", "limb", "x"])

    return run


def _told(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = CoverTree(centroids, single=True)
        for ids, tree in _trees(batches):
            label = assign(tree, centroids, over)
            d = squared(tree.v, centroids[label])
            d = d if d.dtype == np.int64 else np.array([min(x, HIGH) for x in d], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(label, pa.int32()), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return run


def moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    """The floor of each cluster's mean; a cluster without vectors stays. sums: rows (c, j, limb, x), j -1 for counts."""
    count, total = [0] * len(centroids), np.zeros(centroids.shape, object)
    for c, j, limb, x in sums:
        if j < 0:
            count[c] = int(x)
        else:
            total[c, j] += int(x) << LIMB * limb
    new = np.array([[x // n for x in row] if n else [int(x) for x in old] for row, n, old in zip(total, count, centroids, strict=True)], object)
    return new.astype(np.int64) if _largest(new) < 1 << 62 else new


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for every vector kept.

    Kept are rows with an id and exactly ``dim`` components, none null or non-finite;
    components become floor(256 * x). Rows are vectors each, equal ones and equal ids
    too. The first centroids are the k vectors with the smallest sha256 of
    "seed:vec_id", equal hashes in the order of their components; fewer vectors give
    fewer centroids. Distances are exact; those and inertias beyond the range of long
    count as its end. Equal distances go to the smaller number. Other columns are
    ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(f"vec_id is not null and size(e) = {dim}").where(F.coalesce(fine, F.lit(False)))
    seeds = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "e").orderBy("hash", "e").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not seeds:
        return spark.createDataFrame([], schema)
    now = whole(np.array([r["e"] for r in seeds]), SCALE)
    trees = cut(rows.mapInArrow(_planted, "tree binary"))
    for _ in range(rounds):
        sums = trees.mapInArrow(_summed(now), "c int, j int, limb int, x long").groupBy("c", "j", "limb").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        now = moved(now, sums.collect())
    told = cut(trees.mapInArrow(_told(now), "vec_id long, cluster int, distance long"))
    spread = dict(told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    inertia = sum(map(int, spread.values()))
    named = [(c, min(int(x), HIGH), hashlib.sha256(",".join(str(int(z)) for z in now[c]).encode()).hexdigest()) for c, x in spread.items()]
    # one row a cluster, at most k
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, centroid_sha256 string")
    return told.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(min(inertia, HIGH)).cast("long").alias("inertia"), "centroid_sha256")


def _oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, seed: str = SEED) -> str:
    nearest = "SELECT row, arg_min(c, [d, c]) AS c, min(d) AS d FROM (SELECT row, c, list_sum(list_transform(list_zip(v.e, m.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i} m) GROUP BY row"
    mean = "SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS e FROM (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM a{i} JOIN v USING (row)) GROUP BY c, j) GROUP BY c"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) - 1 AS c, e FROM v) WHERE c < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(i=i)})")
        if i < rounds:
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.e, o.e) AS e FROM c{i} o LEFT JOIN ({mean.format(i=i)}) m USING (c))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (row) JOIN c{rounds} m USING (c)"""


ORACLE = _oracle()
