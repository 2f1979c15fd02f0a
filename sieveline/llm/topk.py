"""Exact top-k by inner product: a ball tree per shard, branch and bound.

Vectors are dealt to shards by the upper levels of a ball tree, fit on a bounded
sample, and a crowded cell is dealt on to several shards. Each shard's tree is built
once and written; its root ball goes to a table of roots. A node is a ball, and a
query's inner product with anything in it is at most its product with the centre plus
its norm times the radius.

Queries are routed by the bounds of the roots: first to the shard of the highest
bound, then to the next few, then to all others whose bound still reaches the query's
kth score. After every batch of shards the kth score is shared: it is what the next
batch is routed by and what its searches start from. In a shard, nodes are visited in
the order of their bounds and the search ends at the first below the current kth
score. A bound equal to it is still visited, since a tie can go to a smaller id.

Bounds are floating-point with a margin that grows with the norms; scores are
integers: products and sums below 2**53 are taken in floating point, where they are
exact, below 2**63 in 64-bit integers, and above that in Python's.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare
from .training import fit_in_task

SCALE, TOP, EVERY = 1024, 10, 100
SHARD, BLOCK, LEAF = 8192, 512, 64
#: Vectors that the upper levels are fit on, vectors of it a cell, roots a block of their table, shards a batch.
SAMPLE, CELL, ROOTS, BATCHES = 1 << 14, 32, 4096, (1, 8, None)
#: Rows of a table of shards that may be broadcast (three integers each).
SHARDS = 100_000
LOW, HIGH = -(1 << 63), (1 << 63) - 1
KEY = ["dim", "cell", "part"]


def whole(e: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * e) of finite doubles: int64, or Python integers where some component needs more."""
    with np.errstate(over="ignore"):
        v = np.floor(e * float(scale))
    if not v.size or np.abs(v).max() < 2.0**62:
        return v.astype(np.int64)
    exact = [int(f) if math.isfinite(f) else int(c) * scale for c, f in zip(e.ravel().tolist(), v.ravel().tolist(), strict=True)]
    return np.array(exact, object).reshape(e.shape)


def _largest(v: np.ndarray) -> int:
    return max(abs(int(v.max())), abs(int(v.min()))) if v.size else 0


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows x with q, Python integers beyond the range of long count as its ends."""
    if x.dtype != object:
        return (x @ q).astype(np.int64)
    return np.array([min(max(s, LOW), HIGH) for s in x @ q], np.int64)


def _far_pair(points: np.ndarray) -> np.ndarray:
    """Direction between two points far apart."""
    centre = points.mean(axis=0)
    pole = points[((points - centre) ** 2).sum(axis=1).argmax()]
    return points[((points - pole) ** 2).sum(axis=1).argmax()] - pole


class BallTree:
    """Nodes in arrays; leaves own a slice of the vectors. Halves by rank along the direction of two far points."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(v))
        self.span, self.children = [], []
        centre, radius = [], []
        # beyond this, squares overflow: one leaf that is always visited
        self.most = _largest(v)
        huge = self.most > 10**100
        x = np.zeros((len(v), v.shape[1])) if huge else v.astype(float)
        stack = [(0, len(x), -1)]
        while stack:
            a, b, parent = stack.pop()
            mine, node = order[a:b], len(centre)
            points = x[mine]
            middle = points.mean(axis=0)
            reach = float(np.sqrt(((points - middle) ** 2).sum(axis=1)).max())
            centre.append(middle), radius.append(reach), self.span.append((a, b)), self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if b - a > leaf and reach > 0:
                half = np.argsort(points @ _far_pair(points), kind="stable")
                order[a:b] = mine[half]
                stack += [(a, (a + b) // 2, node), ((a + b) // 2, b, node)]
        self.centre, self.radius = np.array(centre), np.full(len(radius), np.inf) if huge else np.array(radius)
        self.v, self.ids = v[order], ids[order]

    def exact(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors and q in the cheapest type in which their products are exact."""
        most = float(np.abs(q.astype(float)).sum()) * self.most if max(self.most, _largest(q)) < 1 << 62 else math.inf
        kind = float if most < 2.0**52 else np.int64 if most < 2.0**62 else object
        if kind is not float:
            return self.v.astype(kind, copy=False), q.astype(kind)
        if not hasattr(self, "x"):
            self.x = self.v.astype(float)
        return self.x, q.astype(float)

    def search(self, q: np.ndarray, bounds: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The best k (score, id), ties to smaller ids, of candidates that may reach ``floor``; own: the id to leave out."""
        x, q = self.exact(q)
        best: list[tuple[int, int]] = []  # a heap of (score, -id): its least is the current kth
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if floor is not None and -bound < floor:
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            a, b = self.span[node]
            scores, names = products(x[a:b], q), self.ids[a:b]
            keep = names != own if floor is None else (names != own) & (scores >= floor)
            for s, i in zip(scores[keep].tolist(), names[keep].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                floor = best[0][0] if floor is None else max(floor, best[0][0])
        return [(s, -i) for s, i in best]


def upper_bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bound of every ball for every query, loose by far more than rounding can be off."""
    if _largest(q) > 10**100 or not np.isfinite(radius).all():
        return np.full((len(q), len(radius)), np.inf)
    q = q.astype(float)
    norms = np.sqrt((q * q).sum(axis=1))[:, None]
    slack = 1e-12 * q.shape[1] * norms * (np.sqrt((centre * centre).sum(axis=1)) + radius)[None, :]
    return np.maximum(q @ centre.T + norms * radius[None, :] + slack + 1e-6, float(LOW))


def _cells(table: pa.Table, total: int, shard: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length in the sample: directions and thresholds of the upper levels, a complete binary tree."""
    found = {}
    for dim in sorted(set(table["dim"].to_pylist())):
        rows = [e for e, d in zip(table["e"].to_pylist(), table["dim"].to_pylist(), strict=True) if d == dim]
        x = np.clip(np.array(rows), -1e100, 1e100)
        cells = min(total * len(x) // table.num_rows // shard, len(x) // CELL)
        groups, ways, cuts = [np.arange(len(x))], [], []
        for _ in range(max(cells, 1).bit_length() - 1):
            below = []
            for own in groups:
                way = _far_pair(x[own]) if len(own) else np.zeros(dim)
                size = np.sqrt((way * way).sum())
                way = way / size if size else way
                at = x[own] @ way
                middle = float(np.median(at)) if len(own) else 0.0
                ways.append(way), cuts.append(middle)
                below += [own[at <= middle], own[at > middle]]
            groups = below
        found[dim] = (np.array(ways).reshape(-1, dim), np.array(cuts))
    return found


def _placed(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = np.zeros(len(pdf), np.int32)
            for dim, own in pdf.groupby("dim").indices.items():
                ways, cuts = shared.value.get(dim, (np.zeros((0, dim)), np.zeros(0)))
                if not len(ways):
                    continue
                x = np.clip(np.stack(pdf["e"].to_numpy()[own]), -1e100, 1e100)
                node = np.zeros(len(x), np.int64)
                while node[0] < len(ways):
                    node = 2 * node + 1 + (np.einsum("ij,ij->i", x, ways[node]) > cuts[node])
                cell[own] = node - len(ways)
            yield pdf.assign(cell=cell)

    return run


def _grown(scale: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(whole(np.stack(pdf["e"].to_numpy()), scale), pdf["vec_id"].to_numpy(np.int64))
        return pd.DataFrame([(*pdf[KEY].iloc[0].tolist(), tree.centre[0], tree.radius[0], pickle.dumps(tree))], columns=[*KEY, "centre", "radius", "tree"])

    return run


def _routed(scale: int, batch: int | None):
    """(query, dim, cell, part) that a query's kth score still reaches, the ``batch`` highest bounds of a block of roots."""

    def run(_, queries: pd.DataFrame, roots: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": [], "bound": [], **{c: [] for c in KEY}})
        if not len(queries) or not len(roots):
            return none
        roots = roots.sort_values(KEY)
        bounds = upper_bounds(whole(np.stack(queries["e"].to_numpy()), scale), np.stack(roots["centre"].to_numpy()), roots["radius"].to_numpy(float))
        bounds = np.where(roots["radius"].to_numpy(float)[None, :] == np.inf, np.inf, bounds)
        out = []
        for query, floor, row in zip(queries["query"], queries["floor"].tolist(), bounds, strict=True):
            fit = np.flatnonzero(row >= floor) if floor == floor and floor is not None else np.arange(len(row))
            if batch:
                fit = fit[np.argsort(-row[fit], kind="stable")[:batch]]
            out.append(roots.iloc[fit][KEY].assign(query=query, bound=row[fit]))
        return pd.concat(out)[none.columns]

    return run


def _searched(scale: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree, asked, out = pickle.loads(row["tree"]), row["asked"], []
                q = whole(np.array([a["e"] for a in asked]), scale)
                bounds = upper_bounds(q, tree.centre, tree.radius)
                for a, v, b in zip(asked, q, bounds, strict=True):
                    out += [(a["query"], a["query_id"], i, s) for s, i in tree.search(v, b, a["query_id"], k, a["kth"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["query", "query_id", "vec_id", "score"])

    return run


def _few(df: DataFrame) -> DataFrame:
    """Broadcast if counting says it is small."""
    return F.broadcast(df) if df.count() <= SHARDS else df


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, fewer if there are fewer.

    Components become floor(scale * x); queries are the ids divisible by ``every``.
    Vectors that are null or empty or hold null or non-finite components, and rows
    without id, take no part. A query meets only vectors of its own length. Rows with
    the query's id are its own and not its candidates; all other rows are candidates
    each, equal ones too. Equal query rows ask once; rows of one id with different
    vectors each ask. Scores beyond the range of long count as its ends. Other columns
    are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = cut(raw.where("vec_id is not null and e is not null and size(e) > 0").where(F.coalesce(fine, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), "vec_id", "e", F.size("e").alias("dim")))
    total = clean.count()

    sample = clean.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("dim", "e")
    if total > shard:
        cells = fit_in_task(sample, lambda t: _cells(t, total, shard))
        placed = cut(clean.mapInPandas(_placed(spark.sparkContext.broadcast(cells)), "row long, vec_id long, e array<double>, dim int, cell int"))
        parts = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard).alias("parts"))
        dealt = placed.join(_few(cut(parts, 1)), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), "parts")).select("vec_id", "e", *KEY)
    else:
        dealt = clean.select("vec_id", "e", "dim", F.lit(0).alias("cell"), F.lit(0).cast("long").alias("part"))
    trees = cut(dealt.groupBy(*KEY).applyInPandas(_grown(scale), "dim int, cell int, part long, centre array<double>, radius double, tree binary"))

    asked = clean.where(F.col("vec_id") % every == 0).groupBy("vec_id", "e", "dim").agg(F.min("row").alias("query"))
    asked = cut(asked.select("query", F.col("vec_id").alias("query_id"), "e", "dim"))
    shards, queries = trees.count(), asked.count()
    chunks, groups = max(-(-queries // block), 1), max(-(-shards // ROOTS), 1)
    here = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    roots = trees.select(*KEY, "centre", "radius", F.pmod(F.xxhash64(*KEY), F.lit(groups)).alias("group"), here(chunks).alias("chunk"))
    best = kth = visited = None
    for batch in BATCHES:
        known = asked.join(kth, "query", "left") if kth is not None else asked.withColumn("kth", F.lit(None).cast("long"))
        # a single shard needs no routing
        if shards <= 1:
            routed = asked.select("query", "dim").join(trees.select(*KEY), "dim").select("query", F.lit(0.0).alias("bound"), *KEY)
        open_ = known.select("query", "e", F.col("dim").alias("q_dim"), F.col("kth").cast("double").alias("floor"), F.pmod(F.xxhash64("query"), F.lit(chunks)).alias("q_chunk"), here(groups).alias("q_group"))
        after = batch + sum(b or 0 for b in BATCHES[: BATCHES.index(batch)]) if batch else None
        if shards > 1:
            routed = open_.groupBy("q_dim", "q_group", "q_chunk").cogroup(roots.groupBy("dim", "group", "chunk")).applyInPandas(_routed(scale, after), "query long, bound double, dim int, cell int, part long")
        if visited is not None:
            routed = routed.join(visited, ["query", *KEY], "left_anti")
        if batch:
            order = Window.partitionBy("query").orderBy(F.desc("bound"), *KEY)
            routed = routed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= batch)
        routed = cut(routed.select("query", *KEY))
        counts = routed.groupBy(*KEY).agg(F.ceil(F.count("*") / block).alias("chunks"))
        chunked = routed.join(_few(cut(counts, 1)), KEY).join(known.select("query", "query_id", "e", "kth"), "query")
        chunked = chunked.groupBy(*KEY, F.pmod(F.xxhash64("query"), "chunks").alias("chunk")).agg(F.collect_list(F.struct("query", "query_id", "e", "kth")).alias("asked"))
        found = chunked.join(trees.select(*KEY, "tree"), KEY).select("tree", "asked").mapInArrow(_searched(scale, k), "query long, query_id long, vec_id long, score long")
        found = found if best is None else best.drop("rank").unionByName(found)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        best = cut(found.withColumn("rank", rank).where(F.col("rank") <= k))
        if after is None or shards <= after:
            break
        kth = best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).select("query", "kth")
        visited = routed if visited is None else visited.union(routed)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), asked AS (SELECT DISTINCT vec_id, v FROM clean WHERE vec_id % 100 = 0
), flat AS (
  SELECT q.vec_id AS query_id, q.v AS q, c.vec_id AS vec_id, c.row AS row, unnest(q.v) * unnest(c.v) AS part
  FROM asked q JOIN (SELECT *, row_number() OVER () AS row FROM clean) c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), scored AS (SELECT query_id, q, vec_id, sum(part)::BIGINT AS score FROM flat GROUP BY query_id, q, vec_id, row)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""
