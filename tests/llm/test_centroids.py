"""Centroid clustering against Lloyd's rounds in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from sieveline.llm import centroids
from sieveline.llm.topk import whole

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance double, tree string"


def lloyd(rows, k, rounds, dim):
    """(vec_id, cluster, distance) and the final centroids of rows (vec_id, vector)."""
    kept = [(i, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in e]) for i, e in rows if i is not None and e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    now = [v for _, _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v, v) for i, v in kept)][:k]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(now))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, own, strict=True) if o == n] for n in range(len(now))]
        now = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else c for g, c in zip(groups, now, strict=True)]
    return [(i, near(v)[1], min(near(v)[0], centroids.HIGH)) for i, v in kept], now


def check(spark, rows, k, rounds=3, dim=3):
    got = centroids.cluster(spark.createDataFrame([(i, e, "x", 0.5, None) for i, e in rows], SCHEMA), k=k, rounds=rounds, dim=dim).collect()
    want, final = lloyd(rows, k, rounds, dim)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    for r in got:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, final[r.cluster])).encode()).hexdigest()
        assert r.cluster_inertia == min(sum(d for _, c, d in want if c == r.cluster), centroids.HIGH)
        assert r.inertia == min(sum(d for _, _, d in want), centroids.HIGH)
    return got


def test_rows_left_out_repeats_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0, 1.0, 1.0]), (1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [1.0, nan, 2.0]), (6, [inf, 1.0, 1.0]), (7, [-inf, 1.0, 1.0]), (8, [1.0] * 4)]
    rows = [(10, [0.0, 0.0, 0.0]), (10, [0.0, 0.0, 0.0]), (10, [1.0, 1.0, 1.0]), (11, [2.0, 0.0, 0.0]), (12, [-2.0, 0.0, 0.0]), (13, [0.001, -0.001, 0.0]), (14, [1.0, 0.0, 0.0]), (15, [-1.0, 0.0, 0.0])]
    assert len(check(spark, odd + rows, k=3)) == len(rows)
    # more centroids than vectors, equal centroids among them
    check(spark, rows, k=40)
    check(spark, [(i, [1.0, 1.0, 1.0]) for i in range(20)], k=4)
    assert centroids.cluster(spark.createDataFrame(odd, "vec_id long, embedding array<double>"), dim=3).count() == 0
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("size", [1.0, 1e4, 1e6, 1e12, 1e100, 1e200, 1e304])
def test_sizes_of_components(spark, size):
    rng = np.random.default_rng(3)
    check(spark, [(i, (rng.standard_normal(3) * size).tolist()) for i in range(60)], k=5)


def test_many_batches_of_close_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    middle = rng.standard_normal((12, 3)) * 10
    rows = [(i, (middle[i % 12] + rng.standard_normal(3) * (0.05 if i % 3 else 0)).tolist()) for i in range(2500)]
    check(spark, rows, k=9)


def test_walk_finds_the_nearest_and_prunes(monkeypatch):
    rng = np.random.default_rng(7)
    middle = rng.integers(-5000, 5000, (10, 16))
    v = np.concatenate([middle[i] + rng.integers(-20, 20, (150, 16)) for i in range(10)])
    c = np.concatenate([middle, middle[:2]])
    compared = []
    real = centroids.squared
    monkeypatch.setattr(centroids, "squared", lambda a, b: compared.append(len(a)) or real(a, b))
    label = centroids.assign(centroids.CoverTree(v), c, centroids.CoverTree(c, single=True))
    assert (label == ((v[:, None, :] - c[None]) ** 2).sum(-1).argmin(1)).all()
    assert sum(compared) < len(v) * len(c) // 10


def test_cover_tree_nests_covers_and_separates():
    v = np.random.default_rng(9).integers(-99, 99, (300, 4))
    tree = centroids.CoverTree(v, leaf=1)
    assert sorted(tree.order) == list(range(300))
    far = lambda a, b: np.sqrt(((v[a] - v[b]) ** 2).sum(-1))
    for node, (a, b) in enumerate(zip(tree.low, tree.high, strict=True)):
        own = tree.order[a:b]
        assert far(own[0], own).max() <= tree.radius[node] + 1e-9
        kids = range(tree.first[node], tree.first[node] + tree.count[node])
        heads = [tree.order[tree.low[k]] for k in kids]
        assert not heads or heads[0] == own[0]
        assert all(tree.radius[k] <= tree.radius[node] / 2 + 1e-9 for k in kids)
        assert all(far(x, y) > tree.radius[node] / 2 for i, x in enumerate(heads) for y in heads[:i])


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    kept = rows.collect()
    v = whole(np.array([r.embedding for r in kept], float), 256)
    by = sorted(range(len(v)), key=lambda i: hashlib.sha256(f"2:{kept[i].vec_id}".encode()).hexdigest())[:40]
    now = v[by]
    for _ in range(5):
        label = ((v[:, None] - now[None]) ** 2).sum(-1).argmin(1)
        now = np.array([v[label == c].sum(0) // (label == c).sum() if (label == c).any() else now[c] for c in range(40)])
    d = ((v[:, None] - now[None]) ** 2).sum(-1)
    got = {r.vec_id: (r.cluster, r.distance) for r in centroids.cluster(rows).collect()}
    assert got == {r.vec_id: (int(x.argmin()), int(x.min())) for r, x in zip(kept, d, strict=True)}
