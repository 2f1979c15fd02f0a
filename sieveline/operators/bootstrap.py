"""Paired stratified bootstrap of mean deltas: NumPy's generator for parity, and hashes for a fully native form."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import ship, written

DRAWS, SEED = 10_000, 20260804
#: Picks that a task makes at a time.
CHUNK = 1 << 20
#: Draws of a comparison between two snapshots of its generator.
STEP = 500


def _picks(rng: np.random.Generator, sizes: np.ndarray, draws: int) -> Iterator[np.ndarray]:
    """The picks of many draws at a time, a row a draw.

    A call with an array of bounds takes the same picks from the generator's stream as
    single choices one after the other.
    """
    bounds = np.repeat(sizes, sizes)
    step = max(1, CHUNK // max(len(bounds), 1))
    for at in range(0, draws, step):
        yield rng.integers(0, np.broadcast_to(bounds, (min(step, draws - at), len(bounds))))


def _drawn(rng: np.random.Generator, own: list[np.ndarray], draws: int) -> np.ndarray:
    """Mean of each draw of the values of the strata."""
    sizes = np.array([len(x) for x in own])
    edges, out = np.concatenate([[0], np.cumsum(sizes)]), [np.zeros(0)]
    for picks in _picks(rng, sizes, draws):
        total = np.zeros(len(picks))
        for values, a, b in zip(own, edges[:-1], edges[1:], strict=True):
            total += values[picks[:, a:b]].sum(axis=1)
        out.append(total / edges[-1])
    return np.concatenate(out)


def resampled_means(delta: np.ndarray, strata: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Mean of each draw. One generator picks draw by draw, and in a draw stratum by stratum in order of first appearance."""
    return _drawn(np.random.default_rng(seed), [delta[strata == name] for name in dict.fromkeys(strata.tolist())], draws)


def generator_states(shapes: DataFrame, draws: int, seed: int, step: int = STEP) -> DataFrame:
    """sizes, at, n, state: where the generator stands before every ``step`` draws of strata of these sizes.

    How many numbers a draw takes depends on the numbers, so the stream is walked once for
    each shape, without looking at a value; all comparisons of one shape share the walk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sizes in pdf["sizes"]:
                rng = np.random.default_rng(seed)
                rows = []
                for at in range(0, draws, step):
                    n = min(step, draws - at)
                    rows.append((sizes, at, n, json.dumps(rng.bit_generator.state)))
                    for _ in _picks(rng, np.asarray(sizes, np.int64), n if at + n < draws else 0):
                        pass
                yield pd.DataFrame(rows, columns=["sizes", "at", "n", "state"])

    return shapes.select("sizes").distinct().mapInPandas(run, "sizes array<long>, at long, n long, state string")


def _draw_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The means of the draws of each row (treatment, metric, delta, sizes, values, at, n, state)."""
    for pdf in batches:
        rng, means = np.random.default_rng(), []
        for r in pdf.itertuples():
            rng.bit_generator.state = json.loads(r.state)
            means.append(_drawn(rng, np.split(np.asarray(r.values), np.cumsum(r.sizes)[:-1].astype(int)), r.n))
        yield pdf[["treatment", "metric", "delta"]].assign(means=means)


def bootstrap(deltas: DataFrame, draws: int = DRAWS, seed: int = SEED, baseline: str = "bm25", step: int = STEP) -> DataFrame:
    """baseline, treatment, metric, delta, ci_low, ci_high, probability_positive, bootstrap_samples, seed, stratified_by.

    deltas is (treatment, metric, qid, template, delta). A comparison is one row: its size
    is the number of queries, which is small beside the corpus. Its draws are made by
    several tasks, each of which goes on from where one generator would stand there, so
    the numbers are those of a single generator. ``step``: draws a task makes at a time;
    a comparison's means, one number a draw, come together for its quantiles.
    """
    if draws <= 0 or step <= 0:
        raise ValueError("draws and step must be positive")
    ship(deltas.sparkSession)
    keys = ["treatment", "metric"]
    held = deltas.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("qid").cast("long").alias("n"), "template", "delta"))).alias("x"), F.avg("delta").alias("delta"))
    # strata in order of first appearance, and the values of each one together
    strata = held.withColumn("own", F.transform(F.array_distinct("x.template"), lambda t: F.filter("x", lambda r: r["template"].eqNullSafe(t))))
    rows = written(strata.select(*keys, "delta", F.transform("own", lambda o: F.size(o).cast("long")).alias("sizes"), F.flatten(F.transform("own", lambda o: F.transform(o, lambda r: r["delta"]))).alias("values")), files=1)
    parts = rows.join(generator_states(rows, draws, seed, step), "sizes").select(*keys, "delta", "sizes", "values", "at", "n", "state")
    # a number of partitions, or the few rows would be put together in one task
    parts = parts.repartition(deltas.sparkSession.sparkContext.defaultParallelism, *keys, "at")
    drawn = parts.mapInPandas(_draw_parts, "treatment string, metric string, delta double, means array<double>")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        means = np.concatenate(pdf["means"].to_numpy())
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame([(baseline, *pdf[[*keys, "delta"]].iloc[0], low, high, float((means > 0).mean()), draws, seed, "template")])

    schema = "baseline string, treatment string, metric string, delta double, ci_low double, ci_high double, probability_positive double, bootstrap_samples long, seed long, stratified_by string"
    return drawn.groupBy(*keys).applyInPandas(run, schema)


def model_bootstraps(metrics: DataFrame, pairs: list[tuple[str, str]], names: tuple[str, ...], draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """The bootstraps of each (baseline, treatment) pair of methods."""
    from .metrics import paired_deltas

    out = None
    for baseline, treatment in pairs:
        one = bootstrap(paired_deltas(metrics.where(F.col("method").isin(baseline, treatment)), baseline, names), draws, seed, baseline)
        out = one if out is None else out.unionByName(one)
    return out


def check_intervals(stored: DataFrame, deltas: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """treatment, metric, column of every stored value that a new bootstrap of the deltas does not give."""
    from .report import result_diff

    keys = ["treatment", "metric"]
    values = ["delta", "ci_low", "ci_high", "probability_positive"]
    return result_diff(stored.select(*keys, *values), bootstrap(deltas, draws, seed).select(*keys, *values), keys)


def bootstrap_native(deltas: DataFrame, draws: int = DRAWS) -> DataFrame:
    """The same estimator with picks from md5(draw:stratum:place): DataFrame functions only, checkable in SQL.

    The deltas of a stratum are one array, and the picks of a draw in a stratum are one
    array for all comparisons, so a row is a comparison, a stratum and a draw.
    """
    keys = ["treatment", "metric"]
    size = F.count("*").over(Window.partitionBy(*keys, "template"))
    sized = deltas.withColumn("size", size)
    held = sized.groupBy(*keys, "template", "size").agg(F.array_sort(F.collect_list(F.struct(F.col("qid").cast("long").alias("q"), "delta"))).alias("x")).select(*keys, "template", "size", F.col("x.delta").alias("x"))
    code = lambda place: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("draw").cast("string"), "template", place.cast("string"))), 1, 8), 16, 10).cast("long")
    picks = held.select("template", "size").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = picks.withColumn("picks", F.transform(F.sequence(F.lit(0), (F.col("size") - 1).cast("int")), lambda i: (code(i) % F.col("size")).cast("int")))
    drawn = picks.join(held, ["template", "size"]).select(*keys, "draw", "size", F.aggregate("picks", F.lit(0.0), lambda a, i: a + F.get("x", i)).alias("total"))
    means = drawn.groupBy(*keys, "draw").agg((F.sum("total") / F.sum("size")).alias("mean"))
    out = means.groupBy(*keys).agg(F.percentile("mean", F.lit(0.025)).alias("ci_low"), F.percentile("mean", F.lit(0.975)).alias("ci_high"), F.avg((F.col("mean") > 0).cast("double")).alias("probability_positive"))
    return deltas.groupBy(*keys).agg(F.avg("delta").alias("delta")).join(out, keys)
