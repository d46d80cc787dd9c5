"""Approximate nearest neighbours: stable projections in kd-trees, verified until a chi-square test says stop."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells
from .common import cut

#: Dimensions of the projection (even, so that the chi-square distribution has a closed form).
PROJECTED = 24
#: The search for a query stops where a still unseen nearer neighbour would be projected as far away as the next
#: candidate with a probability under 1 - CERTAIN.
CERTAIN = 0.95
LEAF = 64


def projection(d: int, seed: int = 0) -> np.ndarray:
    """Normal (2-stable) weights: a projected squared distance is the squared distance times a chi-square of PROJECTED."""
    return np.random.default_rng(seed).standard_normal((d, PROJECTED))


def chi_square_cdf(x: np.ndarray, m: int = PROJECTED) -> np.ndarray:
    half = np.minimum(x / 2, 700.0)
    term = total = np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def test(projected2: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Whether candidates at this projected squared distance may still hold one nearer than `bound`."""
    with np.errstate(divide="ignore", invalid="ignore"):
        x = projected2 / bound**2
    return (projected2 <= 0) | np.isinf(bound) | ((chi_square_cdf(np.nan_to_num(x, posinf=1e9)) < CERTAIN) & (bound > 0))


class TreeSearch:
    """Of one run: a kd-tree over projections with leaves of LEAF rows, visited by increasing projected distance; in a leaf, the rows
    that pass the test are verified. `verified` counts them."""

    largest, exact = False, ""

    def __init__(self, weights: np.ndarray):
        self.weights, self.verified = weights, 0

    def prepare(self, ids, v):
        y = v @ self.weights
        leaves, todo = [], [np.arange(len(v))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            dim = int(np.argmax(np.ptp(y[rows], axis=0)))
            rows = rows[np.argpartition(y[rows, dim], len(rows) // 2)]
            todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
        low, high = (np.array([f(y[r], axis=0) for r in leaves]) for f in (np.min, np.max))
        return ids, v, y, leaves, low, high

    def __call__(self, state, q_rows, query_ids, q, bounds, k):
        ids, v, y, leaves, low, high = state
        asked = q @ self.weights
        away = np.zeros((len(q), len(leaves)))
        for d in range(asked.shape[1]):
            away += np.maximum(0, np.maximum(low[:, d] - asked[:, d : d + 1], asked[:, d : d + 1] - high[:, d])) ** 2
        order = away.argsort(1)
        out = ([], [], [])
        for i in range(len(q)):
            bound, have, dist = bounds[i], np.empty(0, np.int64), np.empty(0)
            at, step = 0, 2
            while at < len(leaves):
                some = order[i, at : at + step]
                some = some[test(away[i, some], np.full(len(some), bound))]
                if not len(some):
                    break
                rows = np.concatenate([leaves[x] for x in some])
                rows = rows[ids[rows] != query_ids[i]]
                rows = rows[test(((y[rows] - asked[i]) ** 2).sum(1), np.full(len(rows), bound))]
                self.verified += len(rows)
                d = np.sqrt(((v[rows] - q[i]) ** 2).sum(1))
                have, dist = np.concatenate([have, ids[rows]]), np.concatenate([dist, d])
                keep = np.lexsort((have, dist))[:k]
                have, dist = have[keep], dist[keep]
                if len(dist) == k:
                    bound = min(bound, dist[-1])
                at, step = at + step, min(2 * step, 32)
            out[0].append(np.full(len(have), q_rows[i]))
            out[1].append(have)
            out[2].append(dist)
        return tuple(np.concatenate([*x, np.empty(0)]) for x in out)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the k nearest rows of `vectors` found, by Euclidean distance;
    all but the row of the query's own id are candidates.

    Vectors are projected to PROJECTED dimensions and dealt to kd-cells (one for 4096 rows, 2048 at most, fitted on a sample of 20,000 rows), in
    runs of bounded size; all rows are indexed. A query first searches one run of its cell, then the runs of all cells that pass the
    chi-square test at the distance found. In a run, leaves are visited by increasing projected distance until the test fails, and
    of a leaf's rows those that pass it are verified. Scores are exact distances of the vectors given; ties go to smaller ids.

    Null, zero and non-finite vectors, those of a rarer length and rows without id take no part; a table without usable
    vectors gives no rows. Each row of `queries` gets a list of its own, so an id that two different query rows have appears
    with two lists; equal query rows are one. Each row of `vectors` is a candidate, also one that repeats another. Copies of one
    vector are at projected distance 0 and are all looked at. Other columns play no part.
    """
    rows = cut(cells.usable(vectors, vec_id, vector, allow_zero=False))
    asked = cells.usable(queries, vec_id, vector, allow_zero=False).distinct()
    d, n = cells.common_length(rows), rows.count()
    rows, asked = rows.filter(F.size("v") == d), asked.filter(F.size("v") == d)
    weights = projection(d)
    features = lambda v: v @ weights
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    splits = cells.fit(rows, features, n)
    reach = lambda data: lambda v, bound: test(splits.distance2(features(v)), bound[:, None])
    return cells.two_rounds(rows, asked, features, splits, TreeSearch(weights), k, d, reach).select("query_id", "rank", "vec_id", "score")


def op1_stable_projection_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest found of the rows whose vec_id is divisible by 100, among all embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0), 10)
