"""Exact top-k by inner product: segment means and deviations bound what a row can score, coarse to fine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells
from .common import cut

#: Numbers of segments, coarse to fine.
LEVELS = (4, 8, 16, 32)


def segments(v: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """sqrt(length) times the mean and the deviation of each of about `parts` segments: inner products of these bound those
    of the vectors, as x.y = L mx my + (x - mx).(y - my) <= L mx my + L sx sy in each segment."""
    d = v.shape[1]
    edges = np.unique(np.linspace(0, d, min(parts, d) + 1).astype(int))[:-1]
    length = np.diff(np.append(edges, d))
    mean = np.add.reduceat(v, edges, axis=1) / length
    square = np.add.reduceat(v**2, edges, axis=1)
    dev = np.sqrt(np.maximum(0, square - length * mean**2))
    return mean * np.sqrt(length), dev


def slack(upper: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A bound with room for rounding, which grows with the product of the vectors' lengths; scores themselves are exact."""
    return upper + 1e-12 * sizes + 0.25


def lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v**2).sum(1))


class BoundSearch:
    """Of one run: rows whose upper bound is under the k-th score so far are left out, at finer and finer levels.

    Survivors' scores are sums of integers: in double precision where `most` (the largest component) keeps them under 2^53, in 64
    bits under 2^63, and beyond in Python's integers, which travel as binary numbers of `width` bytes that sort like them.
    """

    largest = True

    def __init__(self, most: float, d: int):
        reach = int(most) ** 2 * max(1, d)
        self.kind = "double" if reach < 2**53 else "long" if reach < 2**63 else "any"
        self.exact, self.width = ("binary", reach.bit_length() // 8 + 2) if self.kind == "any" else ("long", 0)

    def prepare(self, ids, v):
        return ids, v, [segments(v, p) for p in LEVELS], lengths(v)

    def products(self, v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, list]:
        """(as double, exactly)"""
        if self.kind == "double":
            score = v @ q
            return score, score.astype(np.int64)
        if self.kind == "long":
            whole = (v.astype(np.int64) * q.astype(np.int64)).sum(1)
            return whole.astype(np.float64), whole
        ints = [int(x) for x in q]
        out = [sum(a * int(b) for a, b in zip(ints, row)) for row in v.tolist()]
        near = [float(x) if abs(x) < 1 << 1023 else float("inf") * (1 if x > 0 else -1) for x in out]
        return np.array(near), np.array(out, object)

    def __call__(self, state, q_rows, query_ids, q, bounds, k):
        ids, v, levels, size = state
        asked, own = [segments(q, p) for p in LEVELS], lengths(q)
        top = asked[0][0] @ levels[0][0].T + asked[0][1] @ levels[0][1].T
        out = ([], [], [], [])
        for i in range(len(q)):
            room = own[i] * size
            upper = slack(top[i], room)
            first = np.argpartition(-upper, min(4 * k, len(ids) - 1))[: 4 * k]  # the most promising raise the limit
            first = first[ids[first] != query_ids[i]]
            score = self.products(v[first], q[i])[0]
            limit = max(bounds[i], np.sort(score)[-k]) if len(score) >= k else bounds[i]
            rows = np.flatnonzero(~(upper < limit) & (ids != query_ids[i]))
            for (mean, dev), (qm, qs) in zip(levels[1:], asked[1:]):
                rows = rows[~(slack(mean[rows] @ qm[i] + dev[rows] @ qs[i], room[rows]) < limit)]
            score, exact = self.products(v[rows], q[i])
            keep = self._first(ids[rows], exact, k)
            out[0].append(np.full(len(keep), q_rows[i]))
            out[1].append(ids[rows][keep])
            out[2].append(score[keep])
            out[3].extend(exact[keep].tolist() if self.kind != "any" else [(x + (1 << 8 * self.width - 1)).to_bytes(self.width, "big") for x in exact[keep]])
        return (*(np.concatenate([*x, np.empty(0)]) for x in out[:3]), out[3])

    def _first(self, ids, exact, k):
        if self.kind == "any":
            return np.array(sorted(range(len(ids)), key=lambda j: (-exact[j], ids[j]))[:k], np.int64)
        return np.lexsort((ids, -exact))[:k]

    def numbers(self, found: DataFrame) -> DataFrame:
        """`exact` as `score`, a long; a product beyond 64 bits becomes the largest or smallest long, at the rank it has."""
        if self.kind != "any":
            return found.select("query_id", "rank", "vec_id", F.col("exact").alias("score"))
        zero, edge = 1 << 8 * self.width - 1, 2**63

        def run(batches):
            for b in batches:
                score = [min(max(int.from_bytes(x, "big") - zero, -edge), edge - 1) for x in b.column("exact").to_pylist()]
                yield cells.batch({**{c: b.column(c) for c in ("query_id", "rank", "vec_id")}, "score": cells.pa.array(score, cells.pa.int64())})

        return found.select("query_id", "rank", "vec_id", "exact").mapInArrow(run, cells.schema("query_id long, rank int, vec_id long, score long"))


def _reach(splits, features):
    """Cells by the bounds of their rows: per cell and coarse segment the range of means and the largest deviation, at most
    MOST_CELLS rows of numbers, gathered from all data."""

    def of(data: DataFrame):
        d = len(data.select("v").first()[0])
        width = segments(np.zeros((1, d)), LEVELS[0])[0].shape[1]

        def shape(batches):
            for b in batches:
                v = cells.matrix(b.column("v"))
                both = np.concatenate([*segments(v, LEVELS[0]), lengths(v)[:, None]], 1)
                at = np.arange(len(both) + 1, dtype=np.int32) * (2 * width + 1)
                yield cells.pa.RecordBatch.from_arrays([b.column("cell"), cells.pa.ListArray.from_arrays(at, both.ravel())], names=["cell", "s"])

        s = data.select("cell", "v").mapInArrow(shape, cells.schema("cell long, s array<double>"))
        sides = [F.min(F.col("s")[j]).alias(f"l{j}") for j in range(width)] + [F.max(F.col("s")[j]).alias(f"h{j}") for j in range(2 * width + 1)]
        low, high, dev = (np.zeros((len(splits.low), width)) for _ in range(3))
        size = np.zeros(len(splits.low))
        for r in s.groupBy("cell").agg(*sides).collect():
            low[r["cell"]], high[r["cell"]], dev[r["cell"]] = [r[f"l{j}"] for j in range(width)], [r[f"h{j}"] for j in range(width)], [r[f"h{j}"] for j in range(width, 2 * width)]
            size[r["cell"]] = r[f"h{2 * width}"]

        def test(v, bound):
            qm, qs = segments(v, LEVELS[0])
            upper = np.maximum(qm, 0) @ high.T + np.minimum(qm, 0) @ low.T + qs @ dev.T
            return ~(slack(upper, lengths(v)[:, None] * size) < bound[:, None])

        return test

    return of


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the k rows of `vectors` with the highest inner product of
    floor(scale * x) vectors, exactly; all but the row of the query's own id are candidates, ties go to smaller ids.

    Rows are dealt to kd-cells over coarse segment means (one for 4096 rows, 2048 at most, fitted on a sample of 20,000 rows; any
    splits give the same result). A query gets a limit from one run of its cell, goes to the runs of all cells whose bound reaches it, and
    there only survivors of all levels are scored, in integers however large they are. A score beyond 64 bits is given as the
    largest or smallest long, at its true rank.

    Null and non-finite vectors, those of a rarer length, rows without id and vectors that `scale` makes infinite take no part (zero
    vectors do); a table without usable vectors gives no rows. Each row of `queries` gets a list of its own, so an id that two
    different query rows have appears with two lists; equal query rows are one. Each row of `vectors` is a candidate, also one that
    repeats another. Other columns play no part.
    """

    def whole(df: DataFrame) -> DataFrame:
        floor = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
        out = cells.usable(df, vec_id, vector, allow_zero=True).select("vec_id", F.transform("v", lambda x: floor(x * scale)).alias("v"))
        return out.filter(~F.exists("v", lambda x: F.abs(x) == F.lit(float("inf"))))

    rows, asked = cut(whole(vectors)), whole(queries).distinct()
    d, n = cells.common_length(rows), rows.count()
    rows, asked = rows.filter(F.size("v") == d), asked.filter(F.size("v") == d)
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    largest = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))
    most = max(x.agg(largest).first()[0] or 0.0 for x in (rows, asked))
    features = lambda v: segments(v, LEVELS[0])[0]
    splits, search = cells.fit(rows, features, n), BoundSearch(most, d)
    return search.numbers(cells.two_rounds(rows, asked, features, splits, search, k, d, _reach(splits, features)))


def op3_segment_bound_products(spark, sf_dir: str) -> DataFrame:
    """The 5 highest integer products of the rows whose vec_id is divisible by 50, among all embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_products(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)
