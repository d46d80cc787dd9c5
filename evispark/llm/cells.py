"""Vectors dealt to the cells of a small kd-tree, in runs of bounded size, and searches that stream through them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, cut, schema, shuffle_width

#: Rows (those with the smallest hashes) that the tree's splits are fitted on.
SAMPLE = 20_000
#: The tree has a cell for each CELL_ROWS rows, and MOST_CELLS at most: what the driver and each task know of it is bounded.
MOST_CELLS, CELL_ROWS = 2048, 4096
#: A cell with more numbers is dealt to runs of about this size; a task holds one run.
RUN_NUMBERS = 1 << 22
#: So many queries meet a run in one task; more are dealt to several tasks, each with a copy of the run.
QUERY_ROWS = 1 << 18


def usable(df: DataFrame, vec_id: str, vector: str, allow_zero: bool) -> DataFrame:
    """(vec_id, v): the rows whose vectors have only finite components and the table's most common length (the smaller one in
    ties); a row without an id takes no part."""
    v = F.col(vector).cast("array<double>")
    rows = df.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = rows.filter((F.size("v") > 0) & ~F.exists("v", bad))
    if not allow_zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    return rows


def common_length(rows: DataFrame) -> int:
    got = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return got[0] if got else 0


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


class Splits:
    """A balanced kd-tree over features: cells as boxes."""

    def __init__(self, sample: np.ndarray, cells: int):
        boxes = [(np.full(sample.shape[1], -np.inf), np.full(sample.shape[1], np.inf), sample)]
        self.nodes: list = []
        self.root = self._grow(boxes[0], int(np.log2(max(1, cells))))
        self.low, self.high = np.array([x[0] for x in self.nodes]), np.array([x[1] for x in self.nodes])

    def _grow(self, box, depth):
        low, high, rows = box
        if depth == 0 or len(rows) < 4:
            self.nodes.append((low, high))
            return len(self.nodes) - 1
        dim = int(np.argmax(rows.var(0)))
        at = float(np.median(rows[:, dim]))
        left, right = high.copy(), low.copy()
        left[dim] = right[dim] = at
        below = rows[:, dim] < at
        return (dim, at, self._grow((low, left, rows[below]), depth - 1), self._grow((right, high, rows[~below]), depth - 1))

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not isinstance(node, tuple):
                out[rows] = node
                continue
            dim, at, left, right = node
            below = x[rows, dim] < at
            todo += [(left, rows[below]), (right, rows[~below])]
        return out

    def distance2(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each row to each cell's box."""
        out = np.zeros((len(x), len(self.low)))
        for d in range(x.shape[1]):
            v = x[:, d : d + 1]
            out += np.maximum(0, np.maximum(self.low[:, d] - v, v - self.high[:, d])) ** 2
        return out


def fit(rows: DataFrame, features, n: int) -> Splits:
    """Splits from the SAMPLE rows with the smallest hash of their id."""
    got = rows.select("v", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE).select("v").collect()
    cells = min(MOST_CELLS, max(1, n // CELL_ROWS))
    return Splits(features(np.array([r[0] for r in got])), cells)


def deal(rows: DataFrame, splits: Splits, features, d: int) -> tuple[DataFrame, np.ndarray]:
    """(cell, run, vec_id, v) of all rows, computed once, and the number of runs of each cell (at most MOST_CELLS counts)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(splits.assign(features(matrix(b.column("v"))))), *b.columns], names=["cell", "vec_id", "v"])

    placed = cut(rows.mapInArrow(run, schema("cell long, vec_id long, v array<double>")))
    runs = np.zeros(len(splits.low), np.int64)
    for c, n in placed.groupBy("cell").count().collect():
        runs[c] = -(-n // max(1, RUN_NUMBERS // d))
    many = F.element_at(F.from_json(F.lit(str(runs.tolist())), "array<long>"), (F.col("cell") + 1).cast("int"))
    return placed.withColumn("run", F.pmod(F.xxhash64("vec_id", F.lit("run")), many)), runs


def stream(data: DataFrame, visits: DataFrame, search, k: int, blocks: int) -> DataFrame:
    """(q, vec_id, score, exact) found by `search(state, ids, own ids, vectors, limits)` for visits (cell, run, q, query_id, v, bound).

    Data and visits of a run are sorted next to each other, data first: a task holds the data of one run and one batch of
    visits, which stream by. Queries are dealt to `blocks` blocks, so that a run that many ask is many tasks'.
    """
    exact = search.exact

    def run(batches):
        key, ids, rows, state = None, [], [], None
        for b in batches:
            place = b.column("cell").to_numpy() * (1 << 40) + b.column("run").to_numpy() * (1 << 16) + b.column("block").to_numpy()
            q = b.column("q").to_numpy(zero_copy_only=False)
            visit = b.column("is_visit").to_numpy(zero_copy_only=False).astype(bool)
            v, own, bound = matrix(b.column("v")), b.column("id").to_numpy(), b.column("bound").to_numpy()
            edges = np.flatnonzero((np.diff(place) != 0) | (np.diff(visit.astype(np.int8)) != 0)) + 1
            found = []
            for at, to in zip([0, *edges], [*edges, len(b)]):
                if not visit[at]:
                    if key != place[at]:
                        key, ids, rows = place[at], [], []
                    ids.append(own[at:to])
                    rows.append(v[at:to])
                    state = None
                elif key == place[at]:
                    if state is None:
                        state = search.prepare(np.concatenate(ids), np.concatenate(rows))
                        ids, rows = [], []
                    found.append(search(state, q[at:to], own[at:to], v[at:to], bound[at:to], k))
            columns = [np.concatenate([f[j] for f in found]) if found else np.empty(0) for j in range(3)]
            out = {"q": columns[0].astype(np.int64), "vec_id": columns[1].astype(np.int64), "score": columns[2].astype(np.float64)}
            if exact:
                out["exact"] = pa.array([x for f in found for x in f[3]], pa.int64() if exact == "long" else pa.binary())
            yield batch(out)

    none = F.lit(None).cast("long")
    rows = data.select("cell", "run", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("is_visit"), none.alias("q"), F.col("vec_id").alias("id"), "v", F.lit(0.0).alias("bound"))
    asks = visits.select("cell", "run", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("is_visit"), "q", F.col("query_id").alias("id"), "v", "bound")
    dealt = rows.unionAll(asks).repartition(shuffle_width(data.sparkSession), "cell", "run", "block").sortWithinPartitions("cell", "run", "block", "is_visit")
    return dealt.mapInArrow(run, schema("q long, vec_id long, score double" + f", exact {exact}" * bool(exact)))


def best(found: DataFrame, k: int, search) -> DataFrame:
    """The k best of each query row, with `rank` from 1; ties to smaller ids. Each run gave k at most, so groups are small."""
    by = "exact" if search.exact else "score"
    w = Window.partitionBy("q").orderBy(F.desc(by) if search.largest else F.asc(by), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def two_rounds(rows: DataFrame, queries: DataFrame, features, splits: Splits, search, k: int, d: int, reach) -> DataFrame:
    """(query_id, rank, vec_id, score[, exact]). Queries (vec_id, v) are searched row by row. Round 1 sends each to one run of its own
    cell, whose k-th score bounds what it still looks for; round 2 to all runs of the cells that `reach(data)` says can hold better ones."""
    data, counts = deal(rows, splits, features, d)
    known = np.flatnonzero(counts)
    counts = counts[known]
    far = -np.inf if search.largest else np.inf
    queries = cut(queries.withColumnRenamed("vec_id", "query_id").withColumn("q", F.monotonically_increasing_id()))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))

    def home(batches):
        for b in batches:
            v = matrix(b.column("v"))
            if not len(v):
                continue
            nearest = splits.distance2(features(v))[:, known].argmin(1)
            q = b.column("q").to_numpy()
            yield batch({"cell": known[nearest], "run": q % counts[nearest], "q": q, "query_id": b.column("query_id"), "v": b.column("v"), "bound": np.full(len(v), far)})

    visit = schema("cell long, run long, q long, query_id long, v array<double>, bound double")
    first = best(stream(data, queries.mapInArrow(home, visit), search, k, blocks), k, search)
    bound = first.groupBy("q").agg(F.count("*").alias("n"), (F.min("score") if search.largest else F.max("score")).alias("s")).filter(F.col("n") == k).select("q", "s")
    bounded = cut(queries.join(bound, "q", "left").select("q", "query_id", "v", F.coalesce("s", F.lit(float(far))).alias("bound")))
    test = reach(data)

    def rest(batches):
        for b in batches:
            v, limit = matrix(b.column("v")), b.column("bound").to_numpy()
            for at in range(0, len(v), 64):
                row, c = np.nonzero(test(v[at : at + 64], limit[at : at + 64])[:, known])
                n = counts[c]
                first_run = np.repeat(np.cumsum(n) - n, n)
                row, c = np.repeat(row, n) + at, np.repeat(c, n)
                take = pa.array(row)
                yield batch({"cell": known[c], "run": np.arange(len(c)) - first_run, "q": b.column("q").take(take), "query_id": b.column("query_id").take(take), "v": b.column("v").take(take), "bound": limit[row]})

    out = best(stream(data, bounded.mapInArrow(rest, visit), search, k, blocks), k, search)
    return out.join(bounded.select("q", "query_id"), "q").withColumn("rank", F.col("rank").cast("int")).drop("q")
