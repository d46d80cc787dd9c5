"""Quality by regularised quadratic discriminant analysis over transformed document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, cut, extended, held_out, mix, prefix_hashes, schema, slices, text_bytes

FEATURES = ["bytes", "words", "lines", "upper", "digit", "mark", "symbol", "bar", "wide", "word_bytes", "distinct_words", "top_word", "line_copies", "word_start_upper", "short_words", "entropy"]
#: The classifier is fitted on at most so many labelled rows, those with the smallest hash of their id.
FIT_ROWS = 50_000


def _classes() -> np.ndarray:
    table = np.zeros((256, 6), np.float64)
    table[65:91, 0] = 1  # upper case
    table[48:58, 1] = 1  # digits
    table[[ord(c) for c in ".,;:!?'\"()-"], 2] = 1
    table[[ord(c) for c in "#$%&*@^~_=+<>/\\[]{}`"], 3] = 1
    table[ord("|"), 4] = 1
    table[128:, 5] = 1
    return table


def _runs(data, offsets, doc, breaks, powers):
    """(document, length, hash, first byte) of the maximal runs of bytes that are not `breaks`, within documents."""
    stop = breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], stop[:-1]]) | edge[:-1]
    after = np.concatenate([stop[1:], [True]]) | edge[1:]
    s, e = np.flatnonzero(~stop & before), np.flatnonzero(~stop & after) + 1
    h, down = prefix_hashes(data, powers)
    return doc[s], e - s, mix((h[e] - h[s]) * down[s]), data[s] if len(s) else np.empty(0, np.uint8)


def _repeats(doc, key, weight, n):
    """By document: distinct keys, the largest weight of one key, the weight of all but the first of each key."""
    order = np.lexsort((key, doc))
    d, k, w = doc[order], key[order], weight[order].astype(float)
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(first)
    top = np.zeros(n)
    if len(at):
        np.maximum.at(top, d[at], np.add.reduceat(np.ones(len(d)), at))
    return np.bincount(d[at], minlength=n), top, np.bincount(d, weights=w * ~first, minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> np.ndarray:
    """The transformed statistics of each whole text, in the order of FEATURES; an empty text's are those of counts 0."""
    n, size = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    hist = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
    share = hist @ _classes() / np.maximum(size, 1)[:, None]
    p = hist / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    space, line = np.zeros(256, bool), np.zeros(256, bool)
    space[[32, *range(9, 14)]] = line[10] = True
    wd, wl, wh, wc = _runs(data, offsets, doc, space, powers)
    ld, ll, lh, _ = _runs(data, offsets, doc, line, powers)
    words, lines = np.bincount(wd, minlength=n), np.bincount(ld, minlength=n)
    many = np.maximum(words, 1)
    distinct, top, _ = _repeats(wd, wh, wl, n)
    copies = _repeats(ld, lh, ll, n)[2]
    caps = np.bincount(wd, weights=(wc >= 65) & (wc < 91), minlength=n)
    short = np.bincount(wd, weights=wl <= 3, minlength=n)
    root = np.sqrt
    return np.stack([
        np.log1p(size), np.log1p(words), np.log1p(lines), root(share[:, 0]), root(share[:, 1]), root(share[:, 2]), root(share[:, 3]), root(share[:, 4]), root(share[:, 5]),
        np.log1p(np.bincount(wd, weights=wl, minlength=n) / many), np.log((distinct + 1) / (words + 1)), root(top / many), root(copies / np.maximum(size, 1)), root(caps / many), root(short / many), entropy,
    ], 1)


def with_statistics(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every whole text; a null text is empty, a null id stays null. Rows that repeat an id or a text are
    rows of their own; an empty table gives an empty result; other columns play no part."""

    def run(batches):
        powers = Powers()
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            rows = [statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], powers) for i, j in slices(offsets)]
            x = np.concatenate([*rows, np.zeros((0, len(FEATURES)))])
            at = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(at, x.ravel())], names=["doc_id", "x"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema(f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>"))


class Discriminant:
    """Two Gaussian classes with covariances shrunk to the pooled one and to its diagonal; Cholesky factors are kept."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: float = 0.3, to_diagonal: float = 0.1):
        self.prior = float(np.mean(y)) if len(y) else 0.5
        self.trained = len(y) > 0 and 0 < y.sum() < len(y)
        if not self.trained:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z, d = (x - self.mean) / self.scale, x.shape[1]
        centred = np.concatenate([z[y == c] - z[y == c].mean(0) for c in (0, 1)])
        pooled = centred.T @ centred / len(z)
        self.parts = []
        for c in (0, 1):
            own = z[y == c]
            cov = np.cov(own.T, bias=True) if len(own) > 1 else pooled
            cov = (1 - shrink) * cov + shrink * pooled
            cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(pooled) + 0.05)
            low = np.linalg.cholesky(cov)
            self.parts.append((own.mean(0), np.linalg.solve(low, np.eye(d)), np.log(np.diag(low)).sum()))
        self.a, self.b = 1.0, np.log(self.prior / (1 - self.prior))
        self._calibrate(self.difference(x), y)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, squashed so that far outliers stay comparable."""
        z = (x - self.mean) / self.scale
        logs = [-0.5 * (((z - m) @ inv.T) ** 2).sum(1) - half for m, inv, half in self.parts]
        return np.arcsinh(logs[1] - logs[0])

    def _calibrate(self, t: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of the label on the difference, by Newton's steps with a small ridge."""
        design, w = np.stack([t, np.ones_like(t)], 1), np.array([self.a, self.b])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            w = w + np.linalg.solve(hess, design.T @ (y - p) - 1e-3 * w)
        self.a, self.b = w

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.a * self.difference(x) + self.b, -30, 30)))


def fit(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "label", fit_rows: int = FIT_ROWS) -> Discriminant:
    """From the rows of `stats` that have a label 0 or 1; more than `fit_rows` of them are sampled by the hash of their id, ties by label.

    Other labels and null labels or ids teach nothing. An id with several labels counts once with each of them, also with
    two that differ; equal label rows are one. Rows that repeat an id all count. Other columns play no part.
    """
    taught = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("__y")).distinct()
    rows = stats.select("x", F.col("doc_id").alias("__id")).join(taught, "__id")
    got = rows.select("x", "__y", F.xxhash64("__id").alias("h")).orderBy("h", "__y").limit(fit_rows).collect()
    return Discriminant(np.array([r[0] for r in got]).reshape(-1, len(FEATURES)), np.array([r[1] for r in got]))


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """Adds `score` to the rows of with_statistics(); without two classes to learn from it is their share of label 1 (a half if there are
    no labels). Equal statistics get equal scores. A column `score` is replaced, other columns are kept."""
    stats = stats.drop("score")

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], names=[*b.schema.names, "score"])

    return stats.mapInArrow(run, extended(stats, "score double"))


def op5_qda_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labelled ones whose crc32(doc_id) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out("doc_id", 5, 0))
    stats = cut(with_statistics(docs))
    model = fit(stats, labels.select("doc_id", F.col("quality").alias("label")))
    out = score(stats, model).withColumn("held_out", held_out("doc_id", 5, 0))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
