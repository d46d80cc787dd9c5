"""Sharding by a hypergeometric communication matrix; DataFrame functions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, rank_in

#: Logical partitions, the matrix' rows. Fixed, so the matrix has a fixed size: 256 x (shards + 1) numbers.
PARTITIONS = 256


def communication_matrix(held: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows each partition sends to each shard: rows sum to `held`, columns differ by one at most.

    Drawn as a uniform permutation of all rows would have it: one multivariate hypergeometric draw per partition from
    what the shards can still take, shard by shard.
    """
    rng, total = np.random.Generator(np.random.PCG64(seed)), int(sum(held))
    room = np.full(shards, total // shards, np.int64)
    room[: total % shards] += 1
    room = rng.permutation(room)
    out = np.zeros((len(held), shards), np.int64)
    for i, n in enumerate(held):
        left, rest = int(n), int(room.sum())
        for j in range(shards):
            rest -= int(room[j])
            out[i, j] = hypergeometric(rng, int(room[j]), rest, left)
            left -= int(out[i, j])
        room -= out[i]
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of `n` draws without replacement are good: one law at every size. numpy's sampler takes populations under 10^9."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    return rejected(rng, good, bad, n)


def rejected(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Rejection for a log-concave law with mode m: p * min(1, exp(w - p |x|)) with w = 1 + p / 2 lies over every f(m + x) / f(m) if p is
    at most f(m). Ratios f(m + x) / f(m) are products of exact ratios of neighbours, so no factorial is rounded."""
    low, high, total = max(0, n - bad), min(n, good), good + bad
    if low == high:
        return low
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    spread = np.sqrt(n / total * good * (bad / total) * ((total - n) / max(1, total - 1)))
    p = 0.5 / (np.sqrt(2 * np.pi) * spread + 1)
    w = 1 + p / 2
    while True:
        u, v = rng.random(), rng.random()
        y = v * w / p if u <= w / (1 + w) else (w + rng.exponential()) / p
        x = int(round(y)) * (1 if rng.random() < 0.5 else -1)
        if low <= mode + x <= high and np.log(max(rng.random(), 1e-300)) + min(0.0, w - p * y) <= _log_ratio(mode, x, good, bad, n):
            return mode + x


def _log_ratio(mode: int, x: int, good: int, bad: int, n: int) -> float:
    """log f(mode + x) / f(mode)."""
    at, end, total = (mode, mode + x, 0.0) if x >= 0 else (mode + x, mode, 0.0)
    while at < end:
        k = np.arange(at, min(end, at + 1_000_000), dtype=np.float64)
        total += np.log((good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))).sum()
        at += len(k)
    return total if x >= 0 else -total


def shard_rows(df: DataFrame, shards: int = 16, seed: int = 0, partitions: int = PARTITIONS) -> DataFrame:
    """Deals all rows to `shards` shards uniformly at random, with counts at most one apart; adds `shard` and `slot`.

    Rows go to logical partitions by a hash of all their columns, are permuted there, and the first of them go to
    shard 0, the next to shard 1 and so on, as many as the matrix says; a second permutation orders each shard
    (`slot`, gapless from 0). Copies of a text that differ in any other column are dealt like other rows. Rows that are
    identical in all columns get places of their own, and which of them gets which place makes no difference; they are
    dealt to partitions by their place in the table as well, however many they are. Nulls hash as such.
    An empty table gives an empty result. Columns named `shard` or `slot` are replaced, names with `__` are kept for the operator.
    """
    df = df.drop("shard", "slot")
    plain = [F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    keyed = cut(df.withColumn("__p", F.pmod(F.xxhash64(F.lit(seed), *plain), F.lit(partitions)).cast("int")))
    held = dict(keyed.groupBy("__p").count().collect())
    matrix = communication_matrix([held.get(p, 0) for p in range(partitions)], shards, seed)
    upto = [[int(x) for x in row] for row in matrix.cumsum(1)]
    local = rank_in(keyed, ["__p"], F.xxhash64(F.lit(seed + 1), F.lit("local"), *plain), "__local")
    bounds = F.from_json(F.lit(str(upto)), "array<array<long>>")
    shard = F.aggregate(F.element_at(bounds, F.col("__p") + 1), F.lit(0), lambda n, upper: n + (upper <= F.col("__local")).cast("int"))
    sent = local.withColumn("shard", shard).drop("__p", "__local")
    return rank_in(sent, ["shard"], F.xxhash64(F.lit(seed + 2), F.lit("shard"), *plain), "slot")


def op2_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    """All documents into 16 shards by the law `rows`. A null text counts as empty (size 1, crc of no bytes)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
