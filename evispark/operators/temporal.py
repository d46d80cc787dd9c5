"""Bitemporal facts: versions, clocks, currentness and intervals. All half-open [from, to)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """SCD-2: adds valid_from, valid_to (the next version's start, null if open), revision and is_head per key. A key's history is
    one window group, as revisions of one lineage must meet."""
    w = Window.partitionBy(key).orderBy(at, tie)
    return df.withColumns({"valid_from": F.col(at), "valid_to": F.lead(at).over(w), "revision": F.row_number().over(w)}).withColumn("is_head", F.col("valid_to").isNull())


def valid_at(point: Column, kind: Column, start: Column, end: Column) -> Column:
    """unknown never matches; instantaneous matches its day; others are half-open, open ends match."""
    inside = (start.isNull() | (start <= point)) & (end.isNull() | (point < end))
    return F.when(kind == "unknown", False).when(kind == "atemporal", True).when(kind == "instantaneous", (start <= point) & (point < start + F.expr("INTERVAL 1 DAY"))).otherwise(inside)


def known_at(point: Column, created: Column, knowledge_to: Column) -> Column:
    return (created <= point) & (knowledge_to.isNull() | (point < knowledge_to))


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The newest row of each key, by aggregation: no sort, and partial results before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def relation(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.when(a1 <= b0, "before").when(b1 <= a0, "after").otherwise("overlap")


def currentness(kind: Column, status: Column, start: Column, end: Column, now: Column) -> Column:
    """The label that says whether a fact holds now."""
    return (
        F.when(status == "superseded", "superseded").when(status == "unreviewed", "unreviewed").when(kind == "atemporal", "atemporal")
        .when(kind == "unknown", "unknown_valid_time").when(start.isNull() & end.isNull(), "ongoing_unknown_start").when(start > now, "future").when(end <= now, "historical").otherwise("current")
    )


def interval_join(left: DataFrame, right: DataFrame, on: str, width_days: int = 30) -> DataFrame:
    """Pairs of rows (s, e) of one key that overlap: both sides go to the buckets they touch, and a pair counts in the bucket of
    its later start, so no pair comes twice and no side is compared with all."""
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400 / width_days).cast("long")
    cut = lambda df, x: df.select(F.col(on), *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c != on]).withColumn("bucket", F.explode(F.sequence(day(f"s_{x}"), day(f"e_{x}"))))
    both = cut(left, "a").join(cut(right, "b"), [on, "bucket"])
    return both.filter((F.col("s_a") < F.col("e_b")) & (F.col("s_b") < F.col("e_a")) & (F.col("bucket") == day(F.greatest("s_a", "s_b")))).drop("bucket")
