"""Operational observations folded into items: the batch twin of streaming.reconcile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTION = {"purchase": "created", "cancel": "cancelled"}


def decide(df: DataFrame, key: str, arrival: str, order: str) -> DataFrame:
    """Adds `decision`: observations arrive by `arrival`; one whose source order is not above all earlier ones of its item is
    stale_ignored (equal orders: the first writer wins), the first is created, others updated."""
    w = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(order).over(w)
    return df.withColumn("decision", F.when(seen.isNull(), "created").when(F.coalesce(F.col(order), F.lit(-(1 << 60))) <= seen, "stale_ignored").otherwise("updated"))


def items(df: DataFrame, key: str, arrival: str, order: str, state: list[str]) -> DataFrame:
    """The state of each item: the highest order wins, among equals the first arrival. An aggregate; no item's history is sorted."""
    o = F.coalesce(F.col(order), F.lit(-(1 << 60)))
    return df.groupBy(key).agg(F.max_by(F.struct(order, arrival, *state), F.struct(o, -F.col(arrival))).alias("r"), F.count("*").alias("observations")).select(key, "r.*", "observations")
