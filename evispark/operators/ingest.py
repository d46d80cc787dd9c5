"""What a new scan of sources changes, and spans of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def rescan(known: DataFrame, found: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, change): new, changed, unchanged or removed, for each key of the known hashes (key, content_hash) and the texts found. Texts
    are hashed where they are read, so only keys and hashes are shuffled. A null text counts as empty."""
    now = found.select(key, X.sha256(F.col(text)).alias("__hash"), F.lit(True).alias("__here"))
    both = known.select(key, "content_hash", F.lit(True).alias("__known")).join(now, key, "full")
    change = F.when(F.col("__here").isNull(), "removed").when(F.col("__known").isNull(), "new").when(F.col("__hash") == F.col("content_hash"), "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"))


def merged_spans(units: DataFrame, group: str) -> DataFrame:
    """(group, first, last, units): runs of consecutive units (group, unit); a unit named twice counts once. A group is one document's
    cited units."""
    w = Window.partitionBy(group).orderBy("unit")
    island = units.select(group, "unit").distinct().withColumn("island", F.col("unit") - F.row_number().over(w))
    return island.groupBy(group, "island").agg(F.min("unit").alias("first"), F.max("unit").alias("last"), F.count("*").alias("units")).drop("island")
