"""Components, cliques, chains and degrees over pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def components(pairs: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(id, root): the smallest id each id of the pairs reaches, its own included. Every round hangs ids on smaller ones, first larger
    neighbours, then all but the least; hot ids are aggregates with partial minima. The driver sees two numbers a round."""
    ids = pairs.select(F.col(a).alias("id")).unionAll(pairs.select(F.col(b).alias("id"))).distinct()
    e = cut(pairs.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("u < v").distinct())
    was = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        hung = both.join(low, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = hung.groupBy("v").agg(F.min("u").alias("m"))
        rest = hung.join(low, "v").filter("u <> m").select(F.greatest("u", "m").alias("v"), F.least("u", "m").alias("u"))
        e = cut(rest.unionByName(low.select("v", F.col("m").alias("u"))).filter("u < v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("v", "u").cast("decimal(38,0)"))).first())
        if now == was:
            root = e.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "id")
            return ids.join(root, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
        was = now
    raise RuntimeError("components did not settle")


def cliques(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(root, members, links, accepted): components whose every two members are linked, by counting."""
    once = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()
    root = components(once)
    size = root.groupBy("root").agg(F.count("*").alias("members"))
    links = once.join(root, F.col("a") == F.col("id")).groupBy("root").agg(F.count("*").alias("links"))
    return size.join(links, "root").withColumn("accepted", F.col("links") * 2 == F.col("members") * (F.col("members") - 1))


def degrees(mentions: DataFrame, group: str, item: str) -> DataFrame:
    """(item, neighbours, weight): how many items share a group with it, and in how many (item, group) meetings."""
    m = mentions.select(group, item).distinct()
    pairs = m.join(m.withColumnRenamed(item, "other"), group).filter(F.col(item) != F.col("other"))
    return pairs.groupBy(item, "other").agg(F.count("*").alias("w")).groupBy(item).agg(F.count("*").alias("neighbours"), F.sum("w").alias("weight"))


def chain_ends(links: DataFrame, key: str, after: str, most: int = 40) -> DataFrame:
    """(key, first, steps) by doubling pointers towards the first of a chain; `after` names what a row follows, null for a first."""
    p = cut(links.select(F.col(key).alias("k"), F.coalesce(after, key).alias("to"), F.col(after).isNotNull().cast("long").alias("steps")))
    for _ in range(most):
        q = p.select(F.col("k").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        new = cut(p.join(q, "to", "left").select("k", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        if tuple(new.agg(F.sum("steps")).first()) == tuple(p.agg(F.sum("steps")).first()):
            return new.select(F.col("k").alias(key), F.col("to").alias("first"), "steps")
        p = new
    raise RuntimeError("a chain has no first row")


def greedy_reserve(candidates: DataFrame, key: str, left: str, right: str, score: str, most: int = 200) -> DataFrame:
    """The pairs that a greedy walk in the order of (score desc, key) keeps, where a kept pair reserves both its ends.

    By rounds: every pair that comes first at both its ends is kept, and all pairs at a kept end go; the walk gives the same pairs.
    """
    order = F.struct((-F.col("s")).alias("less"), F.col("key").alias("key"))
    rest = cut(candidates.select(F.col(key).alias("key"), F.col(left).alias("l"), F.col(right).alias("r"), F.col(score).cast("double").alias("s")).withColumn("o", order))
    kept = None
    for _ in range(most):
        ends = rest.select(F.explode(F.array("l", "r")).alias("end"), "o").groupBy("end").agg(F.min("o").alias("m"))
        at = lambda c: ends.select(F.col("end").alias(c), F.col("m").alias(f"m{c}"))
        won = cut(rest.join(at("l"), "l").join(at("r"), "r").filter("ml = o and mr = o").select("key", "l", "r", "s"))
        kept = won if kept is None else kept.unionAll(won)
        gone = won.select(F.explode(F.array("l", "r")).alias("end")).distinct()
        rest = cut(rest.join(gone.withColumnRenamed("end", "l"), "l", "left_anti").join(gone.withColumnRenamed("end", "r"), "r", "left_anti"))
        if not rest.limit(1).count():
            return kept.select(F.col("key").alias(key), F.col("l").alias(left), F.col("r").alias(right), F.col("s").alias(score))
    raise RuntimeError("the walk did not end")
