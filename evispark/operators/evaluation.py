"""Measures of retrieval, labels, reviewers and volumes: each is one aggregate over rows, with ratios of nothing defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import ratio


def _n(condition: Column) -> Column:
    return F.sum(F.coalesce(condition.cast("long"), F.lit(0)))


def case_metrics(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of cases (verdict_match, expects_source, source_hit, negative, passed, facts): accuracy, hit rate and controls, 1 where nothing was
    asked; in all, or per value of `by`."""
    hit = ratio(_n(F.col("expects_source") & F.col("source_hit")), _n(F.col("expects_source")))
    control = ratio(_n(F.col("negative") & F.col("passed")), _n(F.col("negative")))
    leaks = _n(F.col("negative") & (F.col("facts") > 0))
    measures = [F.count("*").alias("cases"), F.round(ratio(_n(F.col("verdict_match")), F.count("*")), 3).alias("verdict_accuracy"), F.round(hit, 3).alias("source_hit_rate"), F.round(control, 3).alias("control_pass_rate"), leaks.alias("fact_leaks")]
    return cases.groupBy(*by or []).agg(*measures)


def precision_recall(pairs: DataFrame, expected: str, actual: str, by: list[str] | None = None) -> DataFrame:
    """precision, recall and f1 of booleans; precision and recall of nothing are 1, f1 of two zeros is 0."""
    both, made, wanted = _n(F.col(expected) & F.col(actual)), _n(F.col(actual)), _n(F.col(expected))
    out = pairs.groupBy(*by or []).agg(both.alias("hits"), made.alias("made"), wanted.alias("wanted"))
    p, r = ratio(F.col("hits"), F.col("made")), ratio(F.col("hits"), F.col("wanted"))
    return out.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6)})


def confusion(pairs: DataFrame, expected: str, actual: str) -> DataFrame:
    return pairs.groupBy(F.col(expected).alias("expected"), F.col(actual).alias("actual")).agg(F.count("*").alias("n"))


def calibration_error(rows: DataFrame, confidence: str, value: str, bins: int = 5) -> DataFrame:
    """One row `ece`: the mean distance of confidence and value over equal bins, the last closed; 0 of nothing."""
    inside = rows.filter(F.col(confidence).between(0, 1))
    per = inside.groupBy(F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(value).alias("v"))
    return per.agg(F.round(F.coalesce(F.sum(F.col("n") * F.abs(F.col("c") - F.col("v"))) / F.sum("n"), F.lit(0.0)), 6).alias("ece"))


def ranking_metrics(ranked: DataFrame, gold: DataFrame, query: str, item: str, depth: int = 10) -> DataFrame:
    """Per query: gold items, hits at 5 and at `depth`, recall, reciprocal rank and completeness. Queries without results count too."""
    met = gold.join(ranked, [query, item], "left")
    upto = lambda k: _n(F.col("rank") <= k)
    out = met.groupBy(query).agg(F.count("*").alias("gold"), upto(5).alias("hits_5"), upto(depth).alias("hits"), F.min(F.when(F.col("rank") <= depth, F.col("rank"))).alias("first"))
    return out.select(query, "gold", "hits_5", "hits", F.round(F.col("hits") / F.col("gold"), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"), (F.col("hits") == F.col("gold")).alias("complete"))


def summarised(per_query: DataFrame) -> DataFrame:
    """One row over ranking_metrics(): hit rates, micro and macro recall, mean reciprocal rank, share of complete queries."""
    any_ = lambda c: F.avg((F.col(c) > 0).cast("double"))
    return per_query.agg(
        F.count("*").alias("queries"), F.round(any_("hits_5"), 6).alias("hit_5"), F.round(any_("hits"), 6).alias("hit_10"), F.round(ratio(F.sum("hits"), F.sum("gold")), 6).alias("micro_recall"),
        F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg(F.col("complete").cast("double")), 6).alias("complete_rate"),
    )


def run_agreement(runs: DataFrame, item: str, run: str, label: str, accepted: list[str]) -> DataFrame:
    """(left, right, items, exact, agreed) of each two runs over the items that both have: equal labels, and equal acceptance."""
    a, b = runs.select(item, F.col(run).alias("left"), F.col(label).alias("x")), runs.select(item, F.col(run).alias("right"), F.col(label).alias("y"))
    pairs = a.join(b, item).filter("left < right")
    same = F.col("x").isin(accepted) == F.col("y").isin(accepted)
    return pairs.groupBy("left", "right").agg(F.count("*").alias("items"), F.round(F.avg((F.col("x") == F.col("y")).cast("double")), 6).alias("exact"), F.round(F.avg(same.cast("double")), 6).alias("agreed"))


def consensus(runs: DataFrame, item: str, label: str, best: str, accepted: list[str], votes: int = 3) -> DataFrame:
    """(item, outcome): `best` where all of `votes` runs say it, uncertain with two accepted, else unsupported."""
    per = runs.groupBy(item).agg(_n(F.col(label) == best).alias("b"), _n(F.col(label).isin(accepted)).alias("a"))
    return per.select(item, F.when(F.col("b") >= votes, best).when(F.col("a") >= 2, "uncertain").otherwise("unsupported").alias("outcome"))


def nearest_ranks(df: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles, sorted[ceil(p n / 100) - 1]: from counts per distinct value, so a task sorts values, not rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy(value)
    placed = counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(*by))})
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * p / 100.0), F.col(value))).alias(f"p{p}")
    return placed.groupBy(*by).agg(*[at(p) for p in percents], F.max(value).alias("largest"))


def wilson(n: Column, p: Column) -> tuple[Column, Column]:
    """The 95 % interval of a share p of n."""
    z = 1.959963984540054  # fixed value
    mid, half = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def units_complete(members: DataFrame, unit: str, matched: str, exact: str, group: str) -> DataFrame:
    """(unit, complete, exact): all members matched within one group; exact if all are."""
    per = members.groupBy(unit).agg(F.min(F.col(matched).cast("int")).alias("m"), F.min(F.col(exact).cast("int")).alias("e"), F.min(group).alias("g1"), F.max(group).alias("g2"), F.count("*").alias("n"))
    whole = (F.col("m") == 1) & ((F.col("n") == 1) | F.coalesce(F.col("g1") == F.col("g2"), F.lit(False)))
    return per.select(unit, whole.alias("complete"), (whole & (F.col("e") == 1)).alias("exact"))


def review_precision(emitted: Column, matched: Column, gold: Column) -> Column:
    """matched / emitted; of none emitted 1 if there is no gold, else 0."""
    return F.when(emitted > 0, matched / emitted).when(gold == 0, F.lit(1.0)).otherwise(F.lit(0.0))
