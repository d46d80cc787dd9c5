"""How a new fact relates to an old one: pairs are joined on their entity, and every rule is a column."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import facts as W
from ..functions import text as X
from . import clocks

# How alike statements must be to be one.
SAME_SEQUENCE, SAME_OVERLAP, SAME_JACCARD = 0.88, 0.82, 0.58
SOURCED_OVERLAP, SOURCED_JACCARD, ANCHOR_COVERAGE = 0.48, 0.30, 0.58
RELATIONS = ["duplicate", "supports", "refines", "updates", "complementary", "contradicts", "unrelated"]


@F.pandas_udf(DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


def with_sequence_ratio(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds the ratio of matching blocks of two texts; where lengths alone keep it under SAME_SEQUENCE it is 0 and not computed."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    able = 2 * F.least(F.length(x), F.length(y)) >= SAME_SEQUENCE * (F.length(x) + F.length(y))
    cut = pairs.withColumns({"__x": F.when(able, x).otherwise(""), "__y": F.when(able, y).otherwise("")})
    return cut.withColumn(out, _sequence_ratio("__x", "__y")).drop("__x", "__y")


def share_sources(a: Column, b: Column) -> Column:
    """Two common sources or half of the shorter list."""
    both, least = F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.coalesce((least > 0) & ((both >= 2) | (both / least >= 0.5)), F.lit(False))


def apart(a: Column, b: Column) -> Column:
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), F.lit(False))


FEATURES = ["normal", "plain", "words", "anchors", "values", "denied", "letters", "figures", "as_of", "normal_words", "normal_values", "normal_denied"]


def prepared(facts: DataFrame) -> DataFrame:
    """Adds what pairs are judged by, once for each fact: `from_at`, `to_at`, `signature` (by which assertions of one time are known)
    and the words, values and denials of `statement`."""
    start, end = clocks.interval()
    signature = F.concat_ws("|", F.lower(F.coalesce("temporal_kind", F.lit("unknown"))), F.coalesce(F.trim("valid_from"), F.lit("")), F.coalesce(F.trim("valid_to"), F.lit("")), clocks.stated_precision())
    s = F.col("statement")
    out = facts.withColumns({"from_at": start, "to_at": end, "signature": signature, "normal": X.normal_statement(s), "words": W.fact_words(s)})
    n = F.col("normal")
    return out.withColumns({
        "plain": W.plain_words(s), "anchors": W.anchors_of(F.col("words")), "values": W.material_values(s), "denied": W.denied_words(s), "letters": W.letter_words(s), "figures": W.figures(s),
        "as_of": F.regexp_extract(s, r"(?i)\bas of\s+((?:19|20)\d{2}-\d{2}-\d{2})\b", 1), "normal_words": W.fact_words(n), "normal_values": W.material_values(n), "normal_denied": W.denied_words(n),
    })


def _cues(new, old, prefix: str, words: str) -> Column:
    x, y = new(f"{prefix}values"), old(f"{prefix}values")
    denial = W.denial_conflict(new(f"{prefix}denied"), W.strong(new(words)), old(f"{prefix}denied"), W.strong(old(words)))
    return denial | ((x != y) & (F.size(x) > 0) & (F.size(y) > 0)) | W.contrast(new("letters"), old("letters"))


def classify(pairs: DataFrame) -> DataFrame:
    """Adds `relation` and `confidence` to pairs of prepared facts of one entity, with their columns as new_ and old_."""
    new, old = (lambda c: F.col(f"new_{c}")), (lambda c: F.col(f"old_{c}"))
    claim = lambda w: F.filter(w, lambda t: ~t.isin(W.CLAIM_WEAK))
    denies = lambda w: F.arrays_overlap(w, F.array(*map(F.lit, W.PLAIN_DENIALS)))
    p = with_sequence_ratio(pairs, "new_normal", "old_normal", "__ratio").withColumns({
        "__over": W.overlap(F.array_distinct(new("plain")), F.array_distinct(old("plain"))), "__jac": W.jaccard(F.array_distinct(new("plain")), F.array_distinct(old("plain"))),
        "__u": W.overlap(new("words"), old("words")), "__v": W.jaccard(new("words"), old("words")), "__shared": F.size(F.array_intersect(new("anchors"), old("anchors"))), "__anchors": W.overlap(new("anchors"), old("anchors")),
        "__cu": W.overlap(claim(new("words")), claim(old("words"))), "__cv": W.jaccard(claim(new("words")), claim(old("words"))), "__nu": W.overlap(new("normal_words"), old("normal_words")), "__nv": W.jaccard(new("normal_words"), old("normal_words")),
        "__cues": _cues(new, old, "", "words"), "__normal_cues": _cues(new, old, "normal_", "normal_words"), "__progress": F.arrays_overlap(F.concat(new("plain"), old("plain")), F.array(*map(F.lit, W.PROGRESS))),
        "__after": F.coalesce(old("to_at") <= new("from_at"), F.lit(False)), "__before": F.coalesce(new("to_at") <= old("from_at"), F.lit(False)), "__apart": apart(new("sources"), old("sources")), "__share": share_sources(old("sources"), new("sources")),
        "__longer": F.size(new("plain")) > F.size(old("plain")), "__same": F.array_join(new("plain"), " ") == F.array_join(old("plain"), " "), "__denial": denies(new("plain")) != denies(old("plain")),
    })
    c = lambda name: F.col(f"__{name}")
    one_thing = (c("shared") >= 2) | ((c("shared") >= 1) & (c("u") >= 0.35) & (c("v") >= 0.18))
    largely = (new("normal") == old("normal")) | (~c("normal_cues") & ((c("ratio") >= SAME_SEQUENCE) | ((c("nu") >= SAME_OVERLAP) & (c("nv") >= SAME_JACCARD))))
    sourced = ~c("normal_cues") & c("share") & (((c("nu") >= SOURCED_OVERLAP) & (c("nv") >= SOURCED_JACCARD)) | (c("anchors") >= ANCHOR_COVERAGE))
    one_time = new("signature") == old("signature")
    same_figures = (F.size(new("figures")) == 0) | (F.size(old("figures")) == 0) | (new("figures") == old("figures"))
    holds = (F.size(old("plain")) > 0) & F.contains(F.array_join(new("plain"), " "), F.array_join(old("plain"), " ")) & c("longer")
    p = p.withColumns({
        "__against": c("cues") & one_thing & (c("cu") >= 0.35) & (c("cv") >= 0.25), "__merge": one_time & (largely | sourced), "__once": one_time, "__refines": holds | (same_figures & (c("over") >= 0.45) & c("longer")),
        "__later": (new("as_of") != "") & (old("as_of") != "") & (new("as_of") > old("as_of")), "__empty": (F.coalesce(new("statement"), F.lit("")) == "") | (F.coalesce(old("statement"), F.lit("")) == ""),
    })
    over, sources, x = c("over"), F.when(c("apart"), "supports").otherwise("duplicate"), c("against")
    rules = [  # (condition, relation, confidence): the first that holds
        (c("empty"), F.lit("unrelated"), 0.2),
        (c("same") & ~c("once") & c("after"), F.lit("updates"), 0.9), (c("same") & ~c("once"), F.lit("complementary"), 0.78), (c("same") & c("apart"), F.lit("supports"), 0.94), (c("same"), F.lit("duplicate"), 0.96),
        (c("after") & (over >= 0.2), F.lit("updates"), 0.9),
        (~x & c("progress") & (over >= 0.2), F.lit("complementary"), 0.7),
        (x & c("after"), F.lit("updates"), 0.92), (x & c("before"), F.lit("complementary"), 0.78), (x & c("denial"), F.lit("contradicts"), 0.9),
        (x & c("later") & (over >= 0.35), F.lit("updates"), 0.72), (x & c("progress") & (over >= 0.25), F.lit("complementary"), 0.66), (x, F.lit("contradicts"), 0.82),
        (c("refines"), F.lit("refines"), 0.74),
        (c("merge"), sources, 0.9),
        (over >= 0.72, sources, 0.82),
        ((over >= 0.2) | (c("jac") >= 0.12), F.lit("complementary"), 0.68),
    ]
    relation, sure = None, None
    for when, name, confidence in rules:
        relation = F.when(when, name) if relation is None else relation.when(when, name)
        sure = F.when(when, F.lit(confidence)) if sure is None else sure.when(when, F.lit(confidence))
    out = p.withColumns({"relation": relation.otherwise("unrelated"), "confidence": sure.otherwise(F.lit(0.72))})
    return out.select(*pairs.columns, "relation", "confidence")


def pairs_of_entity(facts: DataFrame, entity: str, newest: str) -> DataFrame:
    """Each entity's newest fact against its others: a pair for each row, not each two, so a large entity costs its size."""
    last = facts.groupBy(entity).agg(F.max(F.struct(newest, "id")).alias("__m"))
    columns = ["id", "statement", "sources", "from_at", "to_at", "signature", *FEATURES]
    new = facts.join(last, entity).filter(F.col("id") == F.col("__m.id")).select(entity, *[F.col(c).alias(f"new_{c}") for c in columns])
    old = facts.select(entity, *[F.col(c).alias(f"old_{c}") for c in columns])
    return new.join(old, entity).filter("new_id <> old_id")


def information(statement: Column) -> Column:
    return F.size(W.fact_words(statement))


def keepers(facts: DataFrame, cluster: str) -> DataFrame:
    """(cluster, id) of the fact that a merge keeps: confirmed, surest, last observed, with most words, last made; then the largest id."""
    best = F.struct(F.coalesce("confirmed", F.lit(False)), F.coalesce("confidence", F.lit(0.0)), F.coalesce("observed_at", F.lit("")), information(F.col("statement")), F.coalesce("created_at", F.lit("")), "id")
    return facts.groupBy(cluster).agg(F.max_by("id", best).alias("id"))


def merged_values(facts: DataFrame, cluster: str) -> DataFrame:
    """(cluster, facts, confidence, observed_at, sources): the surest, the last, and the distinct sources in order of their names."""
    per = facts.groupBy(cluster).agg(F.count("*").alias("facts"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.max("observed_at").alias("observed_at"))
    listed = facts.select(cluster, F.explode("sources").alias("s")).distinct().groupBy(cluster).agg(F.array_sort(F.collect_list("s")).alias("sources"))
    return per.join(listed, cluster, "left")
