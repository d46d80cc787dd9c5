"""Curation as functions from a state and an ordered log of actions to the next state, and the candidates that propose actions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Members of a block, and pairs of members that a task makes, about.
BLOCK, TASK_PAIRS = 256, 1 << 24


def last_writes(state: DataFrame, log: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """`state` after a log of writes (key, order, fields): in each field the last value that is not null holds. The fold is one
    aggregate with partial results, so a key with a long history is not sorted; writes to unknown keys do nothing."""
    last = log.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f"__{f}") for f in fields])
    return state.join(last, key, "left").withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop(*[f"__{f}" for f in fields])


def merge_facts(facts: DataFrame, merges: DataFrame, key: str, order: str) -> DataFrame:
    """`facts` (key, status, conflict_group_id, ...) after merges (keeper, superseded, order), a row a superseded fact: keepers are
    active, the others superseded and out of their conflict; a fact that several merges name is as the last leaves it."""
    log = merges.filter("keeper <> superseded").select(F.explode(F.array(
        F.struct(F.col("keeper").alias(key), F.col(order).alias("__at"), F.lit("active").alias("s")), F.struct(F.col("superseded").alias(key), F.col(order).alias("__at"), F.lit("superseded").alias("s")))).alias("r")).select("r.*")
    last = log.groupBy(key).agg(F.max_by("s", F.struct("__at", "s")).alias("__s"))
    group = F.when(F.coalesce(F.col("__s") != "superseded", F.lit(True)), F.col("conflict_group_id"))
    return facts.join(last, key, "left").withColumns({"conflict_group_id": group, "status": F.coalesce("__s", "status")}).drop("__s")


def settle(moves: DataFrame, rounds: int = 60) -> DataFrame:
    """(old, new) with chains of moves followed to their ends: each round doubles the steps. An id moves once; a cycle is an error."""
    m = cut(moves.select("old", "new").filter("old <> new"))
    for _ in range(rounds):
        onward = m.select(F.col("old").alias("__o"), F.col("new").alias("__n"))
        stepped = cut(m.join(onward, F.col("new") == F.col("__o"), "left").select("old", F.coalesce("__n", "new").alias("new"), F.col("__n").isNotNull().alias("moved")))
        m = stepped.drop("moved")
        if stepped.filter("moved").isEmpty():
            return m
        if not m.filter("old = new").isEmpty():
            break
    raise ValueError("moves form a cycle")


def redirect(df: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """`df` with ids of `column` moved to where merges or renames (old, new) have brought them."""
    final = settle(moves).select(F.col("old").alias(column), F.col("new").alias("__new"))
    return df.join(final, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def state_hash(*columns: Column | str) -> Column:
    """The guard of a revert: the sha256 of the columns as JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def revert(state: DataFrame, inverse: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`state` with the old values that `inverse` (key, guard, fields) holds, where the state still has the hash `guard` that it had
    after the action; rows changed since keep what they have. Adds `reverted`."""
    old = inverse.select(key, F.col("guard").alias("__guard"), *[F.col(f).alias(f"__{f}") for f in fields])
    same = F.coalesce(state_hash(*fields) == F.col("__guard"), F.lit(False))
    marked = state.join(old, key, "left").withColumn("reverted", same)
    return marked.withColumns({f: F.when(F.col("reverted"), F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}).drop("__guard", *[f"__{f}" for f in fields])


def admissions(items: DataFrame, key: str, order: list[str], active_limit: int, daily_limit: int, historical_limit: int) -> DataFrame:
    """(key, state, reason) of review items (hard, historical booleans) taken in `order`, then by key: hard ones are always in,
    historical ones up to their limit, others while active and daily limits last.

    Counters only grow, so a class that is full stays full: the first `historical_limit` historical items compete with the other
    ordinary ones, and one is in if the hard and competing items before it are below both limits. So only the first few of each
    class can matter; three distributed top lists find them, and no window sees more than that.
    """
    by = [*order, key]
    flags = items.withColumns({"hard": F.coalesce("hard", F.lit(False)), "historical": F.coalesce("historical", F.lit(False))})
    first = lambda where, k: flags.filter(where).orderBy(*by).limit(max(0, k))
    most = min(active_limit, daily_limit)
    lists = first("hard", active_limit).unionAll(first("not hard and historical", historical_limit)).unionAll(first("not hard and not historical", most))
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c.cast("int")).over(before), F.lit(0))
    fits = (count(F.lit(1)) < active_limit) & (count(~F.col("hard")) < daily_limit)
    placed = lists.withColumn("__in", fits).filter("not hard").select(key, "historical", "__in")
    full = placed.filter("historical and __in").count() >= historical_limit
    known = flags.join(placed.drop("historical"), key, "left")
    late = F.col("historical") & F.col("__in").isNull() & F.lit(full)
    reason = F.when(F.col("hard"), "hard_boundary").when(F.col("__in"), "daily_budget").when(late, "historical_capacity").otherwise("capacity")
    return known.select(key, F.when(reason.isin("hard_boundary", "daily_budget"), "admitted").otherwise("deferred").alias("state"), reason.alias("reason"))


def split_limits(aggressiveness: float) -> tuple[int, int, int]:
    """(facts of a page, its sections, facts of a section) from which a split is proposed; more aggressive, fewer."""
    a = min(1.0, max(0.0, aggressiveness))
    return max(3, min(12, round(12 - 14 * a))), max(2, min(5, round(5 - 4 * a))), 3 if a < 0.25 else 2 if a < 0.5 else 1


def split_candidates(facts: DataFrame, page: str, section: str, aggressiveness: float = 0.5) -> DataFrame:
    """(page, facts, sections, score) of dense pages with facts in several sections. Two partial aggregates."""
    least_facts, least_sections, each = split_limits(aggressiveness)
    n = facts.groupBy(page, section).agg(F.count("*").alias("n"))
    named = F.coalesce((F.col(section) != "") & ~F.lower(section).isin("summary", "unsectioned"), F.lit(False))
    pages = n.groupBy(page).agg(F.sum("n").alias("facts"), F.count_if(named).alias("sections"), F.count_if(named & (F.col("n") >= each)).alias("full"))
    score = F.round(F.least(F.lit(0.95), 0.45 + F.col("facts") / 25.0 + F.col("sections") * 0.05), 4)
    return pages.filter((F.col("facts") >= least_facts) & (F.col("full") >= least_sections)).select(page, "facts", "sections", score.alias("score"))


def contract_mismatches(facts: DataFrame, contracts: DataFrame, page: str, section: str) -> DataFrame:
    """(page, facts, invalid, score) of pages with facts in sections that their contract (page, allowed) lacks. Facts are counted by
    section before they meet the contract."""
    n = facts.groupBy(page, section).agg(F.count("*").alias("n")).join(contracts, page)
    bad = ~F.coalesce(F.array_contains("allowed", F.col(section)), F.lit(False))
    out = n.groupBy(page).agg(F.sum("n").alias("facts"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("invalid"))
    return out.filter("invalid > 0").withColumn("score", F.round(F.least(F.lit(0.9), 0.45 + F.col("invalid") / F.col("facts") * 0.35), 4))


def coalesce_events(candidates: DataFrame, key: list[str], source: str) -> DataFrame:
    """One row for candidates of the same occurrence, with its distinct sources in order: repeats go before sources are gathered."""
    pairs = candidates.groupBy(*key, source).agg(F.count("*").alias("n"))
    return pairs.groupBy(*key).agg(F.array_sort(F.collect_list(source)).alias("sources"), F.sum("n").alias("candidates"))


def names_within(names: DataFrame, name: str = "name") -> DataFrame:
    """(part, whole): distinct names whose words are a proper subset of another's. A name is looked for under its rarest word
    only, so a word that most names share pairs no more than the names that have nothing else."""
    sets = names.select(F.col(name).alias("n")).distinct().withColumn("w", F.array_distinct(F.split("n", " "))).filter("n <> ''")
    words = sets.select("n", "w", F.explode("w").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("often"))
    rarest = words.join(often, "word").groupBy("n").agg(F.min(F.struct("often", "word")).alias("m"), F.first("w").alias("w")).select(F.col("n").alias("part"), F.col("w").alias("pw"), F.col("m.word").alias("word"))
    both = rarest.join(words.select("word", F.col("n").alias("whole"), F.col("w").alias("ww")), "word")
    return both.filter((F.size("pw") < F.size("ww")) & (F.size(F.array_except("pw", "ww")) == 0)).select("part", "whole")


def similar_sets(sets: DataFrame, words: str, threshold: int) -> DataFrame:
    """(a, b, jaccard): pairs a < b of distinct sets of words (sorted arrays) with 100 * intersection >= threshold * union. Two such sets share
    one of the first n - ceil(threshold * n / 100) + 1 of their n words, rarest first, so they meet under these only; all words count."""
    s = sets.select(F.col(words).alias("w"))
    often = s.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("often"))
    ranked = s.select("w", F.explode("w").alias("word")).join(often, "word").groupBy("w").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("r"))
    n = F.size("w")
    first = F.slice("r", 1, n - F.ceil(n * threshold / 100).cast("int") + 1)
    met = ranked.select("w", F.explode(first["word"]).alias("word"))
    both = met.select("word", F.col("w").alias("a")).join(met.select("word", F.col("w").alias("b")), "word").filter("a < b")
    fit = F.least(F.size("a"), F.size("b")) * 100 >= F.greatest(F.size("a"), F.size("b")) * threshold
    shared = both.filter(fit).select("a", "b").distinct().withColumn("shared", F.size(F.array_intersect("a", "b")))
    union = F.size("a") + F.size("b") - F.col("shared")
    return shared.filter(100 * F.col("shared") >= threshold * union).select("a", "b", (F.col("shared") / union).alias("jaccard"))


def member_pairs(pairs: DataFrame, groups: DataFrame, members: DataFrame, group: str, key: str) -> DataFrame:
    """(x, y, ...): the members x < y of the groups a and b of each row of `pairs`, with its other columns; a group paired with itself gives
    each two of its members once. Keys are distinct and not null; `groups` has each group once, with its number of members (n). Blocks of
    about BLOCK members meet, by number, and rows are made from two arrays at the end, so a large group is spread over tasks."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    size = lambda c: groups.select(F.col(group).alias(c), F.col("n").alias(f"n_{c}"), F.ceil(F.col("n") / BLOCK).alias(f"blocks_{c}"))
    sized = cut(pairs.join(size("a"), "a").join(size("b"), "b"))
    made = sized.agg(F.sum(F.col("n_a").cast("double") * F.col("n_b"))).first()[0] or 0
    tasks = max(int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(made / TASK_PAIRS))
    block = lambda c, i, keys: (
        members.select(F.col(group).alias(c), key).join(size(c), c).groupBy(c, F.pmod(F.xxhash64(key), F.col(f"blocks_{c}")).alias(i)).agg(F.collect_list(key).alias(keys))
    )
    left = sized.join(block("a", "i", "p"), "a").withColumn("one", F.col("a") == F.col("b"))
    left = left.withColumn("j", F.explode(F.sequence(F.when(F.col("one"), F.col("i")).otherwise(F.lit(0)), F.col("blocks_b") - 1)))
    left = left.select("b", "j", (F.col("one") & (F.col("i") == F.col("j"))).alias("one"), "p", *rest).repartition(tasks, "b", "j")
    both = left.join(block("b", "j", "q").repartition(tasks, "b", "j"), ["b", "j"]).select("p", "q", "one", *rest)
    both = both.withColumn("p", F.explode("p")).withColumn("q", F.explode("q"))
    return both.filter(~F.col("one") | (F.col("p") < F.col("q"))).select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), *rest)
