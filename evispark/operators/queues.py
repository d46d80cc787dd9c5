"""Queues and ledgers as folds over rows: leases, retries, sweeps, watermarks, admission of changes, revisions and replacements.

State is given as rows and comes back as rows, so a run that is repeated gives the same answer; nothing is locked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def backoff(retries: Column, base: int, most: int) -> Column:
    """Seconds to wait: base doubled per retry, twenty doublings and `most` at the utmost."""
    return F.least(F.lit(most).cast("long"), (F.lit(base) * F.pow(F.lit(2.0), F.least(F.greatest(retries, F.lit(0)), F.lit(20)))).cast("long"))


def lease(queue: DataFrame, now: Column, order: list[str], limit: int, seconds: int = 300) -> DataFrame:
    """The first `limit` due rows (state pending, or processing with a lease that ran out), now processing until `now` + `seconds`."""
    due = ((F.col("state") == "pending") & (F.col("available_at") <= now)) | ((F.col("state") == "processing") & (F.col("lease_until") <= now))
    taken = queue.filter(F.coalesce(due, F.lit(False))).orderBy(*order).limit(limit)
    return taken.withColumns({"state": F.lit("processing"), "lease_until": now + F.make_dt_interval(secs=F.lit(seconds)), "attempts": F.col("attempts") + 1})


def settle(queue: DataFrame, results: DataFrame, key: str, revision: str, now: Column, base: int = 60, most: int = 86_400) -> DataFrame:
    """(key, revision, state, available_at): a result `ok` completes its row, another defers it by the backoff of its attempts, and
    rows with a newer revision of their key in the queue are superseded."""
    newest = queue.groupBy(key).agg(F.max(revision).alias("__newest"))
    got = results.select(key, revision, "ok")
    rows = queue.join(newest, key).join(got, [key, revision], "left")
    old, ok = F.col(revision) < F.col("__newest"), F.col("ok")
    state = F.when(old, "superseded").when(ok, "completed").when(~ok, "deferred").otherwise(F.col("state"))
    wait = now + F.make_dt_interval(secs=backoff(F.col("attempts"), base, most))
    return rows.select(key, revision, state.alias("state"), F.when(~old & ~ok, wait).otherwise(F.col("available_at")).alias("available_at"))


def sweep(rows: DataFrame, now: Column, due: str, created: str, limit: int, spare: list[str]) -> DataFrame:
    """The first `limit` open rows whose `due` has passed, oldest due first, as timeout_resolved; kinds of `spare` stay open."""
    out = rows.filter((F.col("status") == "open") & (F.col(due) <= now) & ~F.col("kind").isin(spare))
    return out.orderBy(due, created).limit(limit).withColumn("status", F.lit("timeout_resolved"))


def newest_only(rows: DataFrame, key: list[str], rank: list[str], deleted: str, invalid: str) -> DataFrame:
    """Adds `status`: of each key the valid row of the highest rank is active, or deleted by its flag; all others and invalid ones superseded."""
    top = rows.filter(~F.col(invalid)).groupBy(*key).agg(F.max(F.struct(*rank)).alias("__top"))
    joined = rows.join(top, key, "left")
    chosen = ~F.col(invalid) & (F.struct(*rank) == F.col("__top"))
    return joined.withColumn("status", F.when(F.coalesce(chosen, F.lit(False)), F.when(F.col(deleted), "deleted").otherwise("active")).otherwise("superseded")).drop("__top")


def remaining_work(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work whose keys (stage, document, hash, model, prompt ...) no terminal row has."""
    return work.join(done.filter(F.col("state").isin("completed", "failed", "skipped")).select(*keys).distinct(), keys, "left_anti")


def admitted_changes(changes: DataFrame, order: list[str], size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """The first changes up to a number of rows and bytes, the first one always.

    Only the first `most_rows` rows can be admitted, so the running sum is over these alone. A row that is too large is left for the next
    run, and smaller ones after it may still come in.
    """
    first = changes.orderBy(*order).limit(most_rows)
    listed = F.sort_array(F.collect_list(F.struct(*order, F.struct(*[c for c in changes.columns]).alias("row"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("taken"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        n = x["row"][size].cast("long")
        ok = (s["taken"] == 0) | (s["used"] + n <= most_bytes)
        return F.struct((s["used"] + F.when(ok, n).otherwise(0)).alias("used"), (s["taken"] + ok.cast("int")).alias("taken"), F.when(ok, F.concat(s["at"], F.array(s["i"]))).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"))

    walked = first.agg(listed.alias("l")).withColumn("at", F.aggregate("l", start, step)["at"])
    return walked.select(F.explode(F.transform("at", lambda i: F.element_at("l", i + 1)["row"])).alias("r")).select("r.*")


def daily_budget(spent: DataFrame, requests: DataFrame, day: str, kind: str, amount: str, limit: float) -> DataFrame:
    """Adds `used` (of that day and kind so far) and `admitted` to each request by itself."""
    used = spent.groupBy(day, kind).agg(F.sum(amount).alias("used"))
    out = requests.join(used, [day, kind], "left").withColumn("used", F.coalesce("used", F.lit(0.0)))
    return out.withColumn("admitted", F.col("used") + F.col(amount) <= limit)


def first_per_session(refs: DataFrame, target: list[str], session: str, at: str) -> DataFrame:
    """One reference of each target and session, the earliest; references without a session all stay."""
    named = refs.filter(F.col(session).isNotNull())
    rest = [c for c in refs.columns if c not in [*target, session]]
    one = named.groupBy(*target, session).agg(F.min(F.struct(at, *[c for c in rest if c != at])).alias("r")).select(*target, session, *[F.col(f"r.`{c}`").alias(c) for c in rest])
    return one.select(*refs.columns).unionAll(refs.filter(F.col(session).isNull()))


def decayed(refs: DataFrame, target: list[str], weight: str, age_days: Column, half_life: float = 90.0, most: float = 2.0) -> DataFrame:
    """(target, boost): the sum of weights halved every `half_life` days, between -most and most. Ages in the future count as 0."""
    faded = F.col(weight) * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / half_life)
    return refs.groupBy(*target).agg(F.round(F.least(F.lit(most), F.greatest(F.lit(-most), F.sum(faded))), 6).alias("boost"))


def unexpired(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    return rows.filter(F.col(at) >= now - F.make_dt_interval(days=F.lit(days)))


def freshness(state: Column, finished: Column, policy: Column, wanted: Column, now: Column, hours: int) -> Column:
    """unavailable if it never ran, partial with another policy or too old, else complete."""
    old = finished < now - F.make_dt_interval(hours=F.lit(hours))
    return F.when(state.isNull() | state.isin("never_run", "not_requested"), "unavailable").when(policy != wanted, "partial").when(finished.isNull() | old, "partial").otherwise("complete")


def compare_and_set(heads: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """(key, generation, value, accepted) of each write: of the writes that expect the head's generation the smallest id wins; all others
    are refused and show the head as it is then."""
    joined = writes.join(heads.select(key, F.col("generation").alias("__head"), F.col("value").alias("__value")), key, "left")
    fits = F.col("expected") == F.coalesce("__head", F.lit(0))
    winner = joined.filter(fits).groupBy(key).agg(F.min("write_id").alias("__winner"))
    out = joined.join(winner, key, "left")
    won = F.coalesce(fits & (F.col("write_id") == F.col("__winner")), F.lit(False))
    return out.select(key, "write_id", (F.coalesce("__head", F.lit(0)) + won.cast("int")).cast("long").alias("generation"), F.when(won, F.col("value")).otherwise(F.col("__value")).alias("value"), won.alias("accepted"))


def mirror_diff(rows: DataFrame, key: str, origin: str, content: str) -> DataFrame:
    """(key, origins, contents): keys that several origins have, and whether their contents differ."""
    per = rows.groupBy(key).agg(F.countDistinct(origin).alias("origins"), F.countDistinct(content).alias("contents"))
    return per.filter("origins > 1")


def two_way_difference(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """(key, side): stale ids that only `have` holds, missing ones that only `want` does."""
    a, b = have.select(key).distinct(), want.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("stale")).unionAll(b.join(a, key, "left_anti").withColumn("side", F.lit("missing")))


def counterparts(rows: DataFrame, key: str, group: str, block: int = 4096) -> DataFrame:
    """(key, members): for each row the other members' group as a list reference: (group, members, first, last).

    All ordered pairs of a group would grow with its square; a row carries its group, and the group's members are rows of `membership`.
    """
    per = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("members"), F.min(key).alias("first"), F.max(key).alias("last")).filter("members > 1")
    return rows.join(per, group).select(key, group, "members", "first", "last")


def place_in(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


# --- curation over facts and pages ---


def state_hash(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, rows, state): an order-free hash of a group's rows: 64 bits summed as decimals, so that partial sums meet."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]).cast("binary"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(group).agg(F.count("*").alias("rows"), F.sum(row).cast("string").alias("state"))


def stale_pages(facts: DataFrame, syntheses: DataFrame, page: str, columns: list[str], newest: str, limit: int) -> DataFrame:
    """The pages with active facts whose synthesis is missing or has another state than their facts, newest first."""
    now = state_hash(facts.filter("status = 'active'"), page, columns).join(facts.filter("status = 'active'").groupBy(page).agg(F.max(newest).alias("newest")), page)
    old = syntheses.select(page, F.col("state").alias("__was"))
    return now.join(old, page, "left").filter(F.col("__was").isNull() | (F.col("__was") != F.col("state"))).orderBy(F.desc("newest"), page).limit(limit).select(page, "newest")


def moved(facts: DataFrame, moves: DataFrame, page: str) -> DataFrame:
    """Facts with their page after merges or renames (from_page, to_page), followed to the last page; `changed` says which moved.

    Moves are followed by doubling, so a chain of n takes log n joins; a page that moves twice takes the smallest target.
    """
    step = cut(moves.groupBy("from_page").agg(F.min("to_page").alias("to_page")))
    for _ in range(40):
        nxt = step.select(F.col("from_page").alias("to_page"), F.col("to_page").alias("__next"))
        new = cut(step.join(nxt, "to_page", "left").select("from_page", F.coalesce("__next", "to_page").alias("to_page"), F.col("__next").isNotNull().alias("__more")))
        step = new.drop("__more")
        if not new.filter("__more").limit(1).count():
            break
    else:
        raise ValueError("moves go round in a circle")
    out = facts.join(step.withColumnRenamed("from_page", page), page, "left")
    return out.withColumn("changed", F.col("to_page").isNotNull()).withColumn(page, F.coalesce("to_page", page)).drop("to_page")


def split_by_section(facts: DataFrame, page: str, section: str, floor: int) -> DataFrame:
    """Facts with `new_page`: page/section where a page has two sections or more of `floor` facts, else the page."""
    per = facts.groupBy(page, section).agg(F.count("*").alias("n")).filter(F.col("n") >= floor)
    wide = per.groupBy(page).agg(F.count("*").alias("k")).filter("k > 1")
    large = per.join(wide, page, "left_semi").select(page, section, F.lit(True).alias("__own"))
    return facts.join(large, [page, section], "left").withColumn("new_page", F.when(F.col("__own"), F.concat_ws("/", page, section)).otherwise(F.col(page))).drop("__own")


def orphans(pages: DataFrame, facts: DataFrame, page: str) -> DataFrame:
    return pages.filter("managed").join(facts.filter("status = 'active'").select(page).distinct(), page, "left_anti")


def ranked_routes(candidates: DataFrame, key: str, limit: int) -> DataFrame:
    """The `limit` best routes of each key by 5 * overlap + min(8, siblings), ties by siblings and page; routes of score 0 drop."""
    scored = candidates.withColumn("score", F.round(5 * F.col("overlap") + F.least(F.col("siblings"), F.lit(8)), 6)).filter("score > 0")
    return place_in(scored, [key], [F.desc("score"), F.desc("siblings"), F.desc("page")]).filter(F.col("place") <= limit)


def triage(relations: DataFrame, key: str) -> DataFrame:
    """(key, outcome, confidence): over a row's relations, contradicts first (the surest), then unsure if any confidence is under 0.7, then the
    first of updates, refines, supports, duplicate, complementary, unrelated."""
    order = ["updates", "refines", "supports", "duplicate", "complementary", "unrelated"]
    place = F.array_position(F.array(*map(F.lit, order)), F.col("relation"))
    per = relations.groupBy(key).agg(
        F.max(F.when(F.col("relation") == "contradicts", F.col("confidence"))).alias("against"), F.min("confidence").alias("least"), F.min(F.struct(place.alias("p"), (-F.col("confidence")).alias("c"))).alias("best"),
    )
    outcome = F.when(F.col("against").isNotNull(), "contradicts").when(F.col("least") < 0.7, "unsure").otherwise(F.element_at(F.array(*map(F.lit, order)), F.col("best.p").cast("int")))
    return per.select(key, outcome.alias("outcome"), F.when(F.col("against").isNotNull(), F.col("against")).when(F.col("least") < 0.7, F.col("least")).otherwise(-F.col("best.c")).alias("confidence"))


def stratified(rows: DataFrame, stratum: str, key: str, quota: int, salt: str = "") -> DataFrame:
    """The `quota` rows of each stratum whose keyed hash is least: stable, whatever else the table holds."""
    h = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")).cast("binary"), 256)
    return place_in(rows.withColumn("__h", h), [stratum], [F.col("__h"), F.col(key)]).filter(F.col("place") <= quota).drop("__h")


def coverage_gap(chunks: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Chunks that no fact cites."""
    return chunks.join(spans.select(key).distinct(), key, "left_anti")


def overlapping(rows: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Rows (key, start, end) that overlap any range of their key: a semi-join, each row once."""
    r = ranges.select(key, F.col("start").alias("__s"), F.col("end").alias("__e"))
    return rows.join(r, (rows[key] == r[key]) & (F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end")), "left_semi")


def authority(links: DataFrame, evidence: DataFrame, item: str, cutoff: Column) -> DataFrame:
    """(item, evidence, safe): safe only if an item has evidence and all of it is known to be from before the cutoff."""
    joined = links.join(evidence, "evidence_id", "left")
    return joined.groupBy(item).agg(F.count("evidence_id").alias("evidence"), F.min(F.coalesce((F.col("at") <= cutoff).cast("int"), F.lit(0))).alias("ok")).select(item, "evidence", (F.col("ok") == 1).alias("safe"))


def context_pack(ranked: DataFrame, group: str, floor: float, per_group: int, most: int, budget: int, words: str = "words", score: str = "score", anchored: str = "anchored", transcript: str = "transcript") -> DataFrame:
    """The rows that go into an answer, by rank: those over the floor; only anchored ones if any are; no transcripts if three others or
    more are left; `per_group` of a document; until `most` rows or `budget` words. Adds `place` and `returned` (words left for the last).

    The ranked list is a top list of bounded length, so its windows are small.
    """
    rows = ranked.filter(F.col(score) >= floor)
    every = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("__any", F.max(F.col(anchored).cast("int")).over(every)).filter((F.col("__any") == 0) | F.col(anchored))
    rows = rows.withColumn("__plain", F.sum((~F.col(transcript)).cast("int")).over(every)).filter((F.col("__plain") < min(3, most)) | ~F.col(transcript))
    by = [F.desc(score), F.col("rank")]
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(*by))).filter(F.col("__k") <= per_group)
    running = Window.partitionBy(F.lit(0)).orderBy(*by)
    rows = rows.withColumns({"place": F.row_number().over(running), "__before": F.coalesce(F.sum(words).over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    out = rows.filter((F.col("place") <= most) & (F.col("__before") < budget))
    return out.withColumn("returned", F.least(F.col(words), F.lit(budget) - F.col("__before")).cast("long")).drop("__any", "__plain", "__k", "__before")
