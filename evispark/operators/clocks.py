"""Facts under two clocks: when they hold, when they were known, and when their events happen.

A fact has `temporal_kind`, `status` (with `revision_status` where it is revision_closed), `valid_from`, `valid_to`, `valid_time_precision`,
`temporal_confidence`, `created_at`, `knowledge_to` and `event_kind`, `event_start`, `event_end`, `event_precision`, all texts but the
confidence. Everything here is a column expression, so filters run inside the scan's stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D

# Fixed values.
KINDS = ["atemporal", "instantaneous", "time_bound", "ongoing", "unknown"]
PRECISIONS = ["exact", "day", "month", "year", "approximate", "unknown"]
EVENT_KINDS, EVENT_PRECISIONS = ["actual", "planned"], ["exact", "day", "month", "year"]
REVIEWED = ["active", "conflicted", "superseded"]
CURRENT_LABELS = ["atemporal", "current", "legacy_unknown", "ongoing_unknown_start", "unknown_valid_time"]
MODES = ["bitemporal", "current", "known", "timeline", "valid"]


def _kind() -> Column:
    return F.lower(F.coalesce(D.optional(F.col("temporal_kind")), F.lit("unknown")))


def effective_status() -> Column:
    return F.when(F.col("status") == "revision_closed", F.coalesce("revision_status", F.lit(""))).otherwise(F.coalesce("status", F.lit("")))


def stated_precision() -> Column:
    """The precision a fact states, else the one its first bound shows."""
    stated = F.lower(F.trim(F.coalesce("valid_time_precision", F.lit(""))))
    return F.when(stated.isin(PRECISIONS), stated).otherwise(D.precision(F.col("valid_from")))


def _instant_end(start: Column) -> Column:
    kind = D.let(stated_precision(), lambda p: F.when(p.isin("approximate", "unknown"), D.precision(F.col("valid_from"))).otherwise(p))
    return D.end_of(start, kind)


def _bounds() -> Column:
    """A fact's kind, its bounds as given and as read: (kind, from, to, start, end, whether a bound is given that is no date)."""
    given = F.struct(D.optional(F.col("valid_from")).alias("from"), D.optional(F.col("valid_to")).alias("to"), D.starts(F.col("valid_from")).alias("start"), D.starts(F.col("valid_to")).alias("end"), _kind().alias("kind"))
    return D.let(given, lambda g: g.withField("bad", (g["from"].isNotNull() & g["start"].isNull()) | (g["to"].isNotNull() & g["end"].isNull())))


def interval() -> tuple[Column, Column]:
    """(start, end) of facts of a kind that has them; an ongoing fact's end is null, and so is the start of a fact without an interval."""
    has = lambda b: b["start"].isNotNull() & (b["kind"].isin("instantaneous", "ongoing") | ((b["kind"] == "time_bound") & b["end"].isNotNull()))
    end = lambda b: F.when(has(b) & (b["kind"] == "instantaneous"), D.end_of(b["start"], stated_precision())).when(has(b) & (b["kind"] == "time_bound"), b["end"])
    return D.let(_bounds(), lambda b: F.when(has(b), b["start"])), D.let(_bounds(), end)


def valid_at(point: Column, knowledge_scoped: bool = False) -> Column:
    """Whether the half-open valid interval holds the point. With a knowledge clock beside it, what was superseded later counts."""
    state = effective_status() if knowledge_scoped else F.coalesce("status", F.lit(""))
    scoped = F.lit(knowledge_scoped)

    def holds(r):
        b, status, at = r["b"], r["status"], r["at"]
        kind, start, end = F.lower(F.coalesce("temporal_kind", F.lit("unknown"))), b["start"], b["end"]
        inside = (at >= start) & (end.isNull() | (at < end)) & ~((status == "superseded") & end.isNull() & ~scoped)
        by_kind = (
            F.when(kind == "atemporal", b["from"].isNull() & b["to"].isNull() & (scoped | status.isin("active", "conflicted")))
            .when(kind == "instantaneous", start.isNotNull() & end.isNull() & (at >= start) & (at < _instant_end(start)))
            .when(kind == "time_bound", start.isNotNull() & end.isNotNull() & inside)
            .when(kind == "ongoing", start.isNotNull() & end.isNull() & inside)
            .otherwise(F.lit(False))
        )
        return F.coalesce(at.isNotNull() & status.isin(REVIEWED) & ~b["bad"] & by_kind, F.lit(False))

    return D.let(F.struct(_bounds().alias("b"), state.alias("status"), point.alias("at")), holds)


def known_at(point: Column) -> Column:
    """Whether the fact was recorded by then and not yet closed."""
    dated = F.struct(effective_status().alias("status"), D.starts(F.col("created_at")).alias("created"), D.starts(F.col("knowledge_to")).alias("until"), point.alias("at"))

    def holds(r):
        ok = ((r["status"] == "") | r["status"].isin(REVIEWED)) & (D.optional(F.col("knowledge_to")).isNull() | r["until"].isNotNull())
        return F.coalesce(ok & (r["created"] <= r["at"]) & (r["until"].isNull() | (r["at"] < r["until"])), F.lit(False))

    return D.let(dated, holds)


def happens_in(value: Column, kind: Column | None = None) -> Column:
    """Whether the fact's event overlaps the interval of a date given as text, and is of the kind asked for."""
    asked = F.lower(F.trim(F.coalesce(kind if kind is not None else F.lit(""), F.lit(""))))
    wanted = (asked == "") | (asked.isin(EVENT_KINDS) & (asked == F.col("event_kind")))
    dated = F.struct(D.starts(F.col("event_start")).alias("first"), D.starts(F.col("event_end")).alias("last"), D.starts(value).alias("since"), (D.ends(value) + F.expr("interval 1 microsecond")).alias("upto"))

    def overlaps(r):
        first, last = r["first"], r["last"]
        bad = (D.optional(F.col("event_start")).isNotNull() & first.isNull()) | (D.optional(F.col("event_end")).isNotNull() & last.isNull())
        end = F.when(first.isNull(), D.end_of(last, F.col("event_precision"))).otherwise(F.coalesce(last, D.end_of(first, F.col("event_precision"))))
        ok = F.col("event_kind").isin(EVENT_KINDS) & F.col("event_precision").isin(EVENT_PRECISIONS) & wanted & ~bad & ~((first.isNotNull() & last.isNotNull()) & (last <= first))
        return F.coalesce(ok & (F.coalesce(first, last) < r["upto"]) & (r["since"] < end), F.lit(False))

    return D.let(dated, overlaps)


def currentness(point: Column) -> Column:
    """One of thirteen labels, the first that fits."""
    read = F.struct(_bounds().alias("b"), F.lower(F.trim(F.coalesce("status", F.lit("active")))).alias("status"), point.alias("at"))

    def label(r):
        b, status, at = r["b"], r["status"], r["at"]
        kind, start, end = b["kind"], b["start"], b["end"]
        dated = lambda upto: F.when(upto <= start, "invalid_valid_time").when(at < start, "future").when(at >= upto, "historical").otherwise("current")
        return (
            F.when(status == "superseded", "superseded").when(~status.isin("active", "conflicted"), "unreviewed").when(at.isNull(), "invalid_current_time").when(~kind.isin(KINDS), "invalid_temporal_kind")
            .when(kind == "atemporal", "atemporal").when((kind == "unknown") & F.col("temporal_confidence").isNull(), "legacy_unknown").when(kind == "unknown", "unknown_valid_time").when(b["bad"], "invalid_valid_time")
            .when((kind == "ongoing") & start.isNull() & end.isNull(), "ongoing_unknown_start").when((kind == "time_bound") & (start.isNull() | end.isNull()), "unknown_bounds").when((kind == "ongoing") & end.isNotNull(), "invalid_valid_time")
            .when(start.isNull(), "unknown_bounds").otherwise(D.let(F.when(kind == "instantaneous", _instant_end(start)).otherwise(end), dated))
        )

    return D.let(read, label)


def is_current(point: Column) -> Column:
    return currentness(point).isin(CURRENT_LABELS)


def request_error(mode: Column, valid: Column, known: Column, event: Column, event_kind: Column) -> Column:
    """What makes a request's clocks and mode disagree; null if nothing does."""
    return (
        F.when(mode.isNotNull() & ~mode.isin(MODES), "temporal_mode must be one of " + "|".join(MODES))
        .when((mode == "current") & (valid.isNotNull() | known.isNotNull()), "current temporal_mode does not accept as-of clocks")
        .when((mode == "valid") & known.isNotNull(), "valid temporal_mode does not accept known_as_of").when((mode == "known") & valid.isNotNull(), "known temporal_mode does not accept valid_as_of")
        .when((mode == "valid") & valid.isNull(), "valid temporal_mode requires valid_as_of").when((mode == "known") & known.isNull(), "known temporal_mode requires known_as_of")
        .when((mode == "bitemporal") & (valid.isNull() | known.isNull()), "bitemporal temporal_mode requires valid_as_of and known_as_of").when(event_kind.isNotNull() & event.isNull(), "event_kind requires event_as_of")
    )


def default_mode(valid: Column, known: Column) -> Column:
    """The mode that the given clocks mean."""
    return F.when(valid.isNotNull() & known.isNotNull(), "bitemporal").when(valid.isNotNull(), "valid").when(known.isNotNull(), "known").otherwise("current")


def requested(mode: str, valid: str | None = None, known: str | None = None, event: str | None = None, event_kind: str | None = None, now: str | None = None, fail_closed: bool = False) -> Column:
    """Whether a fact passes exactly the clocks that a request selects; a request that failed closed passes none."""
    if fail_closed:
        return F.lit(False)
    event_ok = happens_in(F.lit(event), F.lit(event_kind)) if event else F.lit(True)
    if mode == "current":
        return is_current(D.ends(F.lit(now))) & event_ok
    ok = event_ok
    if known:
        ok &= known_at(D.ends(F.lit(known)))
    if valid:
        ok &= valid_at(D.ends(F.lit(valid)), known is not None)
    if mode == "timeline":
        status = F.coalesce("status", F.lit(""))
        ok &= (status == "") | status.isin(REVIEWED)
    return ok


def timeline_order() -> list[Column]:
    """By the start of validity, else of the event; rows without a date come last, then end, recording and id."""
    first = D.let(D.starts(F.col("valid_from")), lambda s: F.when(s.isNotNull(), s).otherwise(D.starts(F.coalesce(D.optional(F.col("event_start")), D.optional(F.col("event_end"))))))
    last = F.when(D.starts(F.col("valid_from")).isNotNull(), D.starts(F.col("valid_to"))).otherwise(D.starts(F.col("event_end")))
    return [first.asc_nulls_last(), last.asc_nulls_last(), D.starts(F.col("created_at")).asc_nulls_last(), F.col("id").cast("string").asc()]


def safe_successors(facts: DataFrame, group: str, truth: str = "truth", sources: str = "sources") -> DataFrame:
    """(group, id) of facts that follow all others of their group: each other fact's interval ends before, and all are well dated and sure.

    A group is looked at by aggregates (the last two ends, the number of unfit facts), so a large one is no task of its own.
    """
    start, end = interval()
    sure = (F.col(truth) >= 0.8) & (F.coalesce("temporal_confidence", F.lit(0.0)) >= 0.8) & F.coalesce(F.col("valid_time_precision"), F.lit("unknown")).isin("exact", "day") & (F.col(sources) > 0)
    f = facts.select(group, "id", start.alias("s"), end.alias("e"), sure.alias("sure"))
    open_ended = F.coalesce((~F.col("sure") | F.col("s").isNull() | F.col("e").isNull()).cast("int"), F.lit(1))
    f = f.withColumn("unfit", open_ended)
    per = f.groupBy(group).agg(F.count("*").alias("n"), F.sum("unfit").alias("unfits"), F.max(F.struct("e", "id")).alias("last"))
    joined = f.join(per, group)
    second = joined.filter(F.col("id") != F.col("last.id")).groupBy(group).agg(F.max("e").alias("second"))
    joined = joined.join(second, group, "left").withColumn("before", F.when(F.col("id") == F.col("last.id"), F.col("second")).otherwise(F.col("last.e")))
    safe = F.col("sure") & F.col("s").isNotNull() & (F.col("n") > 1) & (F.col("unfits") - F.col("unfit") == 0) & (F.col("before") <= F.col("s"))
    return joined.filter(safe).select(group, "id")


def latest_per(df: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """The row of each group with the largest values of `by`, by one aggregate with partial maxima."""
    rest = [c for c in df.columns if c not in group and c not in by]
    top = df.groupBy(*group).agg(F.max(F.struct(*by, *rest)).alias("m"))
    return top.select(*group, *[F.col(f"m.`{c}`").alias(c) for c in [*by, *rest]])


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
