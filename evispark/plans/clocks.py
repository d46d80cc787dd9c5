"""Queries over facts under two clocks. Facts are made from orders by one statement that both engines read; the rules are written twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import clocks as C

QUERIES: dict = {}
ORACLES: dict = {}

_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_LATER = "CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL '{}' DAY AS DATE) AS STRING)"
FACTS = f"""SELECT o_orderkey AS id, o_custkey AS entity_id,
 CASE o_orderkey % 8 WHEN 0 THEN 'atemporal' WHEN 1 THEN 'instantaneous' WHEN 2 THEN 'time_bound' WHEN 3 THEN 'ongoing' WHEN 4 THEN 'unknown' WHEN 5 THEN 'time_bound' WHEN 6 THEN 'Instantaneous' ELSE 'other' END AS temporal_kind,
 CASE WHEN o_orderkey % 11 = 0 THEN 'open' WHEN o_orderkey % 11 = 1 THEN 'revision_closed' WHEN o_orderstatus = 'F' THEN 'active' WHEN o_orderstatus = 'O' THEN 'superseded' ELSE 'conflicted' END AS status,
 CASE WHEN o_orderkey % 2 = 0 THEN 'active' ELSE 'rejected' END AS revision_status,
 CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN substr({_DAY}, 1, 4) WHEN 2 THEN substr({_DAY}, 1, 7) WHEN 3 THEN {_DAY} || 'T10:00:00' WHEN 4 THEN '1995-02-30' WHEN 5 THEN {_DAY} || 'T10:00:00Z' WHEN 6 THEN {_DAY} || 'T10:00:00+02:00' WHEN 7 THEN ' ' ELSE {_DAY} END AS valid_from,
 CASE WHEN o_orderkey % 8 IN (2, 5) AND o_orderkey % 9 > 0 THEN {_LATER.format(30)} WHEN o_orderkey % 40 = 3 THEN substr({_DAY}, 1, 7) WHEN o_orderkey % 32 = 0 THEN 'soon' END AS valid_to,
 CASE o_orderkey % 6 WHEN 0 THEN 'day' WHEN 1 THEN 'approximate' WHEN 2 THEN 'bogus' WHEN 3 THEN 'day' END AS valid_time_precision,
 CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE CAST(0.9 AS DOUBLE) END AS temporal_confidence, CAST(0.95 AS DOUBLE) AS truth, 1 AS sources,
 {_DAY} || 'T00:00:00Z' AS created_at, CASE o_orderkey % 4 WHEN 0 THEN {_LATER.format(200)} || 'T00:00:00Z' WHEN 1 THEN NULL WHEN 2 THEN {_LATER.format(900)} ELSE NULL END AS knowledge_to,
 CASE o_orderkey % 5 WHEN 0 THEN 'actual' WHEN 1 THEN 'planned' WHEN 2 THEN 'bogus' END AS event_kind,
 CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN substr({_DAY}, 1, 7) ELSE {_DAY} END AS event_start, CASE o_orderkey % 7 WHEN 0 THEN {_DAY} WHEN 2 THEN {_LATER.format(10)} WHEN 3 THEN '1992-01-01' END AS event_end,
 CASE o_orderkey % 7 WHEN 1 THEN 'month' WHEN 4 THEN 'sometime' ELSE 'day' END AS event_precision
 FROM {{orders}}"""


def facts(spark, sf_dir):
    return spark.sql(FACTS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


# --- the rules in the other engine's words ---


def _opt(x):
    return f"nullif(trim({x}, ' '), '')"


def _prec(x):
    return f"CASE WHEN {_opt(x)} IS NULL THEN 'unknown' WHEN regexp_full_match({_opt(x)}, '[0-9]{{4}}') THEN 'year' WHEN regexp_full_match({_opt(x)}, '[0-9]{{4}}-[0-9]{{2}}') THEN 'month' WHEN regexp_full_match({_opt(x)}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'day' ELSE 'exact' END"


def _start(x):
    t = _opt(x)
    return f"CASE ({_prec(x)}) WHEN 'year' THEN TRY_CAST({t} || '-01-01' AS TIMESTAMP) WHEN 'month' THEN TRY_CAST({t} || '-01' AS TIMESTAMP) WHEN 'day' THEN TRY_CAST({t} AS TIMESTAMP) WHEN 'exact' THEN CASE WHEN regexp_matches({t}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN TRY_CAST({t} AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END END"


def _until(start, prec):
    return f"CASE {prec} WHEN 'year' THEN date_trunc('year', {start}) + INTERVAL 1 YEAR + ({start} - date_trunc('day', {start})) WHEN 'month' THEN date_trunc('month', {start}) + INTERVAL 1 MONTH + ({start} - date_trunc('day', {start})) WHEN 'day' THEN {start} + INTERVAL 1 DAY ELSE {start} + INTERVAL 1 MICROSECOND END"


_F = FACTS.replace("{orders}", "orders")
_P = f"""WITH f AS ({_F}), p AS (SELECT *, lower(temporal_kind) AS kind, {_start('valid_from')} AS s, {_start('valid_to')} AS e, {_prec('valid_from')} AS fp, {_opt('valid_from')} IS NOT NULL AS has_s, {_opt('valid_to')} IS NOT NULL AS has_e,
 {_start('created_at')} AS made, {_start('knowledge_to')} AS until, {_start('event_start')} AS es, {_start('event_end')} AS ee, CASE WHEN status = 'revision_closed' THEN revision_status ELSE status END AS eff FROM f),
q AS (SELECT *, CASE WHEN valid_time_precision IN ('exact','day','month','year','approximate','unknown') THEN valid_time_precision ELSE fp END AS sp FROM p),
r AS (SELECT *, {_until('s', "(CASE WHEN sp IN ('approximate','unknown') THEN fp ELSE sp END)")} AS inst, {_until('s', 'sp')} AS stated, (has_s AND s IS NULL) OR (has_e AND e IS NULL) AS bad FROM q)"""
_POINT = "TIMESTAMP '1995-06-30 23:59:59.999999'"


def _valid(status, scoped):
    return f"""coalesce({status} IN ('active','conflicted','superseded') AND NOT bad AND CASE kind WHEN 'atemporal' THEN NOT has_s AND NOT has_e AND ({scoped} OR {status} IN ('active','conflicted'))
 WHEN 'instantaneous' THEN s IS NOT NULL AND e IS NULL AND s <= {_POINT} AND {_POINT} < inst
 WHEN 'time_bound' THEN s IS NOT NULL AND e IS NOT NULL AND s <= {_POINT} AND {_POINT} < e
 WHEN 'ongoing' THEN s IS NOT NULL AND e IS NULL AND s <= {_POINT} AND ({scoped} OR {status} <> 'superseded') ELSE false END, false)"""


_KNOWN = f"coalesce(eff IN ('','active','conflicted','superseded') AND (knowledge_to IS NULL OR until IS NOT NULL) AND made <= {_POINT} AND (until IS NULL OR {_POINT} < until), false)"
_EVENT = f"""coalesce(event_kind = 'actual' AND event_precision IN ('exact','day','month','year') AND NOT ((event_start IS NOT NULL AND es IS NULL) OR (event_end IS NOT NULL AND ee IS NULL)) AND NOT coalesce(ee <= es, false)
 AND coalesce(es, ee) < TIMESTAMP '1995-07-01' AND TIMESTAMP '1995-06-01' < CASE WHEN es IS NULL THEN {_until('ee', 'event_precision')} ELSE coalesce(ee, {_until('es', 'event_precision')}) END, false)"""
_LABEL = f"""CASE WHEN status = 'superseded' THEN 'superseded' WHEN status NOT IN ('active','conflicted') THEN 'unreviewed' WHEN kind NOT IN ('atemporal','instantaneous','time_bound','ongoing','unknown') THEN 'invalid_temporal_kind'
 WHEN kind = 'atemporal' THEN 'atemporal' WHEN kind = 'unknown' THEN CASE WHEN temporal_confidence IS NULL THEN 'legacy_unknown' ELSE 'unknown_valid_time' END WHEN bad THEN 'invalid_valid_time'
 WHEN kind = 'ongoing' AND e IS NOT NULL THEN 'invalid_valid_time' WHEN kind = 'ongoing' AND s IS NULL THEN 'ongoing_unknown_start' WHEN s IS NULL OR (kind = 'time_bound' AND e IS NULL) THEN 'unknown_bounds'
 WHEN CASE WHEN kind = 'instantaneous' THEN inst ELSE e END <= s THEN 'invalid_valid_time' WHEN {_POINT} < s THEN 'future' WHEN {_POINT} >= CASE WHEN kind = 'instantaneous' THEN inst ELSE e END THEN 'historical' ELSE 'current' END"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _point():
    return D.ends(F.lit("1995-06"))


@query(f"{_P} SELECT id, valid_from, fp AS stated, s AS first_instant, CASE fp WHEN 'exact' THEN s ELSE {_until('s', 'fp')} - INTERVAL 1 MICROSECOND END AS last_instant, {_until('s', 'fp')} AS after FROM r")
def partial_dates(spark, sf_dir):
    """Partial dates with their precision, first and last instant and the instant after."""
    v = F.col("valid_from")
    return facts(spark, sf_dir).select("id", "valid_from", D.precision(v).alias("stated"), D.starts(v).alias("first_instant"), D.ends(v).alias("last_instant"), D.end_of(D.starts(v), D.precision(v)).alias("after"))


@query(f"{_P} SELECT id, s AS starts_at, CASE kind WHEN 'instantaneous' THEN stated WHEN 'time_bound' THEN e END AS ends_at FROM r WHERE s IS NOT NULL AND (kind IN ('instantaneous','ongoing') OR kind = 'time_bound' AND e IS NOT NULL)")
def fact_intervals(spark, sf_dir):
    start, end = C.interval()
    return facts(spark, sf_dir).select("id", start.alias("starts_at"), end.alias("ends_at")).filter("starts_at is not null")


@query(f"{_P} SELECT id, {_LABEL} AS label FROM r")
def fact_currentness(spark, sf_dir):
    """The label of every fact at the end of a month."""
    return facts(spark, sf_dir).select("id", C.currentness(_point()).alias("label"))


@query(f"{_P} SELECT id FROM r WHERE {_LABEL} IN ('atemporal','current','legacy_unknown','ongoing_unknown_start','unknown_valid_time')")
def current_facts(spark, sf_dir):
    return facts(spark, sf_dir).filter(C.is_current(_point())).select("id")


@query(f"{_P} SELECT id, {_valid('status', 'false')} AS valid, {_valid('eff', 'true')} AS valid_as_known FROM r")
def valid_time_matches(spark, sf_dir):
    return facts(spark, sf_dir).select("id", C.valid_at(_point()).alias("valid"), C.valid_at(_point(), True).alias("valid_as_known"))


@query(f"{_P} SELECT id, {_KNOWN} AS known FROM r")
def knowledge_time_matches(spark, sf_dir):
    return facts(spark, sf_dir).select("id", C.known_at(_point()).alias("known"))


@query(f"{_P} SELECT id, {_EVENT} AS happens FROM r")
def event_time_matches(spark, sf_dir):
    return facts(spark, sf_dir).select("id", C.happens_in(F.lit("1995-06"), F.lit("actual")).alias("happens"))


@query(f"""{_P} SELECT id, {_KNOWN} AND {_valid('eff', 'true')} AS bitemporal, {_valid('status', 'false')} AND {_EVENT} AS valid_mode, {_KNOWN} AS known_mode, status IN ('active','conflicted','superseded') AND {_KNOWN} AS timeline,
 {_LABEL} IN ('atemporal','current','legacy_unknown','ongoing_unknown_start','unknown_valid_time') AND {_EVENT} AS current_mode, false AS closed FROM r""")
def temporal_requests(spark, sf_dir):
    """Facts under requests of each mode."""
    t = "1995-06"
    modes = {
        "bitemporal": C.requested("bitemporal", t, t), "valid_mode": C.requested("valid", valid=t, event=t, event_kind="actual"), "known_mode": C.requested("known", known=t), "timeline": C.requested("timeline", known=t),
        "current_mode": C.requested("current", event=t, event_kind="actual", now=t), "closed": C.requested("current", now=t, fail_closed=True),
    }
    return facts(spark, sf_dir).select("id", *[c.alias(n) for n, c in modes.items()])


_REQUESTS = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'current' WHEN 2 THEN 'valid' WHEN 3 THEN 'known' WHEN 4 THEN 'bitemporal' WHEN 5 THEN 'timeline' ELSE 'never' END AS mode,
 CASE WHEN event_id % 3 = 0 THEN '1995' END AS valid, CASE WHEN event_id % 2 = 0 THEN '1996' END AS known, CASE WHEN event_id % 5 = 0 THEN '1997' END AS event, CASE WHEN event_id % 4 = 0 THEN 'actual' END AS kind FROM {events}"""


@query(f"""WITH r AS ({_REQUESTS.replace('{events}', 'events')}), m AS (SELECT *, coalesce(mode, CASE WHEN valid IS NOT NULL AND known IS NOT NULL THEN 'bitemporal' WHEN valid IS NOT NULL THEN 'valid' WHEN known IS NOT NULL THEN 'known' ELSE 'current' END) AS m FROM r)
SELECT event_id, m AS mode, CASE WHEN m = 'never' THEN 'temporal_mode must be one of bitemporal|current|known|timeline|valid' WHEN m = 'current' AND coalesce(valid, known) IS NOT NULL THEN 'current temporal_mode does not accept as-of clocks'
 WHEN m IN ('valid', 'known') AND CASE m WHEN 'valid' THEN known ELSE valid END IS NOT NULL THEN m || ' temporal_mode does not accept ' || CASE m WHEN 'valid' THEN 'known' ELSE 'valid' END || '_as_of'
 WHEN m IN ('valid', 'known') AND CASE m WHEN 'valid' THEN valid ELSE known END IS NULL THEN m || ' temporal_mode requires ' || m || '_as_of' WHEN m = 'bitemporal' AND (valid IS NULL OR known IS NULL) THEN 'bitemporal temporal_mode requires valid_as_of and known_as_of'
 WHEN kind IS NOT NULL AND event IS NULL THEN 'event_kind requires event_as_of' END AS problem FROM m""")
def temporal_request_errors(spark, sf_dir):
    """Requests with the mode they mean and what is wrong with them."""
    r = spark.sql(_REQUESTS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    r = r.withColumn("mode", F.coalesce("mode", C.default_mode(F.col("valid"), F.col("known"))))
    return r.select("event_id", "mode", C.request_error(*[F.col(c) for c in ("mode", "valid", "known", "event", "kind")]).alias("problem"))


@query(f"""{_P}, o AS (SELECT id, entity_id, CASE WHEN s IS NOT NULL THEN s ELSE coalesce(es, ee) END AS a, CASE WHEN s IS NOT NULL THEN e ELSE ee END AS b, made FROM r)
SELECT id, entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY a ASC NULLS LAST, b ASC NULLS LAST, made ASC NULLS LAST, CAST(id AS VARCHAR)) AS place FROM o""")
def timeline_places(spark, sf_dir):
    """The place of each fact in its entity's timeline; undated facts last."""
    return C.numbered(facts(spark, sf_dir), ["entity_id"], C.timeline_order()).select("id", "entity_id", "place")


_SURE = "(SELECT id, entity_id % 4000 AS entity_id, 'time_bound' AS temporal_kind, valid_from, CASE WHEN id % 3 = 0 THEN valid_to ELSE valid_from END AS valid_to, CASE WHEN id % 50 = 0 THEN 'month' ELSE 'day' END AS valid_time_precision, CAST(0.9 AS DOUBLE) AS temporal_confidence, truth, sources FROM ({facts}) x WHERE valid_from IS NOT NULL)"


@query(f"""WITH f AS {_SURE.format(facts=_F)}, i AS (SELECT id, entity_id, {_start('valid_from')} AS s, {_start('valid_to')} AS e, valid_time_precision = 'day' AS sure FROM f),
j AS (SELECT id, entity_id, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN s END AS s, CASE WHEN s IS NOT NULL THEN e END AS e, sure FROM i)
SELECT a.entity_id, a.id FROM j a JOIN j b ON a.entity_id = b.entity_id AND a.id <> b.id WHERE a.sure AND a.s IS NOT NULL GROUP BY a.entity_id, a.id, a.s HAVING bool_and(coalesce(b.sure AND b.e <= a.s, false))""")
def safe_successors(spark, sf_dir):
    """Facts that may follow all others of their entity."""
    f = spark.sql(f"SELECT * FROM {_SURE.format(facts=FACTS)} y", orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return C.safe_successors(f, "entity_id")


@query(f"""{_P} SELECT entity_id, arg_max(id, (created_at, id)) AS id, max(created_at) AS created_at FROM r WHERE status <> 'open' GROUP BY entity_id""")
def latest_decisions(spark, sf_dir):
    """The newest reviewed fact of each entity."""
    f = facts(spark, sf_dir).filter("status <> 'open'").select("entity_id", "created_at", "id")
    return C.latest_per(f, ["entity_id"], ["created_at", "id"])


@query("""SELECT event_id, strftime(to_timestamp(m) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || CASE WHEN f > 0 THEN '.' || lpad(CAST(f AS VARCHAR), 3, '0') || '000' ELSE '' END || '+00:00' AS at_iso,
 TRY_CAST(CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d') END AS TIMESTAMP) AS parsed FROM (SELECT *, event_id * 86400 AS m, event_id % 1000 AS f FROM events)""")
def iso_times(spark, sf_dir):
    """Epoch milliseconds as ISO text, and texts without an offset as UTC."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    millis = F.col("event_id") * 86_400_000 + F.col("event_id") % 1000
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", D.iso(D.from_millis(millis)).alias("at_iso"), D.lenient(text).alias("parsed"))


@query("""WITH l AS (SELECT doc_id, quality, toxic, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' WHEN 2 THEN '1.5' ELSE '0.5' END AS c FROM labels)
SELECT doc_id, CASE WHEN toxic = 0 THEN 1.0 ELSE quality / toxic END AS share, CASE WHEN c IS NULL THEN 'missing truth' WHEN TRY_CAST(c AS DOUBLE) IS NULL THEN 'truth must be a number between 0 and 1' WHEN CAST(c AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'truth must be between 0 and 1' END AS problem,
 greatest(nullif(quality, 0), nullif(toxic, 0)) AS larger, doc_id % 50 - least(doc_id % 50, doc_id % 20) AS uncached FROM l""")
def checked_values(spark, sf_dir):
    """Ratios of nothing, faulty confidences, the larger of two values that may be null, usage beyond the cache."""
    text = F.when(F.col("doc_id") % 4 == 1, "x").when(F.col("doc_id") % 4 == 2, "1.5").when(F.col("doc_id") % 4 == 3, "0.5")
    larger = F.greatest(F.nullif(F.col("quality"), F.lit(0)), F.nullif(F.col("toxic"), F.lit(0)))
    uncached = F.col("doc_id") % 50 - F.least(F.col("doc_id") % 50, F.col("doc_id") % 20)
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", D.ratio(F.col("quality"), F.col("toxic")).alias("share"), D.confidence_error(text, "truth").alias("problem"), larger.alias("larger"), uncached.alias("uncached"))


@query("""SELECT conv_id, turn, substr(sha256('["' || conv_id || '","' || turn || '","' || coalesce(role, '') || '"]'), 1, 32) AS id, list_aggregate(u, 'string_agg', '|') AS merged FROM (SELECT conv_id, turn, role,
 list_filter([x FOR x, i IN w IF i = list_position(w, x)], lambda x: x <> '') AS u FROM (SELECT conv_id, turn, role, list_concat([role, '', CAST(turn % 3 AS VARCHAR)], [CAST(conv_id % 3 AS VARCHAR), role]) AS w FROM conversations)) z""")
def canonical_ids(spark, sf_dir):
    """Ids hashed from what names a row, and lists merged in order."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = lambda x: x.cast("string")
    merged = D.ordered_union(F.array("role", F.lit(""), text(F.col("turn") % 3)), F.array(text(F.col("conv_id") % 3), F.col("role")), F.lit(None).cast("array<string>"))
    return c.select("conv_id", "turn", D.canonical_id(F.col("conv_id"), F.col("turn"), F.col("role")).alias("id"), F.array_join(merged, "|").alias("merged"))
