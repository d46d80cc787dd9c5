"""Queries over queues, ledgers and curated facts, with SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import queues as Q

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark, sf_dir, text, *tables):
    return spark.sql(text, **{t: _read(spark, sf_dir, t) for t in tables})


def _plain(text):
    return text.replace("{", "").replace("}", "")


def _now():
    return F.lit("1997-01-01").cast("timestamp")

_T = "TIMESTAMP '1997-01-01'"
_QUEUE = """SELECT o_custkey AS item, o_orderkey AS revision, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'pending' END AS state, o_orderdate AS available_at, o_orderdate + INTERVAL '1' DAY AS lease_until, CAST(o_orderkey % 25 AS INT) AS attempts FROM {orders}"""


@query(f"""SELECT item, revision, 'processing' AS state, {_T} + INTERVAL 300 SECOND AS lease_until, attempts + 1 AS attempts FROM ({_plain(_QUEUE)}) WHERE (state = 'pending' AND available_at <= {_T}) OR (state = 'processing' AND lease_until <= {_T}) ORDER BY available_at, revision LIMIT 100""")
def queue_lease(spark, sf_dir):
    return Q.lease(_sql(spark, sf_dir, _QUEUE, "orders"), _now(), ["available_at", "revision"], 100).select("item", "revision", "state", "lease_until", "attempts")


@query(f"""WITH q AS ({_plain(_QUEUE)}) SELECT item, revision, CASE WHEN revision < max(revision) OVER (PARTITION BY item) THEN 'superseded' WHEN revision % 3 = 0 THEN 'completed' WHEN revision % 3 = 1 THEN 'deferred' ELSE state END AS state,
 CASE WHEN revision = max(revision) OVER (PARTITION BY item) AND revision % 3 = 1 THEN {_T} + to_seconds(CAST(least(86400, 60 * (1 << least(attempts, 20))) AS BIGINT)) ELSE available_at END AS available_at FROM q""")
def queue_settle(spark, sf_dir):
    q = _sql(spark, sf_dir, _QUEUE, "orders")
    results = q.filter("revision % 3 < 2").select("item", "revision", (F.col("revision") % 3 == 0).alias("ok"))
    return Q.settle(q, results, "item", "revision", _now())


@query("SELECT event_id, CAST(least(3600, 30 * pow(2, least(event_id % 40, 20))) AS BIGINT) AS wait FROM events")
def retry_backoff(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", Q.backoff(F.col("event_id") % 40, 30, 3600).alias("wait"))


_ASKED = "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'truth' ELSE event_type END AS kind, CASE WHEN event_id % 4 = 0 THEN 'closed' ELSE 'open' END AS status, ts AS due, event_id AS made FROM {events}"


@query(f"SELECT event_id, kind, 'timeout_resolved' AS status FROM ({_plain(_ASKED)}) WHERE status = 'open' AND due <= TIMESTAMP '2024-01-10' AND kind <> 'truth' ORDER BY due, made LIMIT 200")
def timeout_sweep(spark, sf_dir):
    return Q.sweep(_sql(spark, sf_dir, _ASKED, "events"), F.lit("2024-01-10").cast("timestamp"), "due", "made", 200, ["truth"]).select("event_id", "kind", "status")


_REV = "SELECT event_id, user_id, value, event_id % 7 = 0 AS removed, value < 5 AS broken FROM {events}"


@query(f"""WITH r AS ({_plain(_REV)}), t AS (SELECT user_id, max((value, event_id)) AS top FROM r WHERE NOT broken GROUP BY user_id)
SELECT event_id, CASE WHEN broken OR (value, event_id) <> top THEN 'superseded' WHEN removed THEN 'deleted' ELSE 'active' END AS status FROM r LEFT JOIN t USING (user_id)""")
def revision_status(spark, sf_dir):
    """Of each user the valid row of the highest rank is active or deleted, all others superseded."""
    return Q.newest_only(_sql(spark, sf_dir, _REV, "events"), ["user_id"], ["value", "event_id"], "removed", "broken").select("event_id", "status")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0)")
def remaining_work(spark, sf_dir):
    """Documents without a terminal row; labels stand for rows of earlier runs."""
    done = _read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 0, "completed").otherwise("running").alias("state"))
    return Q.remaining_work(_read(spark, sf_dir, "documents").select("doc_id"), done, ["doc_id"])


@query("""WITH RECURSIVE d AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars % 1000, doc_id) AS k FROM documents QUALIFY k <= 300),
w AS (SELECT k, doc_id, n_chars AS used, true AS taken FROM d WHERE k = 1 UNION ALL SELECT d.k, d.doc_id, CASE WHEN w.used + d.n_chars <= 60000 THEN w.used + d.n_chars ELSE w.used END, w.used + d.n_chars <= 60000 FROM w JOIN d ON d.k = w.k + 1)
SELECT doc_id FROM w WHERE taken""")
def admitted_changes(spark, sf_dir):
    """Which of 300 changed documents a run takes under 60,000 characters."""
    d = _read(spark, sf_dir, "documents").select((F.col("n_chars") % 1000).alias("turn"), "doc_id", "n_chars")
    return Q.admitted_changes(d, ["turn", "doc_id"], "n_chars", 300, 60_000).select("doc_id")


@query("""SELECT e.event_id, round(coalesce(s.used, 0), 4) AS used, round(coalesce(s.used, 0), 4) + e.value <= 500 AS admitted FROM events e LEFT JOIN (SELECT date_trunc('day', ts) AS day, event_type, round(sum(value), 4) AS used FROM events WHERE event_id % 10 < 3 GROUP BY 1, 2) s
 ON s.day = date_trunc('day', e.ts) AND s.event_type = e.event_type WHERE e.event_id % 10 = 9""")
def daily_budget(spark, sf_dir):
    e = _read(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    out = Q.daily_budget(e.filter("event_id % 10 < 3"), e.filter("event_id % 10 = 9"), "day", "event_type", "value", 500.0).withColumn("used", F.round("used", 4))
    return out.select("event_id", "used", (F.col("used") + F.col("value") <= 500).alias("admitted"))


_REFS = "SELECT CAST(get_json_object(props, '$.k') AS BIGINT) AS target, CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS session, ts, value / 100 AS weight, event_id FROM {events}"
_REFS_SQL = "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS target, CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS session, ts, value / 100 AS weight, event_id FROM events"


@query(f"SELECT target, session, event_id FROM ({_REFS_SQL}) WHERE session IS NULL UNION ALL SELECT target, session, arg_min(event_id, (ts, weight, event_id)) FROM ({_REFS_SQL}) WHERE session IS NOT NULL GROUP BY target, session")
def session_references(spark, sf_dir):
    """One reference of each target and session."""
    return Q.first_per_session(_sql(spark, sf_dir, _REFS, "events"), ["target"], "session", "ts").select("target", "session", "event_id")


@query(f"""WITH one AS (SELECT target, session, ts, weight FROM ({_REFS_SQL}) WHERE session IS NULL UNION ALL SELECT target, session, min(ts), arg_min(weight, (ts, weight, event_id)) FROM ({_REFS_SQL}) WHERE session IS NOT NULL GROUP BY target, session)
SELECT target, round(least(2, greatest(-2, sum(weight / 20 * pow(0.5, greatest(0, date_diff('day', CAST(ts AS DATE), DATE '2024-01-15')) / 90.0)))), 6) AS boost FROM one GROUP BY target""")
def lineage_boost(spark, sf_dir):
    """Decayed references of each target, one a session; later ones than today count in full."""
    refs = Q.first_per_session(_sql(spark, sf_dir, _REFS, "events"), ["target"], "session", "ts").withColumn("weight", F.col("weight") / 20)
    return Q.decayed(refs, ["target"], "weight", F.datediff(F.lit("2024-01-15").cast("date"), F.col("ts").cast("date")).cast("double"))


@query(f"SELECT o_orderkey FROM orders WHERE o_orderdate >= {_T} - INTERVAL 90 DAY")
def unexpired_snapshots(spark, sf_dir):
    return Q.unexpired(_read(spark, sf_dir, "orders"), "o_orderdate", _now(), 90).select("o_orderkey")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 9 IN (0, 1) THEN 'unavailable' WHEN o_orderkey % 5 <> 2 THEN 'partial' WHEN o_orderdate < {_T} - INTERVAL 48 HOUR THEN 'partial' ELSE 'complete' END AS freshness FROM orders""")
def source_freshness(spark, sf_dir):
    state = F.when(F.col("o_orderkey") % 9 == 0, F.lit(None)).when(F.col("o_orderkey") % 9 == 1, "never_run").otherwise("done")
    return _read(spark, sf_dir, "orders").select("o_orderkey", Q.freshness(state, F.col("o_orderdate"), F.col("o_orderkey") % 5, F.lit(2), _now(), 48).alias("freshness"))


_WRITES = "SELECT event_id AS write_id, user_id AS k, CAST(event_id % 3 AS BIGINT) AS expected, event_type AS value FROM {events} WHERE event_id % 4 = 1"


@query(f"""WITH h AS (SELECT user_id AS k, count(*) % 3 AS g, min(event_type) AS value FROM events WHERE event_id % 4 = 0 GROUP BY user_id), w AS ({_plain(_WRITES)}),
j AS (SELECT w.*, coalesce(h.g, 0) AS g, h.value AS was, expected = coalesce(h.g, 0) AS fits FROM w LEFT JOIN h ON h.k = w.k), o AS (SELECT *, min(CASE WHEN fits THEN write_id END) OVER (PARTITION BY k) AS winner FROM j)
SELECT k, write_id, g + CASE WHEN write_id = winner THEN 1 ELSE 0 END AS generation, CASE WHEN write_id = winner THEN value ELSE was END AS value, coalesce(write_id = winner, false) AS accepted FROM o""")
def ledger_writes(spark, sf_dir):
    """Writes that name the generation they follow."""
    heads = _read(spark, sf_dir, "events").filter("event_id % 4 = 0").groupBy(F.col("user_id").alias("k")).agg((F.count("*") % 3).alias("generation"), F.min("event_type").alias("value"))
    return Q.compare_and_set(heads, _sql(spark, sf_dir, _WRITES, "events"), "k")


@query("""SELECT key, origins, contents FROM (SELECT n_chars AS key, count(DISTINCT source) AS origins, count(DISTINCT md5(text)) AS contents FROM documents GROUP BY 1) WHERE origins > 1""")
def mirror_differences(spark, sf_dir):
    """Keys that several origins have; documents of one length stand for one key."""
    d = _read(spark, sf_dir, "documents").select(F.col("n_chars").alias("key"), "source", F.md5(F.col("text").cast("binary")).alias("h"))
    return Q.mirror_diff(d, "key", "source", "h")


@query("""SELECT x.id, 'stale' AS side FROM (SELECT DISTINCT vec_id * 3 AS id FROM embeddings) x WHERE id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id NOT IN (SELECT vec_id * 3 FROM embeddings)""")
def index_differences(spark, sf_dir):
    """Ids of an index without a document, and documents that it lacks."""
    have = _read(spark, sf_dir, "embeddings").select((F.col("vec_id") * 3).alias("id"))
    return Q.two_way_difference(have, _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id")


@query("""SELECT doc_id, h, n AS members, lo AS "first", hi AS "last" FROM (SELECT doc_id, md5(text) AS h, count(*) OVER w AS n, min(doc_id) OVER w AS lo, max(doc_id) OVER w AS hi FROM documents WINDOW w AS (PARTITION BY md5(text))) WHERE n > 1""")
def contested_groups(spark, sf_dir):
    """Documents that others contest, with their group."""
    return Q.counterparts(_read(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h")), "doc_id", "h")


_FACTS = "SELECT o_orderkey AS id, 'p' || CAST(o_custkey % 300 AS STRING) AS page, 's' || CAST(o_orderkey % 4 AS STRING) AS section, CASE WHEN o_orderstatus = 'F' THEN 'active' ELSE 'superseded' END AS status, o_orderdate AS observed FROM {orders}"
_ROW = "CAST(('0x' || substr(sha256(CAST(id AS VARCHAR) || '|' || section), 1, 12)) AS BIGINT)"


@query(f"""WITH f AS ({_plain(_FACTS)}), h AS (SELECT page, CAST(sum({_ROW}) AS VARCHAR) AS state, max(observed) AS newest FROM f WHERE status = 'active' GROUP BY page),
o AS (SELECT page, CAST(sum({_ROW}) AS VARCHAR) AS state FROM f WHERE status = 'active' AND id % 500 <> 7 AND page <> 'p9' GROUP BY page)
SELECT page, newest FROM h LEFT JOIN o USING (page) WHERE o.state IS NULL OR o.state <> h.state ORDER BY newest DESC, page LIMIT 40""")
def stale_syntheses(spark, sf_dir):
    """Pages whose facts have changed since their text was made."""
    f = _sql(spark, sf_dir, _FACTS, "orders")
    old = Q.state_hash(f.filter("status = 'active' and id % 500 <> 7 and page <> 'p9'"), "page", ["id", "section"])
    return Q.stale_pages(f, old, "page", ["id", "section"], "observed", 40)


_MOVES = "SELECT 'p' || CAST(c_custkey AS STRING) AS from_page, 'p' || CAST(c_custkey + 1 AS STRING) AS to_page FROM {customer} WHERE c_custkey < 50 AND c_custkey % 10 <> 0"


@query(f"""WITH RECURSIVE m AS ({_plain(_MOVES)}), r AS (SELECT from_page, to_page, 1 AS n FROM m UNION ALL SELECT r.from_page, m.to_page, n + 1 FROM r JOIN m ON m.from_page = r.to_page), l AS (SELECT from_page, arg_max(to_page, n) AS to_page FROM r GROUP BY 1)
SELECT id, coalesce(l.to_page, f.page) AS page, l.to_page IS NOT NULL AS changed FROM ({_plain(_FACTS)}) f LEFT JOIN l ON l.from_page = f.page""")
def page_moves(spark, sf_dir):
    """Facts after merges and renames of pages, followed to the end."""
    return Q.moved(_sql(spark, sf_dir, _FACTS, "orders"), _sql(spark, sf_dir, _MOVES, "customer"), "page").select("id", "page", "changed")


@query(f"""WITH f AS ({_plain(_FACTS)}), c AS (SELECT page, section, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) >= 12), w AS (SELECT page FROM c GROUP BY page HAVING count(*) > 1)
SELECT id, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.page = f.page AND c.section = f.section) AND f.page IN (SELECT page FROM w) THEN page || '/' || section ELSE page END AS new_page FROM f""")
def page_splits(spark, sf_dir):
    return Q.split_by_section(_sql(spark, sf_dir, _FACTS, "orders"), "page", "section", 12).select("id", "new_page")


@query(f"""SELECT 'p' || c_custkey AS page FROM customer WHERE c_custkey % 2 = 0 AND 'p' || c_custkey NOT IN (SELECT page FROM ({_plain(_FACTS)}) WHERE status = 'active')""")
def orphan_pages(spark, sf_dir):
    pages = _read(spark, sf_dir, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("page"), (F.col("c_custkey") % 2 == 0).alias("managed"))
    return Q.orphans(pages, _sql(spark, sf_dir, _FACTS, "orders"), "page").select("page")


_ROUTES = "SELECT l_orderkey AS item, 'p' || CAST(l_suppkey AS STRING) AS page, max(l_discount) AS overlap, count(*) AS siblings FROM {lineitem} WHERE l_discount <> 0.01 GROUP BY l_orderkey, l_suppkey"


@query(f"""SELECT item, page, round(5 * overlap + least(8, siblings), 6) AS score, row_number() OVER (PARTITION BY item ORDER BY round(5 * overlap + least(8, siblings), 6) DESC, siblings DESC, page DESC) AS place FROM ({_plain(_ROUTES)}) QUALIFY place <= 2""")
def route_targets(spark, sf_dir):
    return Q.ranked_routes(_sql(spark, sf_dir, _ROUTES, "lineitem"), "item", 2).select("item", "page", "score", "place")


_RELATIONS = "SELECT user_id, CASE event_id % 9 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'updates' WHEN 2 THEN 'refines' WHEN 3 THEN 'supports' WHEN 4 THEN 'duplicate' WHEN 5 THEN 'complementary' ELSE 'unrelated' END AS relation, round(0.65 + value / 400, 4) AS confidence FROM {events} WHERE event_id % 19 = 3"


@query(f"""WITH r AS (SELECT *, list_position(['updates','refines','supports','duplicate','complementary','unrelated'], relation) AS p FROM ({_plain(_RELATIONS)}))
SELECT user_id, CASE WHEN bool_or(relation = 'contradicts') THEN 'contradicts' WHEN min(confidence) < 0.7 THEN 'unsure' ELSE arg_min(relation, (p, -confidence)) END AS outcome,
 CASE WHEN bool_or(relation = 'contradicts') THEN max(confidence) FILTER (relation = 'contradicts') WHEN min(confidence) < 0.7 THEN min(confidence) ELSE arg_min(confidence, (p, -confidence)) END AS confidence FROM r GROUP BY user_id""")
def queue_triage(spark, sf_dir):
    return Q.triage(_sql(spark, sf_dir, _RELATIONS, "events"), "user_id")


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('h' || doc_id), doc_id) AS place FROM documents QUALIFY place <= 20")
def stratified_sample(spark, sf_dir):
    return Q.stratified(_read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 20, "h")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def uncited_chunks(spark, sf_dir):
    """Documents that no label cites."""
    return Q.coverage_gap(_read(spark, sf_dir, "documents").select("doc_id"), _read(spark, sf_dir, "labels"), "doc_id")


_SPANS = "SELECT o_orderkey AS id, o_custkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS start, CAST(floor(o_totalprice) AS BIGINT) + 1200 AS end FROM {orders}"


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS a FROM orders) SELECT id FROM r WHERE id % 3 > 0 AND EXISTS (SELECT 1 FROM r g WHERE g.k = r.k AND g.id % 3 = 0 AND r.a < g.a + 1200 AND g.a < r.a + 1200)""")
def admitted_ranges(spark, sf_dir):
    """Rows that overlap an admitted range of their key."""
    s = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.floor("o_totalprice").alias("start")).withColumn("end", F.col("start") + 1200)
    return Q.overlapping(s.filter("id % 3 > 0"), s.filter("id % 3 = 0"), "k").select("id")


@query(f"""SELECT l_orderkey AS item, count(*) AS evidence, bool_and(coalesce(p.at <= {_T}, false)) AS safe FROM lineitem LEFT JOIN (SELECT o_orderkey AS evidence_id, o_orderdate AS at FROM orders WHERE o_orderkey % 50 > 0) p ON p.evidence_id = l_orderkey - l_linenumber + 1 GROUP BY l_orderkey""")
def evidence_authority(spark, sf_dir):
    links = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_orderkey") - F.col("l_linenumber") + 1).alias("evidence_id"))
    evidence = _read(spark, sf_dir, "orders").filter("o_orderkey % 50 > 0").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_orderdate").alias("at"))
    return Q.authority(links, evidence, "item", _now())


_TOP = "SELECT doc_id, source, n_chars / 100.0 AS score, CAST(n_chars / 10 AS BIGINT) AS words, lang = 'en' AS anchored, doc_id % 3 = 0 AS transcript, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM {documents} ORDER BY n_chars DESC, doc_id LIMIT 200"


@query(f"""WITH r AS (SELECT * REPLACE (CAST(floor(n / 10) AS BIGINT) AS words) FROM (SELECT *, CAST(score * 100 AS BIGINT) AS n FROM ({_plain(_TOP)}))), a AS (SELECT * FROM r WHERE score >= 12 AND (anchored OR NOT (SELECT bool_or(anchored) FROM r WHERE score >= 12))), t AS (SELECT * FROM a WHERE NOT transcript OR (SELECT count(*) FROM a WHERE NOT transcript) < 3),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, rank) AS k FROM t) WHERE k <= 2),
p AS (SELECT *, row_number() OVER (ORDER BY score DESC, rank) AS place, coalesce(sum(words) OVER (ORDER BY score DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c)
SELECT doc_id, place, CAST(least(words, 12000 - used) AS BIGINT) AS returned FROM p WHERE place <= 12 AND used < 12000""")
def context_packet(spark, sf_dir):
    """What of a ranked list goes into an answer of 12,000 words."""
    ranked = _sql(spark, sf_dir, _TOP.replace("CAST(n_chars / 10 AS BIGINT)", "CAST(floor(n_chars / 10) AS BIGINT)"), "documents")
    return Q.context_pack(ranked, "source", 12.0, 2, 12, 12_000).select("doc_id", "place", "returned")
