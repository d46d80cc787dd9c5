"""Queries over curation, chunking and text features, and their SQL. Those without SQL fold texts in order; tests compare them with brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts as S
from ..functions import text as X
from ..operators import chunks, curation, ingest, retrieval
from .analytic import _BM25, TERMS, table

QUERIES: dict = {}
ORACLES: dict = {}
_BLANK = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"
SPECIFIC = [t for t in TERMS if len(t) > 4]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH w AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'page-' || json_extract_string(props, '$.k') END AS page, CASE WHEN value > 90 THEN 'stale' WHEN value > 60 THEN 'active' END AS st FROM events),
l AS (SELECT user_id, arg_max(page, event_id) FILTER (page IS NOT NULL) AS page, arg_max(st, event_id) FILTER (st IS NOT NULL) AS st FROM w GROUP BY user_id)
SELECT o_orderkey, coalesce(l.page, o_orderpriority) AS page_hint, coalesce(l.st, o_orderstatus) AS status FROM orders LEFT JOIN l ON l.user_id = o_orderkey""")
def fact_log_state(spark, sf_dir):
    """Facts after a log of rehomings and status updates."""
    facts = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("page_hint"), F.col("o_orderstatus").alias("status"))
    page = F.when(F.col("event_type") == "purchase", F.concat(F.lit("page-"), F.get_json_object("props", "$.k")))
    status = F.when(F.col("value") > 90, "stale").when(F.col("value") > 60, "active")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("o_orderkey"), "event_id", page.alias("page_hint"), status.alias("status"))
    return curation.last_writes(facts, log, "o_orderkey", "event_id", ["page_hint", "status"])


@query("""WITH g AS (SELECT o_orderkey, o_orderstatus, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS keeper, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n, o_orderpriority FROM orders)
SELECT o_orderkey, CASE WHEN n > 1 AND o_orderkey = keeper THEN 'active' WHEN n > 1 THEN 'superseded' ELSE o_orderstatus END AS status, CASE WHEN n = 1 OR o_orderkey = keeper THEN o_orderpriority END AS conflict_group_id FROM g""")
def fact_merges(spark, sf_dir):
    """Orders of one customer and priority become one fact, the oldest."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    keeper = rows.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("keeper"))
    merges = rows.join(keeper, ["o_custkey", "o_orderpriority"]).select("keeper", F.col("o_orderkey").alias("superseded"), F.col("o_orderkey").alias("seq"))
    facts = rows.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("conflict_group_id"))
    return curation.merge_facts(facts, merges, "o_orderkey", "seq").select("o_orderkey", "status", "conflict_group_id")


@query("""SELECT entity, count(*) AS links FROM (SELECT CASE WHEN l_suppkey % 10 = 0 THEN l_suppkey + 2 WHEN l_suppkey % 10 IN (1, 5) THEN l_suppkey + 1 ELSE l_suppkey END AS entity FROM lineitem) GROUP BY entity""")
def entity_merge_links(spark, sf_dir):
    """Links after entities were merged into their neighbours, some in two steps."""
    s = F.col("s_suppkey")
    moves = table(spark, sf_dir, "supplier").filter((s % 10).isin(0, 1, 5)).select(s.alias("old"), (s + 1).alias("new"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity")).groupBy("entity").agg(F.count("*").alias("links"))
    return curation.redirect(links, "entity", moves).groupBy("entity").agg(F.sum("links").alias("links"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'moved' END AS segment, CASE WHEN c_custkey % 3 = 1 THEN TRUE ELSE FALSE END AS reverted FROM (SELECT c_custkey, c_mktsegment FROM customer)""")
def guarded_revert(spark, sf_dir):
    """A third of the rows is reverted, a third has changed since the action, a third was never touched by it."""
    c, k = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") % 3
    now = c.select("c_custkey", F.when(k == 2, F.col("c_mktsegment")).otherwise("moved").alias("segment"))
    after = c.filter(k < 2).select("c_custkey", "c_mktsegment", F.when(k == 0, "other").otherwise("moved").alias("segment"))
    inverse = after.select("c_custkey", curation.state_hash("segment").alias("guard"), F.col("c_mktsegment").alias("segment"))
    return curation.revert(now, inverse, "c_custkey", ["segment"]).select("c_custkey", "segment", "reverted")


@query("""WITH i AS (SELECT o_orderkey, o_orderpriority AS p, o_orderdate AS d, o_totalprice > 400000 AS hard, o_custkey % 3 = 0 AND o_totalprice <= 400000 AS hist FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY hist ORDER BY p, d, o_orderkey) AS k FROM i), e AS (SELECT *, hard OR (hist AND k <= 10) OR (NOT hist AND NOT hard) AS eligible FROM r),
c AS (SELECT *, coalesce(sum(CASE WHEN eligible THEN 1 ELSE 0 END) OVER w, 0) AS active, coalesce(sum(CASE WHEN eligible AND NOT hard THEN 1 ELSE 0 END) OVER w, 0) AS today FROM e WINDOW w AS (ORDER BY p, d, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o_orderkey, CASE WHEN hard OR (eligible AND active < 50 AND today < 30) THEN 'admitted' ELSE 'deferred' END AS state,
CASE WHEN hard THEN 'hard_boundary' WHEN NOT eligible AND (SELECT count(*) FROM c WHERE hist AND eligible AND active < 50 AND today < 30) >= 10 THEN 'historical_capacity' WHEN eligible AND active < 50 AND today < 30 THEN 'daily_budget' ELSE 'capacity' END AS reason FROM c""")
def review_admission(spark, sf_dir):
    rows, hard = table(spark, sf_dir, "orders"), F.col("o_totalprice") > 400000
    items = rows.select("o_orderkey", "o_orderpriority", "o_orderdate", hard.alias("hard"), ((F.col("o_custkey") % 3 == 0) & ~hard).alias("historical"))
    return curation.admissions(items, "o_orderkey", ["o_orderpriority", "o_orderdate"], active_limit=50, daily_limit=30, historical_limit=10)


@query("""SELECT p_brand, CAST(facts AS BIGINT) AS facts, CAST(sections AS BIGINT) AS sections, round(least(0.95, 0.45 + facts / 25.0 + sections * 0.05), 4) AS score FROM
(SELECT p_brand, sum(n) AS facts, count(CASE WHEN p_type <> '' AND lower(p_type) NOT IN ('summary', 'unsectioned') THEN 1 END) AS sections FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type) GROUP BY p_brand) WHERE facts >= 5 AND sections >= 3""")
def page_split_candidates(spark, sf_dir):
    return curation.split_candidates(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("""SELECT p_brand, facts, CAST(invalid AS BIGINT) AS invalid, round(least(0.9, 0.45 + invalid / facts * 0.35), 4) AS score FROM (SELECT p_brand, count(*) AS facts, sum(CASE WHEN p_type NOT IN (a, b) THEN 1 ELSE 0 END) AS invalid
FROM part JOIN (SELECT p_brand AS q, min(p_type) AS a, max(p_type) AS b FROM part GROUP BY p_brand) ON q = p_brand GROUP BY p_brand) WHERE invalid > 0""")
def contract_mismatch(spark, sf_dir):
    """Pages whose contract allows their first and last section."""
    parts = table(spark, sf_dir, "part")
    contracts = parts.groupBy("p_brand").agg(F.array(F.min("p_type"), F.max("p_type")).alias("allowed"))
    return curation.contract_mismatches(parts, contracts, "p_brand", "p_type")


@query("""SELECT user_id, event_type, hour, md5(array_to_string(list_sort(list(k)), ',')) AS sources, CAST(sum(n) AS BIGINT) AS candidates FROM
(SELECT user_id, event_type, date_trunc('hour', ts) AS hour, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id, event_type, hour""")
def event_coalesce(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.date_trunc("hour", "ts").alias("hour"), F.get_json_object("props", "$.k").alias("k"))
    out = curation.coalesce_events(rows, ["user_id", "event_type", "hour"], "k")
    return out.select("user_id", "event_type", "hour", F.md5(F.array_join("sources", ",").cast("binary")).alias("sources"), "candidates")


@query("""WITH n AS (SELECT DISTINCT trim(regexp_replace(lower(n), '[^0-9a-z''&]+', ' ', 'g')) AS n FROM (SELECT p_name AS n FROM part UNION ALL SELECT split_part(p_name, ' ', 1) FROM part UNION ALL SELECT p_type || '_' || p_name FROM part)),
s AS (SELECT n, list_distinct(string_split(n, ' ')) AS w FROM n WHERE n <> '')
SELECT a.n AS part, b.n AS whole FROM s a JOIN s b ON list_has_all(b.w, a.w) AND len(a.w) < len(b.w)""")
def entity_name_overlap(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_name").alias("n")).unionAll(p.select(F.split_part("p_name", F.lit(" "), F.lit(1)))).unionAll(p.select(F.concat("p_type", F.lit("_"), "p_name")))
    return curation.names_within(names.select(X.entity_name(F.col("n")).alias("name")))


@query("SELECT o_orderkey, CASE WHEN b < 0.05 THEN 0.0 ELSE round(b, 4) END AS boost FROM (SELECT o_orderkey, 60.0 / (30.0 + greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-01'))) AS b FROM orders)")
def recency_boost(spark, sf_dir):
    age = F.datediff(F.lit("1998-12-01").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", retrieval.recency(age).alias("boost"))


_HITS = lambda ts: " + ".join(f"CAST(contains(lower(d.text), '{t}') AS INTEGER)" if len(t) > 3 else f"CAST(regexp_matches(lower(d.text), '(^|[^a-z0-9_]){t}([^a-z0-9_]|$)') AS INTEGER)" for t in ts)


@query(f"""WITH {_BM25}, s AS (SELECT d.doc_id, {_HITS(TERMS)} AS matches, {_HITS(SPECIFIC)} AS specific, least(12.0, bm25) AS lexical, d.doc_id % 11 / 10.0 AS confidence FROM bm JOIN documents d ON d.doc_id = bm.doc_id)
SELECT doc_id, matches, specific, round(lexical + 4 * matches + 3 * specific + 2 * greatest(0.0, confidence - 0.5), 4) AS score FROM s
WHERE matches > 0 AND specific >= {X.required_hits(len(SPECIFIC))} AND lexical + 4 * matches + 3 * specific + 2 * greatest(0.0, confidence - 0.5) >= 12""")
def fact_scores(spark, sf_dir):
    facts = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 11 / 10.0).alias("confidence"))
    return retrieval.fact_scores(facts, TERMS, SPECIFIC).select("doc_id", "matches", "specific", F.round("score", 4).alias("score"))


@query(f"""SELECT doc_id, md5(CASE WHEN len(w) <= 50 THEN trim(text, {_BLANK}) ELSE array_to_string(w[1:47], ' ') || ' ... [truncated]' END) AS trimmed FROM (SELECT doc_id, text, regexp_extract_all(text, '[^ \\t\\n\\f\\r]+') AS w FROM documents)""")
def trimmed_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.trim_budget(F.col("text"), 50).cast("binary")).alias("trimmed"))


@query(f"""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN trim(text, {_BLANK}) WHEN doc_id % 3 = 1 THEN trim(' --- open ' || text, {_BLANK}) ELSE trim(text, {_BLANK}) END) AS body FROM documents WHERE NOT contains(text, '---')""")
def front_matter_stripped(spark, sf_dir):
    """Bodies of documents that have a header, an unclosed one, or none."""
    k = F.col("doc_id") % 3
    whole = F.when(k == 0, F.concat(F.lit("\n---\ntitle: a --- b\n---\n"), "text")).when(k == 1, F.concat(F.lit(" --- open "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").filter(~F.contains("text", F.lit("---"))).select("doc_id", F.md5(X.without_front_matter(whole).cast("binary")).alias("body"))


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) || lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) WHEN doc_id % 4 = 1 THEN '- {"a": [' || text ELSE text END AS t FROM documents)
SELECT doc_id, length(t) >= 800 AND regexp_full_match(t, '[A-Za-z0-9+/=\r\n]*') AND len(list_distinct(string_split(regexp_replace(t, '[\r\n]', '', 'g'), ''))) > 20 AS base64, length(regexp_replace(t, '^[- \t]+', '')) > 3000 AND regexp_matches(regexp_replace(t, '^[- \t]+', ''), '^[{\[]') AND (len(regexp_extract_all(t, '[{\[]')) >= 4 OR contains(t, '":')) AS json FROM d""")
def blob_flags(spark, sf_dir):
    letters, k = F.regexp_replace("text", "[^A-Za-z]", ""), F.col("doc_id") % 4
    t = F.when(k == 0, F.concat(F.upper(letters), F.lower(letters))).when(k == 1, F.concat(F.lit('- {"a": ['), "text")).otherwise(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", X.looks_like_base64(F.col("t")).alias("base64"), X.looks_like_json(F.col("t")).alias("json"))


@query(f"SELECT doc_id, md5(source || chr(10) || chr(10) || substr(trim(text, {_BLANK}), 1, 6000)) AS passage FROM documents")
def passage_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.passage(F.col("text"), F.col("source")).cast("binary")).alias("passage"))


_STEM = "CASE WHEN suffix(x, 'ss') THEN x WHEN length(x) > 5 AND suffix(x, 'ies') THEN left(x, length(x) - 3) || 'y' WHEN length(x) > 6 AND suffix(x, 'ing') THEN left(x, length(x) - 3) WHEN length(x) > 5 AND suffix(x, 'ed') THEN left(x, length(x) - 2) WHEN length(x) > 4 AND suffix(x, 's') THEN left(x, length(x) - 1) ELSE x END"


@query(f"""WITH s AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: {_STEM})) AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.w AS a, b.w AS b, len(list_intersect(a.w, b.w)) AS n FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN least(len(a), len(b)) > 0 THEN n / least(len(a), len(b)) ELSE 0.0 END, 6) AS overlap, round(CASE WHEN len(a) + len(b) > n THEN n / (len(a) + len(b) - n) ELSE 0.0 END, 6) AS jaccard FROM p""")
def statement_similarity(spark, sf_dir):
    """Stem overlap of each turn with the one after it."""
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", S.stems(F.col("text")).alias("a"))
    both = s.join(s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(S.overlap(F.col("a"), F.col("b")), 6).alias("overlap"), F.round(S.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("SELECT o_orderkey, o_orderkey % 3 <> 2 AND o_orderkey % 3 <> o_custkey % 3 AND o_custkey % 3 <> 2 AS contrast FROM orders")
def contrast_cues(spark, sf_dir):
    """Whether two statements that say the old, the newest or neither differ in it."""
    said = lambda c: F.when(F.col(c) % 3 == 0, "the old plan").when(F.col(c) % 3 == 1, "The NEWEST plan").otherwise("a plan before us")
    words = lambda c: F.regexp_extract_all(F.lower(said(c)), F.lit("[a-z]+"), F.lit(0))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.contrast(words("o_orderkey"), words("o_custkey")).alias("contrast"))


@query("""SELECT o_orderkey, kind, id FROM (SELECT o_orderkey, 'memory' AS kind, 'mem_' || o_custkey AS id FROM orders UNION SELECT o_orderkey, 'document', 'doc_' || o_orderkey FROM orders UNION SELECT o_orderkey, 'wiki_page', 'people/' || o_orderstatus || '.md' FROM orders)""")
def stable_references(spark, sf_dir):
    """Ids that a sentence on each order cites, one of them twice."""
    o = table(spark, sf_dir, "orders")
    said = F.concat(F.lit("see mem_"), "o_custkey", F.lit(", document:doc_"), "o_orderkey", F.lit(" (doc_"), "o_orderkey", F.lit("), people/"), "o_orderstatus", F.lit(".md; xmem_1"))
    return o.select("o_orderkey", F.inline(S.references(said)))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 AND doc_id % 5 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 5 = 0)""")
def source_rescan(spark, sf_dir):
    """A second scan in which some sources are gone, some new and some edited."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    known = docs.filter(k % 5 != 0).select("doc_id", X.sha256(F.col("text")).alias("content_hash"))
    found = docs.filter(k % 11 != 0).select("doc_id", F.when(k % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return ingest.rescan(known, found, "doc_id")


@query("""SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS units FROM (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE length(text) % 3 <> 0)) GROUP BY conv_id, island""")
def evidence_spans(spark, sf_dir):
    """Cited turns of a conversation, joined where they follow each other."""
    return ingest.merged_spans(table(spark, sf_dir, "conversations").filter(F.length("text") % 3 != 0).select("conv_id", F.col("turn").alias("unit")), "conv_id")


@query()
def heading_chunks(spark, sf_dir):
    return chunks.chunks(table(spark, sf_dir, "documents"), headings=True)


@query()
def paragraph_chunks(spark, sf_dir):
    return chunks.chunks(table(spark, sf_dir, "documents"), headings=False)


@query()
def hashed_vectors(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunks.hashed_vector()(F.col("text")).alias("vector"))
