"""Aggregates, joins, windows and set operations in SQL that both engines read: {table} stands for a table's DataFrame."""

from __future__ import annotations

import re

SQL = {
    "origin_conflicts": "SELECT md5(text) AS content, count(*) AS copies, count(DISTINCT source) AS origins, min(doc_id) AS first_doc FROM {documents} GROUP BY md5(text) HAVING count(DISTINCT source) > 1",
    "doc_size_having": "SELECT source, count(*) AS docs, max(n_chars) AS longest, round(avg(n_chars), 6) AS mean_chars FROM {documents} GROUP BY source HAVING max(n_chars) > 5000",
    "open_by_kind": "SELECT event_type, count(*) AS n, min(ts) AS oldest FROM {events} GROUP BY event_type",
    "status_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY o_orderstatus, o_orderpriority",
    "page_summaries": "SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} GROUP BY s_nationkey) b ON a.k = b.k",
    "digest_top40": "SELECT coalesce(source, 'none') AS page, count(*) AS n, max(n_chars) AS longest FROM {documents} GROUP BY coalesce(source, 'none') ORDER BY n DESC, page LIMIT 40",
    "queue_state_counts": "SELECT o_orderstatus AS state, count(*) AS n, count(DISTINCT CASE WHEN o_totalprice > 100000 THEN o_custkey END) AS large_customers FROM {orders} GROUP BY o_orderstatus",
    "due_threads": "WITH t AS (SELECT conv_id, max(turn) AS last_turn, min(turn) AS first_turn, count(*) AS n FROM {conversations} GROUP BY conv_id) SELECT conv_id, last_turn, n FROM t WHERE n >= 4 OR last_turn - first_turn >= 4",
    "conditional_sums": "SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchases, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS large, count(DISTINCT CASE WHEN value > 50 THEN event_type END) AS kinds FROM {events} GROUP BY user_id",
    "budget_daily": "SELECT date_trunc('day', ts) AS day, event_type, round(sum(value), 4) AS amount, count(*) AS n FROM {events} GROUP BY date_trunc('day', ts), event_type",
    "budget_reservation": "SELECT event_id, day, used, used <= 2000 AS admitted FROM (SELECT event_id, date_trunc('day', ts) AS day, sum(CAST(value AS BIGINT)) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT event_id, ts, user_id, floor(value) AS value FROM {events}) e) r",
    "usage_by_cycle": "SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS asked, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS answered, min(turn) AS first_turn, max(turn) AS last_turn FROM {conversations} GROUP BY conv_id",
    "usage_by_role": "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS convs, sum(length(text)) AS chars FROM {conversations} GROUP BY role",
    "usage_totals": "SELECT role, count(*) AS convs, sum(turns) AS turns, max(chars) AS longest FROM (SELECT role, conv_id, count(*) AS turns, sum(length(text)) AS chars FROM {conversations} GROUP BY role, conv_id) c GROUP BY role",
    "co_mentions": "SELECT a.l_suppkey AS x, b.l_suppkey AS y, count(DISTINCT a.l_orderkey) AS together FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY a.l_suppkey, b.l_suppkey HAVING count(DISTINCT a.l_orderkey) >= 2",
    "route_prior": "SELECT brand, kind, n, round(n / total, 6) AS share FROM (SELECT brand, kind, n, sum(n) OVER (PARTITION BY brand) AS total FROM (SELECT p_brand AS brand, p_type AS kind, count(*) AS n FROM {part} GROUP BY p_brand, p_type) c) s",
    "coherence_bonus": "SELECT brand, kind, round(least(6, 2 + n * share), 6) AS bonus FROM (SELECT brand, kind, n, n / sum(n) OVER (PARTITION BY brand) AS share FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS brand, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE substr(p_brand, 1, 7) END AS kind, count(*) AS n FROM {part} GROUP BY 1, 2) c) s WHERE n >= 2 AND share >= 0.5",
    "audit_bad_rate": "SELECT d.source, count(*) AS audited, sum(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END) AS bad, round(sum(CASE WHEN l.quality = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) / count(*), 6) AS bad_rate FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source",
    "demotion_breaches": "SELECT source, bad_rate FROM (SELECT d.source, round(sum(CASE WHEN l.quality = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) / count(*), 6) AS bad_rate FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source) r WHERE bad_rate > 0.15",
    "lexical_document_join": "SELECT d.doc_id, d.source, l.quality, l.toxic FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE lower(d.text) LIKE '%license%' OR lower(d.text) LIKE '%licensed%'",
    "entity_fact_left_join": "SELECT c.c_custkey, count(o.o_orderkey) AS facts, max(o.o_orderdate) AS newest FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey",
    "entity_rollups": "WITH f AS (SELECT l_suppkey, count(*) AS facts FROM {lineitem} GROUP BY l_suppkey), m AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_suppkey) SELECT s.s_suppkey, coalesce(f.facts, 0) AS facts, coalesce(m.orders, 0) AS returned FROM {supplier} s LEFT JOIN f ON f.l_suppkey = s.s_suppkey LEFT JOIN m ON m.l_suppkey = s.s_suppkey",
    "latest_success": "SELECT o.o_orderkey, o.o_orderdate, m.newest FROM {orders} o LEFT JOIN (SELECT max(o_orderdate) AS newest FROM {orders} WHERE o_orderstatus = 'F') m ON TRUE WHERE o.o_totalprice > 300000",
    "events_without_packet": "SELECT e.event_id, e.user_id FROM {events} e LEFT JOIN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 0) c ON c.c_custkey = e.user_id LEFT JOIN {supplier} s ON s.s_suppkey = e.event_id WHERE c.c_custkey IS NULL AND s.s_suppkey IS NULL",
    "series_suppression": "SELECT user_id, count(*) AS items, min(CASE WHEN value > 90 THEN ts END) AS next_at FROM {events} GROUP BY user_id HAVING sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) > 0",
    "facts_of_document": "SELECT o.o_orderkey FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)",
    "heads_without_execution": "SELECT c.c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "duplicate_memories": "SELECT source, lang, lower(trim(text)) AS content, count(*) AS n FROM {documents} GROUP BY source, lang, lower(trim(text)) HAVING count(*) > 1",
    "keyset_page": "SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate < TIMESTAMP '1997-01-01 00:00:00' OR (o_orderdate = TIMESTAMP '1997-01-01 00:00:00' AND o_orderkey < 1000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
    "queue_sort": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM {orders}",
    "focus_overflow": "SELECT o_custkey, o_orderkey, CASE WHEN place <= 5 THEN 'focus' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'overflow' ELSE 'rest' END AS section FROM (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM {orders}) r",
    "first_section": "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'done' WHEN value > 80 THEN 'hot' WHEN value > 40 THEN 'warm' ELSE 'other' END AS section FROM {events}",
    "best_route_top1": "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM {part}) r WHERE k = 1",
    "union_distinct": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}",
    "shared_ids": "SELECT vec_id AS id FROM {embeddings} INTERSECT SELECT doc_id AS id FROM {documents}",
    "label_metrics": "SELECT count(*) AS labelled, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS kept, round(avg(CASE WHEN quality = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS keep_rate, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS clean_rate FROM {labels}",
    "cohort_breakdown": "SELECT d.lang, count(*) AS n, round(avg(CAST(l.quality AS DOUBLE)), 6) AS quality, round(avg(CAST(l.toxic AS DOUBLE)), 6) AS toxic FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY d.lang",
    "quota_validation": "SELECT lang, count(*) AS n, count(*) >= 100 AS met FROM {documents} GROUP BY lang",
    "value_counts": "SELECT event_type AS value_, count(*) AS n FROM {events} GROUP BY event_type",
    "retention_cutoff": "SELECT count(*) AS rows_, round(sum(value), 4) AS amount FROM {events} WHERE ts < (SELECT max(ts) FROM {events}) - INTERVAL '7' DAY",
    "storage_stats": "SELECT lang, count(*) AS docs, sum(n_chars) AS chars, max(doc_id) AS last_doc FROM {documents} GROUP BY lang",
    "supplier_revenue": "SELECT s_nationkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY s_nationkey",
    "wilson_interval": "SELECT lang, n, p, round((p + z * z / (2 * n) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n), 6) AS high FROM (SELECT d.lang, CAST(count(*) AS DOUBLE) AS n, round(avg(CAST(l.quality AS DOUBLE)), 9) AS p, CAST(1.959963984540054 AS DOUBLE) AS z FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY d.lang) s",
    "nearest_rank": "SELECT lang, max(CASE WHEN k = ceil(0.5 * n) THEN n_chars END) AS p50, max(CASE WHEN k = ceil(0.9 * n) THEN n_chars END) AS p90, max(CASE WHEN k = ceil(0.99 * n) THEN n_chars END) AS p99 FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY lang) AS n FROM {documents}) r GROUP BY lang",
    "interval_collapse": "SELECT o_custkey, s, e FROM (SELECT o_custkey, o_orderkey, s, e, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice / 100) AS BIGINT) AS s, CAST(floor(o_totalprice / 100) AS BIGINT) + o_orderkey % 97 AS e FROM {orders}) i) r WHERE reach IS NULL OR e > reach",
}


def query(name: str):
    text = SQL[name]
    tables = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark, sf_dir):
        return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})

    run.__name__ = name
    return run


QUERIES = {name: query(name) for name in SQL}
ORACLES = {name: re.sub(r"\{(\w+)\}", r"\1", text) for name, text in SQL.items()}
