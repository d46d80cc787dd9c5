"""Queries over measures and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import graph as G

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CASES = """SELECT e.event_id, e.event_type AS origin, e.value > 30 AS verdict_match, e.event_id % 3 > 0 AS expects_source, e.value > 50 AS source_hit, e.event_id % 5 = 0 AS negative, e.value > 20 AS passed, e.user_id % 2 AS facts FROM {events} e"""
_CASE_SQL = """count(*) AS cases, round(count(*) FILTER (verdict_match) / count(*), 3) AS verdict_accuracy, round(coalesce(count(*) FILTER (expects_source AND source_hit) / nullif(count(*) FILTER (expects_source), 0), 1.0), 3) AS source_hit_rate,
 round(coalesce(count(*) FILTER (negative AND passed) / nullif(count(*) FILTER (negative), 0), 1.0), 3) AS control_pass_rate, count(*) FILTER (negative AND facts > 0) AS fact_leaks"""


def _cases(spark, sf_dir):
    return spark.sql(_CASES, events=_read(spark, sf_dir, "events"))


@query(f"SELECT {_CASE_SQL} FROM ({_CASES.replace('{events}', 'events')})")
def verdict_accuracy(spark, sf_dir):
    return E.case_metrics(_cases(spark, sf_dir))


@query(f"SELECT origin, {_CASE_SQL} FROM ({_CASES.replace('{events}', 'events')}) GROUP BY origin")
def origin_breakdown(spark, sf_dir):
    return E.case_metrics(_cases(spark, sf_dir), ["origin"])


_LABELLED = "SELECT l.doc_id, d.lang, l.quality = 1 AS expected, d.n_chars > 400 AS actual, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'keep' ELSE 'drop' END AS label, CASE WHEN d.n_chars > 400 THEN 'keep' ELSE 'drop' END AS given FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id"
_LABELLED_SQL = _LABELLED.replace("{labels}", "labels").replace("{documents}", "documents")


def _labelled(spark, sf_dir):
    return spark.sql(_LABELLED, labels=_read(spark, sf_dir, "labels"), documents=_read(spark, sf_dir, "documents"))


@query(f"""WITH c AS (SELECT lang, CAST(sum(CAST(expected AND actual AS INT)) AS BIGINT) AS hits, CAST(sum(CAST(actual AS INT)) AS BIGINT) AS made, CAST(sum(CAST(expected AS INT)) AS BIGINT) AS wanted FROM ({_LABELLED_SQL}) GROUP BY lang),
p AS (SELECT *, CASE WHEN made = 0 THEN 1.0 ELSE hits / made END AS p, CASE WHEN wanted = 0 THEN 1.0 ELSE hits / wanted END AS r FROM c)
SELECT lang, hits, made, wanted, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM p""")
def label_precision_recall(spark, sf_dir):
    """What a rule by length keeps, against the labels, by language."""
    return E.precision_recall(_labelled(spark, sf_dir), "expected", "actual", ["lang"])


@query(f"SELECT label AS expected, given AS actual, count(*) AS n FROM ({_LABELLED_SQL}) GROUP BY 1, 2")
def relation_confusion(spark, sf_dir):
    return E.confusion(_labelled(spark, sf_dir), "label", "given")


@query("""SELECT round(sum(abs(c - v) * n) / sum(n), 6) AS ece FROM (SELECT count(*) AS n, avg(c) AS c, avg(v) AS v FROM (SELECT least(n_chars / 4000.0, 1.0) AS c, CAST(quality AS DOUBLE) AS v FROM labels JOIN documents USING (doc_id))
 GROUP BY CASE WHEN c < 0.2 THEN 0 WHEN c < 0.4 THEN 1 WHEN c < 0.6 THEN 2 WHEN c < 0.8 THEN 3 ELSE 4 END)""")
def length_calibration(spark, sf_dir):
    """How far length as a confidence is from the share of good documents."""
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents"), "doc_id")
    return E.calibration_error(rows.select(F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("c"), F.col("quality").cast("double").alias("v")), "c", "v")


_RUNS = """SELECT event_id % 500 AS item, CASE WHEN event_id < 3000 THEN 'a' WHEN event_id < 6000 THEN 'b' ELSE 'c' END AS run, CASE WHEN value > 60 THEN 'supported' WHEN value > 30 THEN 'uncertain' ELSE 'unsupported' END AS label FROM {events} WHERE event_id % 3000 < 500 AND event_id < 9000"""
_RUNS_SQL = _RUNS.replace("{events}", "events")


def _runs(spark, sf_dir):
    return spark.sql(_RUNS, events=_read(spark, sf_dir, "events"))


@query(f"""WITH r AS ({_RUNS_SQL}), p AS (SELECT a.run AS l, b.run AS r, a.label AS x, b.label AS y FROM r a JOIN r b ON a.item = b.item AND a.run < b.run)
SELECT l AS "left", r AS "right", count(*) AS items, round(count(*) FILTER (x = y) / count(*), 6) AS exact, round(count(*) FILTER ((x <> 'unsupported') = (y <> 'unsupported')) / count(*), 6) AS agreed FROM p GROUP BY l, r""")
def run_agreement(spark, sf_dir):
    """Each two of three runs of a reviewer over the same items."""
    return E.run_agreement(_runs(spark, sf_dir), "item", "run", "label", ["supported", "uncertain"])


@query(f"""WITH r AS ({_RUNS_SQL}), p AS (SELECT a.run AS l, b.run AS r, avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) AS same FROM r a JOIN r b ON a.item = b.item AND a.run < b.run GROUP BY 1, 2) SELECT round(min(same), 6) AS least FROM p""")
def minimum_agreement(spark, sf_dir):
    return E.run_agreement(_runs(spark, sf_dir), "item", "run", "label", ["supported", "uncertain"]).agg(F.min("exact").alias("least"))


@query(f"""SELECT item, CASE WHEN string_agg(label, ',' ORDER BY run) = 'supported,supported,supported' THEN 'supported' WHEN count(*) FILTER (label IN ('supported', 'uncertain')) >= 2 THEN 'uncertain' ELSE 'unsupported' END AS outcome FROM ({_RUNS_SQL}) GROUP BY item""")
def run_consensus(spark, sf_dir):
    return E.consensus(_runs(spark, sf_dir), "item", "label", "supported", ["supported", "uncertain"])


_RANKED = """SELECT o_custkey AS ask, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM {orders}"""


@query(f"""WITH ranked AS ({_RANKED.replace('{orders}', 'orders')}), gold AS (SELECT o_custkey AS ask, o_orderkey AS item FROM orders WHERE o_orderstatus = 'F')
SELECT g.ask, count(*) AS gold, count(*) FILTER (rank <= 5) AS hits_5, count(*) FILTER (rank <= 10) AS hits, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall, round(coalesce(1.0 / min(rank) FILTER (rank <= 10), 0), 6) AS rr,
 count(*) FILTER (rank <= 10) = count(*) AS complete FROM gold g JOIN ranked r ON r.ask = g.ask AND r.item = g.item GROUP BY g.ask""")
def ranking_metrics(spark, sf_dir):
    """Each customer's finished orders in the ranking of all theirs by price."""
    orders = _read(spark, sf_dir, "orders")
    return E.ranking_metrics(spark.sql(_RANKED, orders=orders), orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("ask"), F.col("o_orderkey").alias("item")), "ask", "item")


@query(f"""WITH m AS ({ORACLES['ranking_metrics']}) SELECT count(*) AS queries, round(avg(CASE WHEN hits_5 > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_5, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_10, round(sum(hits) / sum(gold), 6) AS micro_recall,
 round(avg(recall), 6) AS macro_recall, round(avg(rr), 6) AS mrr, round(avg(CASE WHEN complete THEN 1.0 ELSE 0.0 END), 6) AS complete_rate FROM m""")
def ranking_summary(spark, sf_dir):
    return E.summarised(ranking_metrics(spark, sf_dir))


@query("""SELECT lang, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.9) AS p90, quantile_disc(n_chars, 0.95) AS p95, quantile_disc(n_chars, 0.99) AS p99, max(n_chars) AS largest FROM documents GROUP BY lang""")
def volume_percentiles(spark, sf_dir):
    return E.nearest_ranks(_read(spark, sf_dir, "documents"), ["lang"], "n_chars", [50, 90, 95, 99])


@query("""WITH m AS (SELECT l_orderkey AS unit, bool_and(l_quantity > 5) AS m, bool_and(l_discount < 0.08) AS e, count(DISTINCT l_linestatus) AS g, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT unit, m AND (n = 1 OR g = 1) AS complete, m AND (n = 1 OR g = 1) AND e AS exact FROM m""")
def unit_completeness(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), (F.col("l_quantity") > 5).alias("matched"), (F.col("l_discount") < 0.08).alias("exact"), F.col("l_linestatus").alias("group"))
    return E.units_complete(rows, "unit", "matched", "exact", "group")


@query("""SELECT source, CASE WHEN emitted > 0 THEN matched / emitted WHEN gold = 0 THEN 1.0 ELSE 0.0 END AS precision FROM (SELECT source, count(*) FILTER (n_chars > 15000) AS emitted, count(*) FILTER (n_chars > 15000 AND lang = 'en') AS matched, count(*) FILTER (lang = 'en') AS gold FROM documents GROUP BY source)""")
def review_precision(spark, sf_dir):
    n = lambda c: F.sum(F.coalesce(F.expr(c).cast("long"), F.lit(0)))
    per = _read(spark, sf_dir, "documents").groupBy("source").agg(n("n_chars > 15000").alias("e"), n("n_chars > 15000 and lang = 'en'").alias("m"), n("lang = 'en'").alias("g"))
    return per.select("source", E.review_precision(F.col("e"), F.col("m"), F.col("g")).alias("precision"))


_PAIRS = "SELECT user_id AS a, 100000 + CAST(floor(value * 40) AS BIGINT) AS b FROM {events} WHERE value > 97"


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM (SELECT user_id AS a, 100000 + CAST(floor(value * 40) AS BIGINT) AS b FROM events WHERE value > 97) UNION SELECT DISTINCT 100000 + CAST(floor(value * 40) AS BIGINT), user_id FROM events WHERE value > 97),
r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a) SELECT id, min(seen) AS root FROM r GROUP BY id""")
def alias_components(spark, sf_dir):
    """Users that share rare values, with the values."""
    return G.components(spark.sql(_PAIRS, events=_read(spark, sf_dir, "events")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_partkey <= 12 AND l_suppkey <= 12 AND l_suppkey <> l_partkey), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS seen FROM w UNION SELECT r.id, w.b FROM r JOIN w ON r.seen = w.a), c AS (SELECT id, min(seen) AS root FROM r GROUP BY id), s AS (SELECT root, count(*) AS members FROM c GROUP BY root),
k AS (SELECT root, count(*) AS links FROM e JOIN c ON c.id = e.a GROUP BY root) SELECT root, members, links, links * 2 = members * (members - 1) AS accepted FROM s JOIN k USING (root)""")
def identity_cliques(spark, sf_dir):
    pairs = _read(spark, sf_dir, "lineitem").filter("l_partkey <= 12 and l_suppkey <= 12").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    return G.cliques(pairs)


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), p AS (SELECT x.l_suppkey, y.l_suppkey AS o, count(*) AS w FROM m x JOIN m y USING (l_orderkey) WHERE x.l_suppkey <> y.l_suppkey GROUP BY 1, 2)
SELECT l_suppkey, count(*) AS neighbours, CAST(sum(w) AS BIGINT) AS weight FROM p GROUP BY 1""")
def mention_degrees(spark, sf_dir):
    return G.degrees(_read(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query("""WITH RECURSIVE l AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders),
r AS (SELECT o_orderkey, o_orderkey AS first, 0 AS steps FROM l WHERE before IS NULL UNION ALL SELECT l.o_orderkey, r.first, r.steps + 1 FROM r JOIN l ON l.before = r.o_orderkey) SELECT o_orderkey, first, CAST(steps AS BIGINT) AS steps FROM r""")
def revision_chains(spark, sf_dir):
    """Each order's way back to its customer's first, through the order that it follows."""
    links = spark.sql("SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM {orders}", orders=_read(spark, sf_dir, "orders"))
    return G.chain_ends(links, "o_orderkey", "before")


@query()
def prioritised_merges(spark, sf_dir):
    """Candidate merges of suppliers by price, where a kept merge reserves both sides. A greedy walk has no SQL; tests walk it."""
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_extendedprice").alias("score"))
    pairs = rows.filter("l_suppkey <> l_partkey and score > 60000").select((F.col("l_suppkey") * 1_000_000_000 + F.col("l_partkey")).alias("key"), F.col("l_suppkey").alias("x"), F.col("l_partkey").alias("y"), "score")
    return G.greedy_reserve(pairs, "key", "x", "y", "score")
