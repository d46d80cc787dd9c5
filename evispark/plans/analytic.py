"""Queries over the library's operators, and their SQL."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import curation, lineage, operational, policy, retrieval, temporal
from ..streaming import reconcile as streams

QUERIES: dict = {}
ORACLES: dict = {}
#: The question of the search queries.
ASK = "what is the outh of thingent and worthless license"
TERMS = X.query_terms(ASK)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TOK = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))
_N = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS n{i}" for i in range(len(TERMS)))
_SUM = " + ".join(f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(TERMS)))
_BM25 = f"""tf AS (SELECT doc_id, len(w) AS dl, {_TF} FROM (SELECT doc_id, {_TOK} AS w FROM documents)),
st AS (SELECT count(*) AS n, avg(dl) AS av, {_N} FROM tf),
bm AS (SELECT doc_id, {_SUM} AS bm25 FROM tf, st WHERE {' + '.join(f'tf{i}' for i in range(len(TERMS)))} > 0)"""
_HAS = " + ".join(f"CAST(contains(lower(d.text), '{t}') AS INTEGER)" if len(t) > 3 else f"CAST(regexp_matches(lower(d.text), '(^|[^a-z0-9_]){t}([^a-z0-9_]|$)') AS INTEGER)" for t in TERMS)
_HYBRID = f"""{_BM25}, lx AS (SELECT doc_id, bm25, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rank FROM bm QUALIFY rank <= 80),
sc AS (SELECT d.doc_id, d.source, bm25, {_HAS} AS covered, 10 / sqrt(rank) + 6.0 * ({_HAS}) / {len(TERMS)} + CASE WHEN d.source = 'src1' THEN 2.0 WHEN d.source = 'src0' THEN -1.0 ELSE 0.0 END AS score FROM lx JOIN documents d ON d.doc_id = lx.doc_id),
cap AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k FROM sc WHERE covered >= {X.required_hits(len(TERMS))}),
hy AS (SELECT doc_id, source, bm25, covered, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM cap WHERE k <= 2 QUALIFY rank <= 20)"""
_SOURCES = {"src1": 2.0, "src0": -1.0}


_INDEX: dict = {}


def _found(spark, sf_dir):
    """BM25 scores of the question, from postings that the first search of a session over a folder writes."""
    import uuid

    docs = table(spark, sf_dir, "documents")
    known = (spark.sparkContext.applicationId, sf_dir)
    for _ in range(2):
        if known not in _INDEX:
            _INDEX[known] = retrieval.postings(docs, f"{lineage.shared_folder(spark)}/postings-{uuid.uuid4().hex}")
        folder, n, average = _INDEX[known]
        try:
            return retrieval.search(spark.read.parquet(folder), n, average, TERMS)
        except AnalysisException:  # somebody has cleared the folder
            del _INDEX[known]
    raise RuntimeError("postings can't be read")


@query(f"WITH {_BM25} SELECT doc_id, round(bm25, 6) AS bm25, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rank FROM bm QUALIFY rank <= 100")
def bm25_topk(spark, sf_dir):
    out = retrieval.top(_found(spark, sf_dir), "bm25", 100)
    return out.select("doc_id", F.round("bm25", 6).alias("bm25"), "rank")


@query(f"WITH {_HYBRID} SELECT doc_id, source, round(bm25, 6) AS bm25, covered, round(score, 6) AS score, rank FROM hy")
def hybrid_search(spark, sf_dir):
    """The flagship: lexical candidates, reranking, a floor on specific hits, two results a source."""
    out = retrieval.hybrid(table(spark, sf_dir, "documents"), TERMS, _SOURCES, found=_found(spark, sf_dir))
    return out.select("doc_id", "source", F.round("bm25", 6).alias("bm25"), "covered", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_HYBRID} SELECT CASE WHEN r >= 3 AND s >= 30 THEN 'found' WHEN r > 0 THEN 'partial' ELSE 'no_strong_match' END AS verdict, round(least(1.0, s / 40), 6) AS confidence, r AS results FROM (SELECT coalesce(sum(CASE WHEN rank <= 3 THEN score END), 0.0) AS s, count(*) AS r FROM hy)")
def verdict_confidence(spark, sf_dir):
    return retrieval.verdict(retrieval.hybrid(table(spark, sf_dir, "documents"), TERMS, _SOURCES, found=_found(spark, sf_dir)))


@query(f"WITH {_HYBRID}, cut AS (SELECT *, sum(CASE WHEN fall THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS cuts FROM (SELECT *, coalesce(lag(score) OVER (ORDER BY rank) - score >= 0.5 AND rank > 3, FALSE) AS fall FROM hy)) SELECT doc_id, rank FROM cut WHERE cuts = 0")
def knee_cut(spark, sf_dir):
    return retrieval.knee_cut(retrieval.hybrid(table(spark, sf_dir, "documents"), TERMS, _SOURCES, found=_found(spark, sf_dir)), "score", drop=0.5).select("doc_id", "rank")


def _first_vector(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows, rows.orderBy("vec_id").select("embedding").first()[0]


_VEC = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1) o"


_SET = "(SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0) o JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings) e ON e.vec_id <> o.query_id"


def _asked(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows, rows.filter("vec_id % 20 = 0")


@query(f"SELECT query_id, vec_id, round(list_distance(v, q), 6) AS l2, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(v, q), vec_id) AS rank FROM {_SET} QUALIFY rank <= 10")
def vector_knn_l2(spark, sf_dir):
    """The 10 nearest vectors of every vector whose id is divisible by 20."""
    return retrieval.nearest_of_set(*_asked(spark, sf_dir)).select("query_id", "vec_id", F.round("l2", 6).alias("l2"), "rank")


@query(f"SELECT query_id, vec_id, round(1 - list_cosine_similarity(v, q), 6) + 0.0 AS cosine FROM {_SET} WHERE 1 - list_cosine_similarity(v, q) < 0.6")
def vector_within_cosine(spark, sf_dir):
    rows, asked = _asked(spark, sf_dir)
    return retrieval.nearest_of_set(rows, asked, within=0.6).select("query_id", "vec_id", (F.round("cosine", 6) + 0.0).alias("cosine"))


@query(f"""WITH {_BM25}, a AS (SELECT doc_id, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rank FROM bm QUALIFY rank <= 100),
b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_distance(v, q), vec_id) AS rank FROM {_VEC} QUALIFY rank <= 100)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id""")
def rrf_fusion(spark, sf_dir):
    rows, q = _first_vector(spark, sf_dir)
    lexical = retrieval.top(_found(spark, sf_dir), "bm25", 100)
    near = retrieval.top(retrieval.distances(rows, q).select(F.col("vec_id").alias("doc_id"), "l2"), "l2", 100, "doc_id", False)
    return retrieval.rrf([lexical, near]).select("doc_id", F.round("rrf", 9).alias("rrf"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 2")
def per_source_cap(spark, sf_dir):
    return retrieval.per_group_cap(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "n_chars", 2).select("doc_id", "source")


@query("SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\f\\r]+')) AS words FROM documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count(F.col("text")).alias("words"))


@query(f"""WITH w AS (SELECT doc_id, {_TOK} AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, greatest(len(t) - 200, 1), 1000)) AS pos FROM w WHERE len(t) > 0)
SELECT doc_id, CAST(pos / 1000 AS BIGINT) AS chunk, CAST(least(len(t) - pos, 1200) AS BIGINT) AS words, md5(array_to_string(t[pos + 1 : pos + 1200], ' ')) AS content FROM c""")
def sliding_chunks(spark, sf_dir):
    """Windows of 1200 tokens, 200 of them shared with the next."""
    words = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("t") - 201, F.lit(0)), F.lit(1000)))
    cuts = words.select("doc_id", "t", at.alias("at"))
    piece = F.slice("t", F.col("at") + 1, 1200)
    return cuts.select("doc_id", (F.col("at") / 1000).cast("long").alias("chunk"), F.size(piece).cast("long").alias("words"), F.md5(F.array_join(piece, " ").cast("binary")).alias("content"))


@query("SELECT doc_id FROM documents WHERE length(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 \\t\\n\\r]', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) < 20")
def low_information(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.length(X.normal_statement(F.col("text"))) < 20).select("doc_id")


@query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def sha_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(X.sha256(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT page_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)")
def page_slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


@query("SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[redacted]', 'g')) AS masked, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS spans FROM documents")
def redaction(spark, sf_dir):
    spans = F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.mask_mail(F.col("text")).cast("binary")).alias("masked"), spans.alias("spans"))


@query("SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS n FROM documents) WHERE n > 0")
def number_mentions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.numbers(F.col("text"))).alias("n")).filter("n > 0")


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS body FROM pages")
def html_text(spark, sf_dir):
    plain = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(plain, "[ \t\n\r]+", " ")).cast("binary")).alias("body"))


@query("SELECT conv_id, turn, CAST(pos AS INTEGER) AS unit, role || ': ' || u AS evidence FROM (SELECT conv_id, turn, role, unnest(us) AS u, unnest(range(0, len(us))) AS pos FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS us FROM conversations)) WHERE u <> ''")
def evidence_units(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("unit", "u")).filter("u <> ''")
    return units.select("conv_id", "turn", "unit", F.concat("role", F.lit(": "), "u").alias("evidence"))


@query("""WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to, row_number() OVER w AS revision FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT *, valid_to IS NULL AS is_head FROM v""")
def scd2_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return temporal.versions(rows, "o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")


_SCD = "(SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)"


def _scd(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return temporal.versions(rows, "o_custkey", "o_orderdate", "o_orderkey")


@query(f"SELECT o_custkey, o_orderkey FROM {_SCD} WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_to IS NULL OR TIMESTAMP '1996-06-01' < valid_to)")
def valid_as_of(spark, sf_dir):
    at = F.lit("1996-06-01").cast("timestamp")
    return _scd(spark, sf_dir).filter(temporal.valid_at(at, F.lit("time_bound"), F.col("valid_from"), F.col("valid_to"))).select("o_custkey", "o_orderkey")


@query(f"""SELECT o_custkey, o_orderkey FROM {_SCD} WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_to IS NULL OR TIMESTAMP '1996-06-01' < valid_to)
AND valid_from + INTERVAL 30 DAY <= TIMESTAMP '1996-06-10' AND (valid_to IS NULL OR TIMESTAMP '1996-06-10' < valid_to + INTERVAL 30 DAY)""")
def bitemporal_as_of(spark, sf_dir):
    """Knowledge trails validity by 30 days."""
    at, known = F.lit("1996-06-01").cast("timestamp"), F.lit("1996-06-10").cast("timestamp")
    late = lambda c: F.col(c) + F.expr("INTERVAL 30 DAY")
    valid = temporal.valid_at(at, F.lit("time_bound"), F.col("valid_from"), F.col("valid_to"))
    return _scd(spark, sf_dir).filter(valid & temporal.known_at(known, late("valid_from"), late("valid_to"))).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def timeline_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return temporal.latest(rows, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unreviewed' WHEN valid_from > TIMESTAMP '1997-01-01' THEN 'future' WHEN valid_to <= TIMESTAMP '1997-01-01' THEN 'historical' ELSE 'current' END AS label FROM {_SCD}""")
def currentness(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "P", "unreviewed").otherwise("active")
    now = F.lit("1997-01-01").cast("timestamp")
    return _scd(spark, sf_dir).select("o_orderkey", temporal.currentness(F.lit("ongoing"), status, F.col("valid_from"), F.col("valid_to"), now).alias("label"))


@query("""WITH i AS (SELECT o_custkey, o_orderkey, o_orderdate AS s, o_orderdate + INTERVAL 90 DAY AS e, o_orderstatus AS st FROM orders)
SELECT a.o_custkey, a.o_orderkey AS x, b.o_orderkey AS y FROM i a JOIN i b ON a.o_custkey = b.o_custkey AND a.st = 'F' AND b.st = 'O' AND a.s < b.e AND b.s < a.e""")
def event_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("INTERVAL 90 DAY")).alias("e"), "o_orderstatus")
    side = lambda x: rows.filter(F.col("o_orderstatus") == x).drop("o_orderstatus")
    return temporal.interval_join(side("F"), side("O"), "o_custkey").select("o_custkey", F.col("o_orderkey_a").alias("x"), F.col("o_orderkey_b").alias("y"))


@query("""WITH i AS (SELECT o_custkey, o_orderkey, o_orderdate AS s, o_orderdate + INTERVAL 60 DAY AS e, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT o_orderkey, CASE WHEN e <= n THEN 'before' WHEN n + INTERVAL 60 DAY <= s THEN 'after' ELSE 'overlap' END AS relation FROM i WHERE n IS NOT NULL""")
def interval_relation(spark, sf_dir):
    d = F.expr("INTERVAL 60 DAY")
    rows = _scd(spark, sf_dir).filter("valid_to is not null")
    return rows.select("o_orderkey", temporal.relation(F.col("valid_from"), F.col("valid_from") + d, F.col("valid_to"), F.col("valid_to") + d).alias("relation"))


_OBS = "(SELECT event_id, user_id, value, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS source_order FROM events)"


def _observations(spark, sf_dir):
    order = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts", order.alias("source_order"))


@query(f"""SELECT event_id, user_id, CASE WHEN seen IS NULL THEN 'created' WHEN source_order <= seen THEN 'stale_ignored' ELSE 'updated' END AS decision
FROM (SELECT *, max(source_order) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {_OBS})""")
def ops_event_log(spark, sf_dir):
    return operational.decide(_observations(spark, sf_dir), "user_id", "event_id", "source_order").select("event_id", "user_id", "decision")


@query(f"""SELECT user_id, source_order, event_id, value, observations FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source_order DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS observations FROM {_OBS}) WHERE k = 1""")
def ops_reconcile_batch(spark, sf_dir):
    return operational.items(_observations(spark, sf_dir), "user_id", "event_id", "source_order", ["value"])


@query(f"""SELECT event_id, user_id, CASE WHEN seen IS NULL THEN 'created' WHEN source_order <= seen THEN 'stale_ignored' ELSE 'updated' END AS decision
FROM (SELECT *, max(source_order) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {_OBS})""")
def ops_reconcile_stream(spark, sf_dir):
    """The same decisions from a stream; it writes files to the shared folder and the query reads them."""
    return _streamed(spark, sf_dir, lambda s: streams.reconcile(s.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("source_order"))).select("event_id", "user_id", "decision"))


def _streamed(spark, sf_dir, plan):
    import uuid

    folder = f"{lineage.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    import os

    one = os.path.isfile(f"{sf_dir}/events.parquet")
    stream = source.option("pathGlobFilter", "events.parquet").load(sf_dir) if one else source.load(f"{sf_dir}/events.parquet")
    q = plan(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("SELECT user_id, round(least(2.0, greatest(-2.0, sum(value / 100 * pow(0.5, greatest(0, CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-01-15') AS DOUBLE)) / 90)))), 6) AS boost FROM events GROUP BY user_id")
def lineage_decay(spark, sf_dir):
    """Decayed weights of each user; a date in the future counts as today."""
    age = F.greatest(F.lit(0), F.datediff(F.lit("2024-01-15").cast("date"), F.col("ts").cast("date"))) / 90.0
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.least(F.lit(2.0), F.greatest(F.lit(-2.0), F.sum(F.col("value") / 100 * F.pow(F.lit(0.5), age)))), 6).alias("boost"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS target, count(DISTINCT user_id) AS sessions, max(ts) AS newest FROM events GROUP BY 1")
def popularity(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("target")).agg(F.countDistinct("user_id").alias("sessions"), F.max("ts").alias("newest"))


_RULES = [("deny", {"all": [{"field": "o_orderstatus", "op": "eq", "value": "P"}, {"field": "o_totalprice", "op": "gte", "value": 200000}]}), ("review", {"any": [{"field": "o_totalprice", "op": "gt", "value": 300000}, {"field": "o_orderpriority", "op": "in", "value": ["1-URGENT"]}]})]


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice >= 200000 THEN 'deny' WHEN o_totalprice > 300000 OR o_orderpriority IN ('1-URGENT') THEN 'review' ELSE 'auto' END AS decision FROM orders")
def policy_first_match(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", policy.first_match(_RULES, "auto").alias("decision"))


@query("SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 < 0.05")
def hash_sample(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(X.hash_share(F.col("o_orderkey")) < 0.05).select("o_orderkey")


@query("""WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), n AS (SELECT p_partkey, count(*) AS n FROM t GROUP BY p_partkey),
c AS (SELECT a.p_partkey AS x, b.p_partkey AS y, count(*) AS shared FROM t a JOIN t b ON a.w = b.w AND a.p_partkey < b.p_partkey GROUP BY 1, 2)
SELECT x, y, round(shared / (a.n + b.n - shared), 6) AS jaccard FROM c JOIN n a ON a.p_partkey = x JOIN n b ON b.p_partkey = y WHERE 2 * shared >= a.n + b.n - shared""")
def token_jaccard_pairs(spark, sf_dir):
    """All parts whose names share half of their words, however common the words; a part in several rows has the words of all. Pairs are looked
    for between distinct sets of words; the parts of a set are put in at the end, so only the result grows with the square of how many share a name."""
    words = F.flatten(F.collect_list(F.split(F.lower("p_name"), " ")))
    parts = table(spark, sf_dir, "part").filter("p_name is not null and p_partkey is not null").groupBy("p_partkey").agg(F.array_sort(F.array_distinct(words)).alias("w"))
    sets = lineage.cut(parts.groupBy("w").agg(F.count("*").alias("n")))
    pairs = curation.similar_sets(sets, "w", 50).select("a", "b", F.round("jaccard", 6).alias("jaccard"))
    same = sets.select(F.col("w").alias("a"), F.col("w").alias("b"), F.lit(1.0).alias("jaccard"))
    return curation.member_pairs(pairs.unionAll(same), sets, parts, "w", "p_partkey")


@query("SELECT c.c_custkey, n.n_name AS entity, 'exact' AS method FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey")
def entity_exact(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("entity"))
    return table(spark, sf_dir, "customer").join(names, "c_nationkey").select("c_custkey", "entity", F.lit("exact").alias("method"))


def _inner_words(k):
    return lambda i: F.xxhash64(F.array_join(F.slice("w", i, k), " "))


def _characters(k):
    return lambda i: F.xxhash64(F.substr(F.col("text"), i, F.lit(k)))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_contamination(spark, sf_dir):
    """Documents that hold a benchmark passage: both meet at the passage's first inner words, six if it has as many, and then the whole
    passage is looked for. A passage's first and last word can be part of a longer word of a document, so they choose nothing; of passages
    without inner words the first characters are looked for. Empty passages are in no document."""
    words = lambda c: F.split(c, "[ \n\t]+")
    items = table(spark, sf_dir, "benchmark").filter("text <> ''").select("item_id", F.col("text").alias("passage"))
    width = F.least(F.size(words(F.col("passage"))) - 2, F.lit(6))
    head = F.when(width > 0, F.array_join(F.slice(words(F.col("passage")), 2, F.greatest(width, F.lit(1))), " ")).otherwise(F.substring("passage", 1, 12))
    kind = F.when(width > 0, width).otherwise(-F.length(head)).alias("kind")  # words, or minus characters
    keys = items.select("item_id", kind, F.xxhash64(head).alias("key"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    w = docs.select("doc_id", "text", words(F.col("text")).alias("w"))
    met = None
    for (k,) in keys.select("kind").distinct().collect():  # at most 18 numbers
        at = F.sequence(F.lit(1), (F.size("w") if k > 0 else F.length("text")) - (abs(k) - 1))
        hashes = F.transform(at, _inner_words(k) if k > 0 else _characters(-k))
        grams = w.filter((F.size("w") if k > 0 else F.length("text")) >= abs(k)).select("doc_id", F.explode(F.array_distinct(hashes)).alias("key"))
        found = grams.join(keys.filter(F.col("kind") == k).select("key", "item_id"), "key").select("doc_id", "item_id")
        met = found if met is None else met.unionAll(found)
    if met is None:
        return docs.join(items, F.lit(False)).select("doc_id", "item_id")
    return met.distinct().join(docs, "doc_id").join(items, "item_id").filter(F.contains("text", "passage")).select("doc_id", "item_id")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_windows(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("hour"), "event_type", "n")


@query("""SELECT user_id, s AS session, count(*) AS events, min(ts) AS started FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
FROM (SELECT user_id, event_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s""")
def sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(w)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("new", F.coalesce((gap > 1800).cast("int"), F.lit(1)))
    return rows.withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("started"))


@query(f"""WITH r AS (SELECT query_id, vec_id, label, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(v, q), vec_id) AS rank FROM {_SET} QUALIFY rank <= 10), l AS (SELECT vec_id AS query_id, label AS own FROM embeddings)
SELECT query_id, count(*) FILTER (label = own) AS hits, round(coalesce(1.0 / min(rank) FILTER (label = own), 0), 6) AS rr FROM r JOIN l USING (query_id) GROUP BY query_id""")
def ir_metrics(spark, sf_dir):
    """Hits at 10 and reciprocal rank of every query of the set: results of its label are relevant."""
    rows, asked = _asked(spark, sf_dir)
    near = retrieval.nearest_of_set(rows, asked).join(rows.select("vec_id", "label"), "vec_id").join(rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    hit = F.col("label") == F.col("own")
    return near.groupBy("query_id").agg(F.sum(hit.cast("long")).alias("hits"), F.round(F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)), 6).alias("rr"))
