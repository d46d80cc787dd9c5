"""Queries over statements, mails and secrets, with SQL where the other engine can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts as W
from ..functions import mail as M
from ..operators import relations as R
from . import clocks

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


STATEMENTS = f"""SELECT f.*, CASE f.id % 6 WHEN 0 THEN 'Customer ' || f.entity_id || ' approved the order for three days' WHEN 1 THEN 'Customer ' || f.entity_id || ' rejected the order for three days' WHEN 2 THEN 'Customer ' || f.entity_id || ' approved the order for 5 days on monday'
 WHEN 3 THEN 'The order of customer ' || f.entity_id || ' was not approved' WHEN 4 THEN 'Customer ' || f.entity_id || ' approved the order for three days, and later moved it to the new warehouse' ELSE 'Shipping costs $' || (f.id % 50) || ' as of 1996-01-0' || (1 + f.id % 9) END AS statement FROM ({clocks.FACTS}) f"""


def _statements(spark, sf_dir):
    return spark.sql(STATEMENTS, orders=_read(spark, sf_dir, "orders"))


@query(f"""WITH s AS (SELECT id, lower(statement) AS t FROM ({STATEMENTS.replace('{orders}', 'orders')})), v AS (SELECT id, unnest(list_concat(list_concat(regexp_extract_all(t, '\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b'), regexp_extract_all(t, '\\b(monday)\\b')), list_concat(list_concat(
 regexp_extract_all(t, '\\b[0-9]+(\\.[0-9]+)?%?\\b'), regexp_extract_all(t, '\\$[0-9,]+')), list_transform(regexp_extract_all(t, '\\bthree days\\b'), lambda x: '3 day')))) AS x FROM s)
SELECT id, string_agg(DISTINCT x, '|' ORDER BY x) AS found FROM v GROUP BY id""")
def material_values(spark, sf_dir):
    """Dates, numbers and amounts of statements."""
    out = _statements(spark, sf_dir).select("id", F.array_join(W.material_values(F.col("statement")), "|").alias("found"))
    return out.filter("found <> ''")


@query(f"""SELECT a.id, regexp_matches(lower(a.statement || ' ' || b.statement), '\\b(became|becomes|current|currently|earlier|final|formerly|later|moved|new|now|previous|previously|then|updated)\\b') AS progress FROM ({STATEMENTS.replace('{orders}', 'orders')}) a JOIN ({STATEMENTS.replace('{orders}', 'orders')}) b ON b.id = a.id + 1""")
def progression_pairs(spark, sf_dir):
    s = _statements(spark, sf_dir).select("id", "statement")
    nxt = s.select((F.col("id") - 1).alias("id"), F.col("statement").alias("other"))
    return s.join(nxt, "id").select("id", W.progression(F.col("statement"), F.col("other")).alias("progress"))


@query()
def fact_relations(spark, sf_dir):
    """Each customer's newest fact against its others. Ratios of matching blocks have no SQL; tests apply the rules in Python."""
    f = R.prepared(_statements(spark, sf_dir).filter("status <> 'open'").withColumn("sources", F.array((F.col("id") % 3).cast("string"), F.lit("x"))))
    return R.classify(R.pairs_of_entity(f, "entity_id", "created_at")).select("new_id", "old_id", "relation", "confidence")


@query(f"""WITH s AS (SELECT id, statement, entity_id, id % 2 = 0 AS confirmed, round(0.5 + (id % 10) / 20.0, 2) AS confidence, created_at FROM ({STATEMENTS.replace('{orders}', 'orders')}) WHERE id % 6 < 2)
SELECT entity_id, arg_max(id, (confirmed, confidence, created_at, id)) AS id FROM s GROUP BY entity_id""")
def cluster_keepers(spark, sf_dir):
    """The fact that a merge of each customer's statements keeps."""
    s = _statements(spark, sf_dir).filter("id % 6 < 2").withColumns({"confirmed": F.col("id") % 2 == 0, "confidence": F.round(0.5 + (F.col("id") % 10) / 20.0, 2), "observed_at": F.lit(None).cast("string")})
    return R.keepers(s, "entity_id")


@query(f"""SELECT entity_id, count(*) AS facts, max(round(0.5 + (id % 10) / 20.0, 2)) AS confidence, max(created_at) AS observed_at, string_agg(DISTINCT 'src' || (id % 4), ',' ORDER BY 'src' || (id % 4)) AS sources FROM ({STATEMENTS.replace('{orders}', 'orders')}) GROUP BY entity_id""")
def merged_clusters(spark, sf_dir):
    s = _statements(spark, sf_dir).withColumns({"confidence": F.round(0.5 + (F.col("id") % 10) / 20.0, 2), "observed_at": F.col("created_at"), "sources": F.array(F.concat(F.lit("src"), (F.col("id") % 4).cast("string")))})
    return R.merged_values(s, "entity_id").withColumn("sources", F.array_join("sources", ","))


_MAIL = "SELECT conv_id, turn, coalesce(text, '') || chr(10) || chr(10) || chr(10) || CASE turn % 4 WHEN 0 THEN '> quoted' || chr(10) || 'after  it ' WHEN 1 THEN 'On Monday somebody wrote:' || chr(10) || 'gone' WHEN 2 THEN 'From: a@b.org' || chr(10) || 'To: c' || chr(10) || 'Subject: d' || chr(10) || 'gone' ELSE 'From: here on' || chr(10) || 'kept' END AS body FROM {conversations}"


@query(f"""WITH l AS (SELECT conv_id, turn, i, x, regexp_matches(x, '(?i)^\\s*on .{{1,500}} wrote:\\s*$') OR (regexp_matches(x, '(?i)^\\s*from: .+') AND turn % 4 = 2) AS ends FROM (SELECT conv_id, turn, unnest(generate_series(1, len(w))) AS i, unnest(w) AS x FROM (SELECT conv_id, turn, string_split(body, chr(10)) AS w FROM ({_MAIL.replace('{conversations}', 'conversations')})))),
k AS (SELECT conv_id, turn, i, trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ') AS x FROM l WHERE i < coalesce((SELECT min(i) FROM l m WHERE m.conv_id = l.conv_id AND m.turn = l.turn AND m.ends), 100000) AND NOT starts_with(ltrim(x, ' '), '>')),
b AS (SELECT *, lag(x) OVER (PARTITION BY conv_id, turn ORDER BY i) AS before FROM k) SELECT conv_id, turn, trim(string_agg(x, chr(10) ORDER BY i), chr(10) || ' ') AS said FROM b WHERE x <> '' OR before IS NULL OR before <> '' GROUP BY conv_id, turn""")
def own_words(spark, sf_dir):
    """What each mail says itself, without quotations."""
    m = spark.sql(_MAIL, conversations=_read(spark, sf_dir, "conversations"))
    return m.select("conv_id", "turn", M.without_quotes(F.col("body")).alias("said")).groupBy("conv_id", "turn").agg(F.max("said").alias("said"))


_LOG = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Authorization: Bearer abc.' || event_id WHEN 1 THEN 'my_api_key = k' || event_id || ' and more' WHEN 2 THEN 'uses sk-' || event_id || ' here' WHEN 3 THEN ' plain ' || event_id ELSE 'ACCESS_TOKEN: \"t' || event_id || '\" x' END AS line FROM {events}"


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Authorization: Bearer [redacted]' WHEN 1 THEN 'my_api_key = [redacted] and more' WHEN 2 THEN 'uses [redacted] here' WHEN 3 THEN 'plain ' || event_id ELSE 'ACCESS_TOKEN: "[redacted]" x' END AS line FROM events""")
def redacted_logs(spark, sf_dir):
    return spark.sql(_LOG, events=_read(spark, sf_dir, "events")).select("event_id", M.redacted_log(F.col("line")).alias("line"))


@query("""SELECT doc_id, length(text) AS n, regexp_matches(text, '\\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,})\\b') AS mail, regexp_matches(text, '\\b(([0-9]{4}[ -]?){3}[0-9]{4})\\b') AS card, regexp_matches(text, '\\b(([0-9]{1,3}\\.){3}[0-9]{1,3})\\b') AS address FROM documents""")
def secret_findings(spark, sf_dir):
    """Lengths of masked texts (as before) and which personal data they held."""
    kinds = M.secret_kinds(F.col("text"))
    has = lambda k: F.array_contains(kinds, k)
    return _read(spark, sf_dir, "documents").select("doc_id", F.length(M.masked(F.col("text"))).cast("long").alias("n"), has("mail_address").alias("mail"), has("card_number").alias("card"), has("address").alias("address"))


@query("""SELECT doc_id, 0 AS left_over FROM documents WHERE regexp_matches(text, '@[a-z]') OR regexp_matches(text, '(?i)\\b(password|token|secret)\\b *[:=]')""")
def masked_texts(spark, sf_dir):
    """Documents that named secrets or addresses, and how many are left after the mask."""
    d = _read(spark, sf_dir, "documents").filter(F.col("text").rlike("@[a-z]") | F.col("text").rlike(r"(?i)\b(password|token|secret)\b *[:=]"))
    return d.select("doc_id", F.size(F.array_intersect(M.secret_kinds(M.masked(F.col("text"))), F.array(F.lit("mail_address"), F.lit("card_number"), F.lit("access_key")))).alias("left_over"))
