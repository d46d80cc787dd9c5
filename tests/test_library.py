"""The library's operators: SQL twins on the smallest tables, readers, policy rules, and stream against batch."""

import datetime
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from evispark.functions import text as X
from evispark.operators import policy, temporal
from evispark.plans import registry
from evispark.sources import readers

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, sql, name):
    df = registry.QUERIES[name](spark, DIR)
    r = sql.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    want = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)
    assert sorted((tuple(plain(x[c]) for c in columns) for x in df.collect()), key=str) == want


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "my-note.md").write_text('---\ntitle: "Plans: next"\n---\nbody')
    (tmp_path / "a" / ".hidden.md").write_text("no")
    (tmp_path / "s.jsonl").write_text('{"x": 1}\n{broken\n\n{"x": 2}\n')
    files = readers.text_folder(spark, str(tmp_path)).filter("source_type = 'markdown_note'")
    got = files.select(readers.title(F.col("path"), F.col("text")).alias("t"), readers.front_matter(F.col("text")).alias("f")).collect()
    assert [tuple(r) for r in got] == [("Plans: next", 'title: "Plans: next"')]
    assert sorted(r.x for r in readers.json_lines(spark, str(tmp_path / "s.jsonl"), "x int").collect()) == [1, 2]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(map(tuple, readers.replace_documents(old, new, ["k"]).collect())) == [(1, "a"), (2, "c")]


def test_policy_rules(spark):
    df = spark.createDataFrame([("5", None), ("x", "a"), (None, "b")], "n string, s string")
    rule = {"any": [{"field": "n", "op": "gte", "value": 5}, {"field": "s", "op": "in", "value": ["b"]}]}
    assert [r[0] for r in df.select(policy.compile_predicate(rule)).collect()] == [True, False, True]
    assert all(r[0] for r in df.select(policy.compile_predicate({})).collect())


def test_valid_time_by_kind(spark):
    df = spark.sql("SELECT k, TIMESTAMP '2024-01-01' s, TIMESTAMP '2024-02-01' e FROM VALUES ('unknown'), ('atemporal'), ('instantaneous'), ('time_bound') t(k)")
    at = lambda x: {r[0] for r in df.filter(temporal.valid_at(F.lit(x).cast("timestamp"), F.col("k"), F.col("s"), F.col("e"))).select("k").collect()}
    assert at("2024-01-01 12:00:00") == {"atemporal", "instantaneous", "time_bound"}
    assert at("2024-02-01") == {"atemporal"}


def test_query_terms():
    assert X.query_terms("What is the PLAN for plan_b of x") == ["plan", "plan_b"]
    assert [X.required_hits(n) for n in (0, 1, 3, 4)] == [0, 1, 1, 2]


def test_benchmark_passages_of_any_length(spark, tmp_path):
    docs = [(1, "xalpha beta gammay"), (2, "some long passage with over six words inside it here"), (3, "tiny"), (4, ""), (5, "alpha beta  gamma"), (6, None)]
    items = [(1, "alpha beta gamma"), (2, "me long passage with over six words inside it he"), (3, "in"), (4, "x"), (5, "no such"), (6, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in registry.QUERIES["benchmark_contamination"](spark, str(tmp_path)).collect()}
    assert got == {(d, i) for d, t in docs for i, p in items if t and p and p in t}


def test_common_words_pair_parts(spark, tmp_path):
    names = ["red box"] * 60 + ["Box red box", "red", "red tin can", "red tin pot lid", "", "", None, "box tin red can"]
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    sets = {k: set(n.lower().split(" ")) for k, n in enumerate(names) if n is not None}
    share = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    want = sorted((x, y, round(share(x, y), 6)) for x in sets for y in sets if x < y and share(x, y) >= 0.5)
    assert sorted(map(tuple, registry.QUERIES["token_jaccard_pairs"](spark, str(tmp_path)).collect())) == want


def test_a_name_of_many_parts_is_paired_in_several_tasks(spark, tmp_path):
    rows = [(k, "red box") for k in range(700)] + [(k, "box tin red") for k in range(700, 1000)] + [(1000, "red"), (1000, "tin"), (None, "red tin")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    got = registry.QUERIES["token_jaccard_pairs"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(c.sql(registry.ORACLES["token_jaccard_pairs"]).fetchall())
    made = [sum(r["task"] == t for r in got if r["y"] < 700) for t in {r["task"] for r in got}]
    assert sum(n > 0 for n in made) > 1 and max(made) < 0.9 * sum(made)


def test_facts_without_a_whole_term_are_not_found(spark, tmp_path):
    docs = [(10, "southern thingently"), (21, "outh thingent"), (32, "southern thingent"), (43, "nothing"), (54, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[0] for r in c.sql(registry.ORACLES["fact_scores"]).fetchall()}
    assert {r["doc_id"] for r in registry.QUERIES["fact_scores"](spark, str(tmp_path)).collect()} == want == {21, 32}


def _written(spark, tmp_path, rows, files=1):
    import random

    random.Random(5).shuffle(rows)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    return c


def test_iso_times_after_the_year_9999(spark, tmp_path):
    rows = [(k, datetime.datetime(2024, 1, 2, 3, 4, 5), 1, "view", 1.0, '{"k": 1}') for k in (0, 1, 2932896, 2932897, 6000000, 36000000)]
    c = _written(spark, tmp_path, rows)
    got = sorted((r["event_id"], r["at_iso"]) for r in registry.QUERIES["iso_times"](spark, str(tmp_path)).collect())
    assert got == sorted((r[0], r[1]) for r in c.sql(registry.ORACLES["iso_times"]).fetchall())


def test_stream_sorts_what_an_item_has_in_several_frames(spark, tmp_path):
    order = lambda k: (k * 7919) % 1009 + k // 20
    rows = [(k, datetime.datetime(2024, 1, 1), None if k % 5 == 4 else k % 2, "view", 1.0, "{}" if k < 40 or k % 11 == 0 else f'{{"k": {order(k)}}}') for k in range(30000)]
    c = _written(spark, tmp_path, rows, 3)
    got = sorted((tuple(r[x] for x in ("event_id", "user_id", "decision")) for r in registry.QUERIES["ops_reconcile_stream"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(c.sql(registry.ORACLES["ops_reconcile_stream"]).fetchall(), key=str)
