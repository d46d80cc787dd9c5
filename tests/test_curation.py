"""Chunking, hashed vectors, curation folds and review admission against plain sequential versions."""

import random

import pytest
from pyspark.sql import functions as F

from evispark.operators import chunks, curation


def test_heading_chunks(spark):
    text = "intro\n# A\none\n### B\ntwo three four five\n## C  \nsix\n#no heading\n####### nor this\n"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    got = chunks.chunks(df, True, target=4, overlap=1).orderBy("doc_id", "chunk").collect()
    one = [r for r in got if r.doc_id == 1]
    assert [r.heading_path for r in one][:3] == ["", "A", "A > B"]
    assert {r.heading_path for r in one} == {"", "A", "A > B", "A > C"}
    assert [r.chunk for r in one] == list(range(len(one)))
    assert all(text[r.start : r.stop].strip() == r.text and r.words <= 4 for r in one)
    assert [r.text for r in one if r.heading_path == "A > B"] == ["### B\ntwo three", "three four five"]
    assert [tuple(r)[:4] for r in got if r.doc_id != 1] == [(2, 0, "", "")]


def test_paragraph_chunks(spark):
    text = "a b\n\nc d\n\n\n\ne f g h i\n\nj"
    df = spark.createDataFrame([(1, text), (2, " \n\n ")], "doc_id int, text string")
    got = chunks.chunks(df, False, target=4, overlap=1).orderBy("chunk").collect()
    assert [r.text for r in got] == ["a b\n\nc d", "e f g h", "h i", "j"]
    assert all(r.doc_id == 1 and text[r.start : r.stop].strip() == r.text for r in got)


def test_hashed_vector(spark):
    df = spark.createDataFrame([("Plan plan B",), ("plan",), ("",), (None,)], "t string")
    a, b, empty, none = [r[0] for r in df.select(chunks.hashed_vector(16)(F.col("t"))).collect()]
    assert none is None and abs(sum(x * x for x in a) - 1) < 1e-12 and sum(x != 0 for x in b) == 1 and sum(x != 0 for x in empty) == 1
    assert sum(x * y for x, y in zip(a, b)) == pytest.approx(2 / 5**0.5, abs=0.5)


def test_admissions(spark):
    rng = random.Random(5)
    for active, daily, historical in ((6, 4, 2), (50, 3, 0), (3, 50, 5), (0, 4, 1)):
        items = [(i, rng.randrange(4), *rng.choice([(True, False), (False, True), (False, False)])) for i in range(40)]
        n_active = n_today = n_old = 0
        want = {}
        for i, _, hard, old in sorted(items, key=lambda x: (x[1], x[0])):
            if hard:
                want[i] = "hard_boundary"
            elif old and n_old >= historical:
                want[i] = "historical_capacity"
            elif n_active < active and n_today < daily:
                want[i] = "daily_budget"
                n_today, n_old = n_today + 1, n_old + old
            else:
                want[i] = "capacity"
            n_active += want[i] in ("hard_boundary", "daily_budget")
        df = spark.createDataFrame(items, "id int, p int, hard boolean, historical boolean")
        got = {r.id: r for r in curation.admissions(df, "id", ["p"], active, daily, historical).collect()}
        assert {k: r.reason for k, r in got.items()} == want
        assert all((r.state == "admitted") == (r.reason in ("hard_boundary", "daily_budget")) for r in got.values())


def test_chains_of_moves(spark):
    moves = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21)], "old int, new int")
    assert {r.old: r.new for r in curation.settle(moves).collect()} == {**{i: 9 for i in range(9)}, 20: 21}
    with pytest.raises(ValueError):
        curation.settle(spark.createDataFrame([(1, 2), (2, 1)], "old int, new int"))


def test_last_writes_keep_what_nulls_leave(spark):
    state = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, page string, status string")
    log = spark.createDataFrame([(1, 1, "c", None), (1, 2, None, "z"), (1, 3, "d", None), (9, 4, "e", "e")], "id int, seq int, page string, status string")
    assert sorted(map(tuple, curation.last_writes(state, log, "id", "seq", ["page", "status"]).collect())) == [(1, "d", "z"), (2, "b", "y")]


def test_stems_and_overlaps(spark):
    from evispark.functions import facts as S

    row = spark.sql("SELECT 'Policies pass, planning planned plans as the class' a, 'plan class' b, CAST(NULL AS STRING) c").select(
        S.stems(F.col("a")).alias("s"), S.overlap(S.stems(F.col("a")), S.stems(F.col("b"))).alias("o"), S.jaccard(S.stems(F.col("c")), S.stems(F.col("c"))).alias("j"), S.references(F.col("c")).alias("r")).first()
    assert row.s == ["policy", "pass", "plann", "plan", "as", "the", "class"] and row.o == 1.0 and row.j == 0.0
