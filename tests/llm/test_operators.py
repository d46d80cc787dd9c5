"""Each operator against a brute-force twin, on rows with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from evispark.llm import ann, cells, langid, licenses, mixing, neardup, packing, quality, sadedup, sharding, topk

DDL = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, kept boolean"


def rows():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(120).split(), say(30)
    texts = [say(rng.randint(1, 150)) for _ in range(40)]
    for k in range(12):  # near copies
        t = list(base)
        for _ in range(k // 2):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [texts[3]] * 9 + [f"{say(20)} {passage} {say(10)}" for _ in range(5)] + [None, "", " \n", "12 34 !", "é" * 60, "Ünï " * 40, say(30000)]
    out = [(i, t, "ab"[i % 2] if i % 7 else None, "hot" if i % 3 else None, len(t or ""), 1, 0.5, False) for i, t in enumerate(texts)]
    return out + [out[5], (None, texts[3], None, None, 0, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def test_shards(docs, none):
    got = sharding.shard_rows(docs.drop("score"), 5).collect()
    sizes = [sum(r.shard == k for r in got) for k in range(5)]
    assert len(got) == len(rows()) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(n)) for k, n in enumerate(sizes))
    assert sharding.shard_rows(none, 5).count() == 0
    # places don't follow ids: over 400 rows each shard has about a fifth of each half
    many = sharding.shard_rows(docs.sparkSession.range(4000), 5).collect()
    halves = [sum(r.shard == k and r.id < 2000 for r in many) for k in range(5)]
    assert sum((x - 400) ** 2 / 320 for x in halves) < 25 and abs(np.corrcoef([r.id for r in many], [r.slot for r in many])[0, 1]) < 0.1
    m = sharding.communication_matrix([10, 0, 7, 30], 4, 3)
    assert m.sum(1).tolist() == [10, 0, 7, 30] and np.ptp(m.sum(0)) <= 1
    assert sharding.communication_matrix([2 * 10**9, 10**9], 3, 0).sum(0).tolist() == [10**9] * 3


def test_hypergeometric_laws_agree():
    """The rejection sampler against numpy's, which populations under 10^9 use, by mean, variance and tails."""
    rng = np.random.default_rng(5)
    for good, bad, n in ((500, 1500, 300), (3, 40, 20), (10_000, 10_000, 5_000)):
        mine = np.array([sharding.rejected(rng, good, bad, n) for _ in range(6000)])
        theirs = rng.hypergeometric(good, bad, n, 60_000)
        assert abs(mine.mean() - theirs.mean()) < 5 * theirs.std() / np.sqrt(6000) and abs(mine.std() / theirs.std() - 1) < 0.05
        for q in (0.05, 0.5, 0.95):
            at = np.quantile(theirs, q)
            assert abs((mine <= at).mean() - (theirs <= at).mean()) < 0.03
    big = [sharding.hypergeometric(rng, 10**11, 9 * 10**11, 10**9) for _ in range(50)]
    assert abs(np.mean(big) / 1e8 - 1) < 1e-4 and 3000 < np.std(big) < 20_000


def test_op2_query(spark):
    import pyarrow.parquet as pq

    want = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()}
    got = sharding.op2_hypergeometric_shards(spark, "/root/testdata/sf0.001").collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(d, len(b) + 1, zlib.crc32(b)) for d, b in want.items()} and len(got) == len(want)
    sizes = [sum(r.shard == k for r in got) for k in range(16)]
    assert sum(sizes) == len(want) and max(sizes) - min(sizes) <= 1 and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k])) for k in range(16))


def test_mixing(docs, none):
    got = mixing.mix_sources(docs, weights={"hot": 1.0}, target_rows=500).collect()
    assert {r.source for r in got} == {"hot"} and abs(len(got) - 500) < 120
    assert sorted(r.position for r in got) == list(range(len(got)))
    again = mixing.mix_sources(docs.repartition(2), weights={"hot": 1.0}, target_rows=500).collect()
    assert sorted((r.doc_id, r.copy, r.position) for r in got if r.doc_id is not None) == sorted((r.doc_id, r.copy, r.position) for r in again if r.doc_id is not None)
    assert mixing.mix_sources(none).count() == 0
    nulls = mixing.mix_sources(docs).filter("source is null").count()
    assert 0 < nulls < 2 * len(rows())
    clash = docs.withColumnsRenamed({"shard": "copies", "score": "rate", "kept": "position"})
    assert len(mixing.mix_sources(clash).columns) == len(set(mixing.mix_sources(clash).columns))


def test_mixing_with_salted_rates(docs, monkeypatch):
    want = sorted((r.doc_id or -1, r.copy, r.rate) for r in mixing.mix_sources(docs, position=False).collect())
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 0)
    assert sorted((r.doc_id or -1, r.copy, r.rate) for r in mixing.mix_sources(docs, position=False).collect()) == want


def test_positions_of_equal_keys_are_gapless(spark):
    from pyspark.sql import functions as F

    from evispark.llm.common import rank_in

    df = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("x"))
    got = [r.at for r in rank_in(df.withColumn("g", F.lit(0)), ["g"], F.xxhash64("x"), "at", rows_per_part=50).collect()]
    assert sorted(got) == list(range(3000))


def test_mean_of_large_poisson_rates(spark):
    df = spark.range(300).selectExpr("id as doc_id", "'s' as source")
    got = mixing.mix_sources(df, weights={"s": 1.0}, target_rows=300 * 900, position=False).count()
    assert abs(got / 300 / 900 - 1) < 0.02


def shingles(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("width,least", [(3, 85), (5, 80)])
def test_near_duplicates(docs, none, width, least):
    sets = {r[0]: shingles(r[1], width) for r in rows() if r[0] is not None}
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                i = len(sets[a] & sets[b])
                if i and 100 * i >= least * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    got = neardup.near_duplicates(docs, width, least).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id), r
    assert neardup.near_duplicates(none).count() == 0


def test_rows_of_one_id_are_rows_of_their_own(spark):
    a, b = "one two three four five six seven", "quite another text that nobody else has written"
    df = spark.createDataFrame([(1, a, "x"), (2, b, "y"), (2, a, "z"), (2, a, "z"), (None, a, "n"), (3, None, "e"), (3, None, "e"), (4, "", "v")], "doc_id long, text string, packed string")
    got = neardup.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (2, 2, True), (3, 3, True), (3, 3, True), (4, 4, True)]
    left = neardup.distinct_texts(df)
    assert left.schema == df.schema
    assert sorted(map(repr, left.collect())) == sorted(map(repr, [r for r in df.collect() if not (r.doc_id == 2 and r.text == a)]))


def test_bands_follow_the_threshold():
    for t in (50, 70, 80, 85, 95):
        assert (1 - (t / 100) ** neardup.band_rows(t)) ** neardup.BANDS <= neardup.MISS
    assert neardup.band_rows(85) == 8


def test_a_block_gives_as_many_links_as_join_its_groups():
    import pyarrow as pa
    import zstandard

    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words + [f"end{k}"]) for k in range(40)] + [" ".join(f"{c}{k}" for k in range(50)) for c in "xy"]
    ids = [7 * k + 3 for k in range(len(texts))]
    block = pa.table({"row": ids, "root": ids, "packed": [zstandard.compress(x.encode()) for x in texts]})
    got = neardup._block_links(3, 85)(block)
    assert len(got) == 39 and {x for c in "ab" for x in got[c].to_pylist()} == set(ids[:40])
    r = np.random.default_rng(2)
    for n, m in ((1, 0), (9, 40), (60, 50), (300, 5000)):
        a, b = r.integers(0, n, (2, m))
        kept = neardup._forest(a, b, n)
        find = lambda x, y: [min(z for z in range(n) if c[z] == c[k]) for c in [_joined(x, y, n)] for k in range(n)]
        assert find(a, b) == find(a[kept], b[kept]) and len(kept) == n - len(set(_joined(a, b, n)))


def _joined(a, b, n):
    c = list(range(n))
    for x, y in zip(a, b):
        c = [c[x] if z == c[y] else z for z in c]
    return c


def test_links_inside_a_family_just_under_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 1 << 17)  # several blocks a bucket
    base = " ".join(f"t{i}" for i in range(185))  # 183 of 200 shingles: 0.843; with the next two words 185: 0.860
    family = [(k, f"{base} p{k // 2} q{k // 2} " + " ".join(f"u{k}x{i}" for i in range(15))) for k in range(1200)]
    got = neardup.near_duplicates(spark.createDataFrame(family, "doc_id long, text string").repartition(4), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k - k % 2 for k in range(1200)}


def test_overlaps_of_rare_and_common_elements():
    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([rng.integers(0, 60, 40), rng.integers(100, 3000, n)])).astype(np.uint64) for n in rng.integers(0, 300, 120)]
    some = np.array([3, 50, 119])
    got = neardup._overlaps(sets, some)
    assert all(got[i, j] == len(np.intersect1d(sets[s], t)) for i, s in enumerate(some) for j, t in enumerate(sets) if j != s)


def test_components_follow_long_chains(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100)]
    got = dict(neardup.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


@pytest.mark.parametrize("alphabet", [2, 4, 250])
@pytest.mark.parametrize("depth", [8, 50])
def test_two_stage_suffix_array(alphabet, depth):
    text = np.random.default_rng(alphabet).integers(0, alphabet, 700).astype(np.uint8)
    order = sadedup.two_stage_suffix_array(text, depth)
    raw = text.tobytes()
    prefixes = [raw[i : i + depth] for i in order]
    assert sorted(order) == list(range(700)) and prefixes == sorted(prefixes)


def test_repeats(docs, none):
    seen, want = {}, {}
    data = [(d, (t or "").encode()) for d, t, *_ in rows()]
    for d, b in data:
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            if d is not None:
                seen[s] = min(seen.get(s, d), d)
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and seen[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    got = sadedup.remove_repeats(docs, 50, with_text=True, carry=("lang", "source"), block_bytes=2000).collect()
    assert len(got) == len(data)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id], r.doc_id
        assert (r.lang, r.source) in {(x[2], x[3]) for x in rows() if x[0] == r.doc_id}
    assert sadedup.remove_repeats(none, 50).count() == 0


def test_repeats_in_texts_longer_than_a_window(docs, monkeypatch):
    want = sorted(map(repr, sadedup.remove_repeats(docs, 50).collect()))
    monkeypatch.setattr(sadedup, "LONGEST", 700)
    monkeypatch.setattr(sadedup, "slices", lambda offsets, most=0: ((i, i + 1) for i in range(len(offsets) - 1)))
    assert sorted(map(repr, sadedup.remove_repeats(docs.repartition(1), 50).collect())) == want
    clash = docs.withColumnsRenamed({"kept": "n_bytes", "score": "block"})
    assert sadedup.remove_repeats(clash, 50, carry=("n_bytes", "block", "lang")).columns[-1] == "lang"


def test_a_passage_in_all_rows_meets_in_many_tasks(spark, monkeypatch):
    """No sorting task gets all that stands around a passage, and the result is brute force's."""
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, most = say(70), 60_000
    data = [(i, f"{say(60)}{passage[rng.randint(0, 9) :]}{say(60)}") for i in range(900)]
    data += [(i + 900, data[i][1]) for i in range(0, 900, 9)] + [(5, say(40) + passage)]
    seen, want = {}, {}
    for d, t in data:
        for i in range(len(t) - 49):
            seen[t[i : i + 50]] = min(seen.get(t[i : i + 50], d), d)
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if seen[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        want[d, len(t)] = (sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(t.encode(), gone) if not g)).hexdigest())
    real = sadedup._repeats

    def bounded(length):
        sort = real(length)

        def run(key, table):
            texts = set()
            for r in table.column("packed").to_pylist() if key[0].as_py() >= 0 else ():
                text, size, *_ = sadedup._unpack(r)
                ends = np.cumsum(size.astype(int)).tolist()
                texts.update(text[e - s : e].tobytes() for s, e in zip(size.tolist(), ends))
            assert sum(map(len, texts)) <= most, sum(map(len, texts))
            return sort(key, table)

        return run

    monkeypatch.setattr(sadedup, "_repeats", bounded)
    got = sadedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(3), 50, block_bytes=20_000, bucket_bytes=30_000).collect()
    assert len(got) == len(data)
    for r in got:
        assert tuple(r)[2:] == want[r.doc_id, r.n_bytes], r.doc_id


def test_packing(docs, none):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.tiktoken"), open_windows=4, special=packing.SPECIAL).collect()
    by_doc, by_window = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for d, text, *_ in rows():
        if d in (None, 5):
            continue
        pieces = sorted(by_doc[d], key=lambda r: r.start)
        assert np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids + [0]
    for pieces in by_window.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    assert len(by_window) <= sum(r.length for r in got) / 1024 + 2
    assert packing.pack_documents(none, P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_word_coder_agrees_on_odd_spaces():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coder = packing.WordCoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, packing.SPECIAL)
    end = "<|endoftext|>"
    for text in [end, f"{end} a", f"a {end} b", f"a{end}", f" {end}{end} ", f"a  {end}  b", "<|endoftext", f"<{end}>", "", " ", "a b", " a", "a ", "a  b", "a \n b", "\n a", "a  b  c", "I'll go's <|endoftext|> x", "é 12 3!  ?", "\t x"]:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_language(docs, none):
    model = langid.learn(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert {r.lang_pred for r in langid.predict(docs, langid.learn(none)).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0
    for k in (2, 4, 6, 9, 30):
        code = langid.codewords(k)
        assert len({tuple(c) for c in code}) == k


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    got = langid.op7_ecoc_language(spark, "/root/testdata/sf0.001").join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_quality_on_held_out_documents(spark):
    got = quality.op5_qda_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_quality_edges(spark, docs, none):
    stats = quality.with_statistics(docs)
    assert stats.count() == len(rows())
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    got = quality.score(stats, quality.fit(stats, labels)).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert quality.score(quality.with_statistics(none), quality.fit(quality.with_statistics(none), labels)).count() == 0


def naive_statistics(text):
    """The features of a text, counted one by one."""
    b = (text or "").encode()
    n, words, lines = len(b), re.findall(rb"[^\x20\x09-\x0D]+", b), re.findall(rb"[^\n]+", b)
    of = lambda chars: (sum(x in chars for x in b) / max(n, 1)) ** 0.5
    counts = [b.count(bytes([x])) / n for x in set(b)] if n else []
    many = max(len(words), 1)
    copies = sum(len(x) for x in lines) - sum(len(x) for x in set(lines))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), of(range(65, 91)), of(range(48, 58)), of(b".,;:!?'\"()-"), of(b"#$%&*@^~_=+<>/\\[]{}`"), of(b"|"), of(range(128, 256)),
        np.log1p(sum(map(len, words)) / many), np.log((len(set(words)) + 1) / (len(words) + 1)), (max([words.count(x) for x in set(words)], default=0) / many) ** 0.5, (copies / max(n, 1)) ** 0.5,
        (sum(65 <= x[0] < 91 for x in words) / many) ** 0.5, (sum(len(x) <= 3 for x in words) / many) ** 0.5, -sum(p * np.log2(p) for p in counts),
    ]


def test_statistics_against_counting(docs):
    got = {}
    for r in quality.with_statistics(docs).collect():
        got.setdefault(r.doc_id, []).append(r.x)
    for d, t, *_ in rows():
        if len(t or "") < 5000:
            assert any(np.allclose(x, naive_statistics(t), atol=1e-9) for x in got[d]), d


def test_discriminant_against_densities():
    """Mahalanobis log-density differences by inverses and determinants of the shrunk covariances."""
    rng = np.random.default_rng(2)
    x, y = np.concatenate([rng.normal(0, 1, (80, 3)), rng.normal(1, 2, (60, 3))]), np.array([0] * 80 + [1] * 60)
    model = quality.Discriminant(x, y)
    z = (x - x.mean(0)) / (x.std(0) + 1e-3)
    both = [z[y == 0], z[y == 1]]
    pooled = sum(((a - a.mean(0)).T @ (a - a.mean(0))) for a in both) / len(z)
    logs = []
    for a in both:
        cov = 0.7 * (a - a.mean(0)).T @ (a - a.mean(0)) / len(a) + 0.3 * pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(pooled) + 0.05)
        logs.append([-0.5 * (r - a.mean(0)) @ np.linalg.inv(cov) @ (r - a.mean(0)) - 0.5 * np.log(np.linalg.det(cov)) for r in z])
    assert np.allclose(model.difference(x), np.arcsinh(np.subtract(logs[1], logs[0])))


def test_quality_labels(spark, docs):
    stats = quality.with_statistics(docs).cache()
    once = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    odd = once.unionAll(once).unionAll(spark.createDataFrame([(3, None), (None, 1), (4, 7)], "doc_id long, label int"))
    a, b = (quality.score(stats.withColumnRenamed("doc_id", "doc_id"), quality.fit(stats, x)).collect() for x in (once, odd))
    assert np.allclose(sorted(r.score for r in a), sorted(r.score for r in b))
    from pyspark.sql import functions as F

    assert quality.score(stats.withColumn("score", F.lit("old")), quality.fit(stats, once)).columns == ["doc_id", "x", "score"]


def naive_language(texts, langs, asked):
    """Counts, bit classifiers and loss-weighted decoding by loops."""
    def grams(t):
        low = bytes(x + 32 if 65 <= x < 91 else x if 97 <= x < 123 or x >= 128 else 32 for x in (t or "").encode())
        return [(((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> 19 for a, b, c in zip(low, low[1:], low[2:]) if (a, b, c) != (32, 32, 32)]

    names = sorted({x for x in langs if x is not None})
    counts = {x: np.zeros(langid.DIMS) for x in names}
    for t, x in zip(texts, langs):
        for g in grams(t) if x is not None else ():
            counts[x][g] += 1
    share = {x: (counts[x] + 0.5) / (counts[x].sum() + 0.5 * langid.DIMS) for x in names}
    code, bits, apart = langid.codewords(len(names)), [], []
    for bit in code.T:
        one, two = (np.mean([share[x] for x, s in zip(names, bit) if s == side], axis=0) if side in bit else np.full(langid.DIMS, 1 / langid.DIMS) for side in (1, -1))
        bits.append(np.log(one) - np.log(two))
        apart.append(((one - two) * bits[-1]).sum())
    out = []
    for t in asked:
        g = grams(t)
        loss = [sum(a / np.mean(apart) * np.log1p(np.exp(-c * sum(w[i] for i in g) / np.sqrt(len(g) + 1))) for a, c, w in zip(apart, word, bits)) for word in code]
        out.append((names[int(np.argmin(loss))], 1 / sum(np.exp(min(loss) - x) for x in loss)))
    return out


def test_language_against_loops(spark):
    import pyarrow.parquet as pq

    some = pq.read_table("/root/testdata/sf0.001/documents.parquet").slice(0, 60).to_pylist()
    df = spark.createDataFrame([(r["doc_id"], r["text"][:300], r["lang"]) for r in some], "doc_id long, text string, lang string")
    want = naive_language([r["text"][:300] for r in some], [r["lang"] for r in some], [r["text"][:300] for r in some])
    got = {r.doc_id: r for r in langid.predict(df, langid.learn(df)).collect()}
    for r, (lang, score) in zip(some, want):
        assert got[r["doc_id"]].lang_pred in (lang, "und") and (got[r["doc_id"]].lang_pred == "und" or abs(got[r["doc_id"]].score - score) < 1e-3)


def vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((400, 16))
    v[50:80] = v[49]
    out = [(i, [float(np.float32(x)) for x in r], "x") for i, r in enumerate(v)]
    out += [(1000, None, "x"), (1100, [float("nan")] * 16, "x"), (1200, [None] * 16, "x"), (1300, [1.0], "x"), (1400, [], "x"), (None, [1.0] * 16, "x")]
    return spark.createDataFrame(out, "vec_id long, embedding array<float>, rank string"), np.array([r[1] for r in out[:400]])


@pytest.fixture(params=["one cell", "many cells and runs"])
def layout(request, monkeypatch):
    if request.param != "one cell":
        monkeypatch.setattr(cells, "CELL_ROWS", 50)
        monkeypatch.setattr(cells, "RUN_NUMBERS", 30 * 16)
        monkeypatch.setattr(cells, "QUERY_ROWS", 6)


def test_nearest(spark, layout):
    df, v = vectors(spark)
    got = ann.nearest(df, df.filter("vec_id % 20 = 0"), 10).collect()
    hits = 0
    for i in range(0, 400, 20):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        d[i] = np.inf
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
        assert len(mine) == 10 and np.allclose([s for _, _, s in mine], d[[x for _, x, _ in mine]], rtol=1e-12)
        hits += len({x for _, x, _ in mine} & set(np.lexsort((np.arange(400), d))[:10]))
    assert hits >= 0.9 * 200 and {r.query_id for r in got} == set(range(0, 400, 20))
    assert ann.nearest(df.limit(0), df, 10).count() == 0
    assert ann.nearest(df.filter("vec_id < 4"), df.filter("vec_id = 0"), 10).count() == 3


def test_search_verifies_part_of_the_rows():
    v = np.random.default_rng(1).standard_normal((4000, 64))
    search = ann.TreeSearch(ann.projection(64))
    state = search.prepare(np.arange(4000), v)
    search(state, np.arange(20), np.arange(20), v[:20], np.full(20, np.inf), 10)
    assert search.verified < 0.8 * 20 * 4000


def test_op1_recall(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    ids, v = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), float)
    got = ann.op1_stable_projection_neighbours(spark, "/root/testdata/sf0.01").collect()
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]].tolist()
        hits, total = hits + len({r.vec_id for r in got if r.query_id == ids[q]} & set(want)), total + 10
    assert len(got) == total and hits >= 0.9 * total


def test_query_rows_of_one_id_get_lists_of_their_own(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (0, [9.0, 0.0]), (1, [0.0, 2.0]), (2, [8.0, 0.0]), (1, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(df, df.filter("vec_id = 0"), 2).collect())
    assert got == [(0, 1, 1, 1.0), (0, 1, 2, 1.0), (0, 2, 1, 1.0), (0, 2, 1, round(85**0.5, 6))]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_products(df, df.filter("vec_id = 0"), 1, scale=1).collect())
    assert got == [(0, 1, 1, 2), (0, 1, 2, 72)]


def test_top_products(spark, layout):
    df, v = vectors(spark)
    z = np.floor(256 * v)
    got = topk.top_products(df, df.filter("vec_id % 20 = 0"), 5).collect()
    for i in range(0, 400, 20):
        s = z @ z[i]
        s[i] = -np.inf
        want = [(k + 1, int(j), int(s[j])) for k, j in enumerate(np.lexsort((np.arange(400), -s))[:5])]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i) == want
    assert topk.top_products(df.limit(0), df, 5).count() == 0


@pytest.mark.parametrize("size", [1e6, 1e12, 1e30])
def test_products_of_any_size_are_exact(spark, size):
    v = np.random.default_rng(4).standard_normal((60, 6)) * size
    v[1::2] = np.nextafter(v[::2], np.inf)  # products that differ in the last bits
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    whole = [[int(x) if abs(x) > 2**53 else int(np.floor(x)) for x in r * 256.0] for r in v]
    got = topk.top_products(df, df.filter("vec_id % 10 = 0"), 5).collect()
    for i in range(0, 60, 10):
        score = {j: sum(a * b for a, b in zip(whole[i], whole[j])) for j in range(60) if j != i}
        want = sorted(score, key=lambda j: (-score[j], j))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
        assert [j for _, j, _ in mine] == want and [s for *_, s in mine] == [min(score[j], 2**63 - 1) for j in want]


def test_licenses(spark):
    files = [
        ("LICENSE", "Released under the MIT License.", 1), ("a/x.py", "code", 1), ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0.", 1), ("a/b/c/y.py", None, 1), ("a/b/z.py", "# Licensed under CC BY-NC 4.0.\nmore", 1),
        (None, "Released under the MIT License.", 1), ("a/x.py", "code", 2), ("top.py", "", 1),
    ]
    got = {(r.path, r.k): (r.license, r.origin, r.licensed_by) for r in licenses.license_scan(spark.createDataFrame(files, "path string, text string, k int")).collect()}
    assert got["a/x.py", 1] == got["a/x.py", 2] == ("MIT", "inherited", "LICENSE")
    assert got["a/b/c/y.py", 1] == ("Apache-2.0", "inherited", "a/b/LICENSE.txt")
    assert got["a/b/z.py", 1] == ("CC-BY-NC-4.0", "own", "a/b/z.py")
    assert got[None, 1] == ("MIT", "own", None) and got["top.py", 1][0] == "MIT" and len(got) == len(files)
    assert licenses.license_scan(spark.createDataFrame([], "path string, text string, score int")).count() == 0


def test_real_licence_files(spark):
    texts = dict(licenses.templates()[: len(licenses.os.listdir(licenses.TEXTS))])
    owner = "Copyright (c) 2019 The Example Authors\n\n"
    files = [(f"{name}/LICENSE", owner + text.replace("<year> <owner>", "2020 Somebody")) for name, text in texts.items()] + [(f"{name}/src/a.c", "int x;") for name in texts]
    apache = licenses.NOTICES[1][1]
    heads = {
        "h/spdx.js": ("// SPDX-License-Identifier: MIT\nlet x = 1;", "MIT"), "h/spdx.rs": ("// SPDX-License-Identifier: Apache-2.0\nfn f() {}", "Apache-2.0"), "h/later.c": ("/* SPDX-License-Identifier: GPL-2.0-or-later */\nint y;", "GPL-2.0"),
        "h/g.py": ("# Copyright 2020 Example Inc.\n#\n" + "\n".join(f"# {x}" for x in apache.split(". ")) + "\n\nimport os\n", "Apache-2.0"),
        "h/m.cpp": ("/* " + licenses.NOTICES[-2][1] + " */\nint z;", "MPL-2.0"), "h/page.html": ("<!-- Released under the MIT License. -->\n<p>text</p>", "MIT"), "h/prose.txt": ("# a heading\nnothing of the kind is said in these words", None), "h/long.txt": ("word " * 40_000 + "\nReleased under the MIT License.\n" + "word " * 1000, "MIT"),
    }
    df = spark.createDataFrame(files + [(p, t) for p, (t, _) in heads.items()] + [("h/prose.txt", heads["h/prose.txt"][0])], "path string, text string")
    got = {r.path: (r.license, r.origin) for r in licenses.license_scan(df).collect()}
    for name in texts:
        assert got[f"{name}/LICENSE"] == (name, "own") and got[f"{name}/src/a.c"] == (name, "inherited")
    for p, (_, name) in heads.items():
        assert got[p] == (name, "own" if name else "none"), p


def test_cosine_ties_go_to_the_smaller_name(spark):
    known = [("b", "alpha beta license"), ("a", "license beta alpha"), ("c", "gamma")]
    r = licenses.license_scan(spark.createDataFrame([("f", "alpha license beta")], "path string, text string"), known=known).first()
    assert (r.license, r.score) == ("a", 1.0)


def components_of(texts, width, least):
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(i):
                same = len(sets[i] & sets[j])
                if same and 100 * same >= least * len(sets[i] | sets[j]) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def test_pipeline_stages(spark, docs, none):
    import corpus_pipeline as C

    key = lambda r: tuple("" if x is None else str(x) for x in r)
    for name, stage in C.STAGES:
        assert stage(spark, none, "").count() == 0, name
    kept = C.STAGES[0][1](spark, docs, "")
    model = langid.predict(docs.select(*C.COLUMNS), langid.learn(docs)).collect()
    want = [tuple(r)[:5] for r in model if any(c.isalpha() for c in r.text or "") and not (r.ambiguous and r.score < C.LEAST_SCORE)]
    assert kept.columns == C.COLUMNS and sorted(map(key, kept.collect())) == sorted(map(key, want))

    data = [tuple(r)[:5] for r in rows()]
    once = C.STAGES[1][1](spark, docs, "")
    some = [i for i, r in enumerate(data) if r[0] is not None and shingles(r[1], 5)]
    root = components_of([data[i][1] for i in some], 5, 80)
    want = [r for r in data if r[0] is None or not shingles(r[1], 5)]
    for x in set(root):
        want.append(min((data[i] for i, y in zip(some, root) if y == x), key=lambda r: r[0]))
    assert once.columns == C.COLUMNS and sorted(map(key, once.collect())) == sorted(map(key, want))

    texts = C.STAGES[2][1](spark, once, "")
    seen, cut_ = {}, []
    for d, t, *_ in want:
        b = (t or "").encode()
        for i in range(len(b) - C.PASSAGE_BYTES + 1) if d is not None else ():
            s = b[i : i + C.PASSAGE_BYTES]
            seen[s] = min(seen.get(s, d), d)
    for d, t, lang, source, n in want:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - C.PASSAGE_BYTES + 1) if d is not None else ():
            if seen[b[i : i + C.PASSAGE_BYTES]] < d:
                gone[i : i + C.PASSAGE_BYTES] = b"\1" * C.PASSAGE_BYTES
        left = "".join(c for c, k in zip(t or "", np.cumsum([0] + [len(c.encode()) for c in t or ""])) if not any(gone[k : k + len(c.encode())]))
        if not any(gone) or left.strip():
            cut_.append((d, left, lang, source, len(left) if any(gone) else n))
    assert texts.columns == C.COLUMNS and sorted(map(key, texts.collect())) == sorted(map(key, cut_))

    mixed = C.STAGES[3][1](spark, texts, "").collect()
    total = len(cut_)
    counts = {s: sum(r[3] == s for r in cut_) for s in {r[3] for r in cut_}}
    shares = {s: n**mixing.TEMPERATURE for s, n in counts.items()}
    steps = {}
    for s, n in counts.items():
        rate = total * shares[s] / (sum(shares.values()) * n)
        steps[s] = np.cumsum(np.exp([k * np.log(rate) - rate - sum(np.log(j) for j in range(1, k + 1)) for k in range(60)]))
    want = []
    for r in cut_:
        u = (int(hashlib.md5(f"count0:{'~' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        want += [r] * int((steps[r[3]] < u).sum())
    assert sorted(map(key, mixed)) == sorted(map(key, want))

    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = C.STAGES[4][1](spark, spark.createDataFrame(mixed, docs.select(*C.COLUMNS).schema), "").collect()
    assert sum(r.length for r in pieces) == sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in want)
    windows = {}
    for r in pieces:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()] and sum(n for _, n in parts) <= 1024


def test_stages_drop_clashing_columns_and_keep_unique_texts(spark):
    import corpus_pipeline as C

    a, b = "the first of these two texts is told again and again", "while this one is told only once in all the table"
    df = spark.createDataFrame([(1, a, "en", "s", 1, 9.0), (2, b, "en", "s", 1, 9.0), (2, a, "en", None, 1, None)], "doc_id long, text string, lang string, source string, n_chars long, score double")
    once = C.near_duplicates(spark, df, "").collect()
    assert sorted((r.doc_id, r.text) for r in once) == [(1, a), (2, b)] and once[0].__fields__ == C.COLUMNS
    assert C.language(spark, df, "").columns == C.COLUMNS and C.mixture(spark, df, "").columns == C.COLUMNS and C.repeated_passages(spark, df, "").columns == C.COLUMNS
