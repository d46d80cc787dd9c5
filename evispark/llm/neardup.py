"""Near-duplicate groups: one-permutation MinHash with optimal densification, bands, star-shaped candidates, exact links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, batch, cut, mix, prefix_hashes, schema, shuffle_width, slices, text_bytes

BANDS = 48
#: A link shares no band with at most this probability; the rows of a band follow from it and the threshold.
MISS = 1e-6
SKETCH = 128
#: Candidates whose sketches differ in more bits are no links of 0.8: six standard deviations, as sets of so many shingles fill over 90 %
#: of the bins, and copied bins are few. Smaller sets skip this test.
SKETCH_MOST, SKETCH_LEAST_SET = 38, 1024
#: Spokes of one star that are verified in one run.
STAR = 256
#: Members of a bucket that are compared in one task, as shingles, each member counting MEMBER more.
BLOCK, MEMBER = 1 << 19, 512
#: Edges that one task of the components' steps has on average; so many tasks at least.
TASK_EDGES, LEAST_TASKS = 1 << 16, 8
#: Shingles that more members of a block share are counted by matrix products, the others pair by pair.
OFTEN, COLUMNS = 32, 2048


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, powers: Powers) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's `width`-word shingles; A-Z lower-cased, words cut at ASCII white space.
    Fewer words than that are one shingle; no word, none."""
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    gap = (low == 32) | ((low >= 9) & (low <= 13))
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    s = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | edge[:-1]))
    e = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | edge[1:])) + 1
    h, down = prefix_hashes(low, powers)
    words = mix(((h[e] - h[s]) * down[s]) ^ mix((e - s).astype(np.uint64)))
    at = np.searchsorted(s, offsets)
    joined = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        joined = mix(joined + words[k : len(words) - width + 1 + k] if len(joined) else joined)
    out = []
    for i, j in zip(at[:-1], at[1:]):
        if j - i >= width:
            out.append(np.unique(joined[i : j - width + 1]))
        elif j > i:
            one = np.array([j - i], np.uint64)
            for w in words[i:j]:
                one = mix(one * np.uint64(31) + w)
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def band_rows(threshold: int) -> int:
    """The most rows a band can have so that sets of `threshold` percent similarity share one of BANDS bands but for MISS."""
    rows = 1
    while (1 - (threshold / 100) ** (rows + 1)) ** BANDS <= MISS:
        rows += 1
    return rows


class Signatures:
    """One permutation: the smallest hash in each of `bins` equal ranges; an empty bin copies the first non-empty bin that its
    probes hit (after 2000 misses the next one in order)."""

    def __init__(self, bins: int):
        self.bins, self.few, self.many = bins, self._probes(bins, 24), None

    @staticmethod
    def _probes(bins: int, attempts: int) -> np.ndarray:
        """The bins that an empty bin asks, in order: hashes of bin and attempt, the same for all sets."""
        x = np.arange(attempts * bins, dtype=np.uint64) + np.uint64(1)
        return (mix(mix(x)) % np.uint64(bins)).astype(np.int16).reshape(attempts, bins)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        bins = self.bins
        out = np.zeros(bins, np.uint64)
        where = ((s >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(where, prepend=-1))
        out[where[first]] = s[first]
        full = np.zeros(bins, bool)
        full[where[first]] = True
        take, open_ = np.arange(bins), np.flatnonzero(~full)
        if len(open_):
            open_ = self._ask(self.few, full, take, open_)
        if len(open_):
            if self.many is None:
                self.many = self._probes(bins, 2000)
            open_ = self._ask(self.many, full, take, open_)
        if len(open_):
            filled = np.flatnonzero(full)
            take[open_] = filled[np.searchsorted(filled, open_) % len(filled)]
        return out[take]

    def _ask(self, table, full, take, open_):
        hit = full[table[:, open_]]
        take[open_] = table[hit.argmax(0), open_]
        return open_[~hit.any(0)]


def _features(width: int, rows_: int, carry: list[str]):
    bins = BANDS * rows_
    scale = mix(np.arange(1, rows_ + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        powers, zip_, signature = Powers(), zstandard.ZstdCompressor(level=1), Signatures(bins)
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            n, hi, lo, sketch, bands, packed = [], [], [], [], [], []
            for at, to in slices(offsets):
                part, where = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
                sets = shingle_sets(part, where, width, powers)
                n += [len(s) for s in sets]
                hi += [mix(s).sum(dtype=np.uint64) for s in sets]
                lo += [mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets]
                sig = np.stack([signature(s) if len(s) else np.zeros(bins, np.uint64) for s in sets])
                key = mix((mix(sig.reshape(-1, BANDS, rows_)) * scale).sum(2, dtype=np.uint64) ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64)))
                bands.append(key.view(np.int64).ravel())
                bits = np.packbits((mix(sig[:, :SKETCH] + np.uint64(7)) & np.uint64(1)).astype(bool), axis=1)
                sketch.append(np.ascontiguousarray(bits).view(np.int64).reshape(-1, 2))
                packed += [zip_.compress(part[i:j].tobytes()) for i, j in zip(where[:-1], where[1:])]
            rows = len(b)
            sk = np.concatenate([*sketch, np.zeros((0, 2), np.int64)])
            flat = np.concatenate([*bands, np.zeros(0, np.int64)])
            yield batch({
                "doc_id": b.column("doc_id"), "n": np.array(n, np.int64), "hi": np.array(hi, np.uint64).view(np.int64), "lo": np.array(lo, np.uint64).view(np.int64), "s0": sk[:, 0].copy(), "s1": sk[:, 1].copy(),
                "bands": pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * BANDS, flat), "packed": pa.array(packed, pa.binary()),
                "no_text": b.column("text").is_null(), **{c: b.column(c) for c in carry},
            })

    return run


def _verify(width: int, threshold: int):
    """Reads stars as they stream by, the hub first and then its spokes, and gives the pairs that are links."""

    def run(batches):
        powers, unzip = Powers(), zstandard.ZstdDecompressor()
        hub = key = None

        def full(z: bytes) -> np.ndarray:
            data = np.frombuffer(unzip.decompress(z), np.uint8)
            return shingle_sets(data, np.array([0, len(data)]), width, powers)[0]

        for b in batches:
            found_a, found_b = [], []
            columns = [b.column(c).to_pylist() for c in ("a", "part", "b")]
            for a, part, spoke, z in zip(*columns, b.column("packed")):
                if spoke is None:
                    hub, key = full(z.as_py()), (a, part)
                    continue
                assert key == (a, part), "a star's hub comes first"
                other = full(z.as_py())
                shared = len(np.intersect1d(hub, other, assume_unique=True))
                if 100 * shared >= threshold * (len(hub) + len(other) - shared):
                    found_a.append(a)
                    found_b.append(spoke)
            yield batch({"a": np.array(found_a, np.int64), "b": np.array(found_b, np.int64)})

    return run


def links(edges: DataFrame, payload: DataFrame, width: int, threshold: int) -> DataFrame:
    """The pairs (a, b) of `edges` whose full shingle sets have 100 * intersection >= threshold * union.

    Pairs are dealt by hub and run of STAR spokes, so that a hub's text travels once per run and a hot hub is many runs;
    tasks hold one hub and one spoke at a time.
    """
    degree = edges.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("long").alias("parts"))
    e = edges.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    p = payload.select(F.col("row").alias("id"), "packed")
    spokes = e.join(p, F.col("b") == F.col("id")).select("a", "part", "b", "packed")
    hubs = e.select("a", "part").distinct().join(p, F.col("a") == F.col("id")).select("a", "part", F.lit(None).cast("long").alias("b"), "packed")
    width_ = shuffle_width(edges.sparkSession)
    dealt = spokes.unionAll(hubs).repartition(width_, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(_verify(width, threshold), schema("a long, b long"))


def _overlaps(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
    """How many elements the sets at `some` share with each other set, exactly: a row for each of `some`."""
    m, row = len(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.full(m, -1)
    at[some] = np.arange(len(some))
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    rare = (count[column] > 1) & (count[column] <= OFTEN)
    r, c, met = row[rare], column[rare], []
    for k in range(1, OFTEN):
        same = np.flatnonzero(c[:-k] == c[k:])
        if not len(same):
            break
        for x, y in ((r[same], r[same + k]), (r[same + k], r[same])):
            met.append((at[x] * m + y)[at[x] >= 0])
    out = np.bincount(np.concatenate([*met, np.empty(0, np.int64)]), minlength=len(some) * m).reshape(len(some), m)
    often = count[column] > OFTEN
    r, c = row[often], np.cumsum(np.diff(column[often], prepend=-1) > 0) - 1
    for lo in range(0, int(c[-1]) + 1 if len(c) else 0, COLUMNS):
        i, j = np.searchsorted(c, [lo, lo + COLUMNS])
        held = np.zeros((m, COLUMNS), np.float32)
        held[r[i:j], c[i:j] - lo] = 1
        out += (held[some] @ held.T).astype(np.int64)
    return out


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges a[i], b[i] between n nodes keep all that they join joined, as few as can be, the first ones: in each round every tree
    takes the first edge that leaves it."""
    tree, left, taken = np.arange(n), np.arange(len(a)), [np.empty(0, np.int64)]
    while True:
        left = left[tree[a[left]] != tree[b[left]]]
        if not len(left):
            return np.sort(np.concatenate(taken))
        first, up = np.full(n, len(a)), np.arange(n)
        for x in (a, b):
            np.minimum.at(first, tree[x[left]], left)
        from_ = np.flatnonzero(first < len(a))
        first = first[from_]
        taken.append(np.unique(first))
        up[from_] = tree[a[first]] + tree[b[first]] - from_
        ends = (up[up] == np.arange(n)) & (np.arange(n) < up)
        up[ends] = np.flatnonzero(ends)
        while (up[up] != up).any():
            up = up[up]
        tree = up[tree]


def _block_links(width: int, threshold: int):
    """Full sets of the members of one block are compared, each with each. Of the groups that have a link, as many pairs of roots as join
    them: in a block of n groups under n, not each two of them."""

    def run(table: pa.Table) -> pa.Table:
        powers, unzip = Powers(), zstandard.ZstdDecompressor()
        ids, root = np.unique(table.column("root").to_numpy(), return_inverse=True)
        some = np.flatnonzero(root != np.bincount(root).argmax())
        a = b = np.empty(0, np.int64)
        if len(some):
            texts = [unzip.decompress(z.as_py()) for z in table.column("packed")]
            data, offsets, sets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), []
            for i, j in slices(offsets):
                sets += shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, powers)
            n, shared = np.array([len(s) for s in sets]), _overlaps(sets, some)
            x, y = np.nonzero((100 * shared >= threshold * (n[some][:, None] + n - shared)) & (root[some][:, None] != root))
            x, y = root[some[x]], root[y]
            x, y = np.divmod(np.unique(np.minimum(x, y) * len(ids) + np.maximum(x, y)), len(ids))
            one = _forest(x, y, len(ids))
            a, b = ids[x[one]], ids[y[one]]
        return pa.table({"a": a, "b": b})

    return run


def links_inside(met: DataFrame, root: DataFrame, feats: DataFrame, width: int, threshold: int) -> DataFrame:
    """Pairs (a, b) of roots whose groups of `root` (id, root) have links, enough to join all groups that links join: all pairs that share a
    bucket of `met` (key, row, size) are compared.

    A bucket's members outside its largest group are cut into blocks, and so are the members in it; the first meet each other and the
    second, block by block, so members of one group alone never meet and a task has two blocks, however large a bucket is.
    Buckets of two have been compared before.
    """
    n = feats.select("row", "n", "packed")
    rooted = met.filter("size > 2").select("key", "row").join(root.withColumnRenamed("id", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    rooted = rooted.join(n.select("row", (F.col("n") + MEMBER).alias("weight")), "row")
    groups = rooted.groupBy("key", "root").agg(F.sum("weight").alias("weight"))
    main = groups.groupBy("key").agg(F.max_by("root", F.struct("weight", "root")).alias("main"), F.max("weight").alias("inside"), F.sum("weight").alias("all"), F.count("*").alias("groups"))
    parts = lambda c: F.ceil(c / BLOCK).cast("int")
    main = main.filter("groups > 1").select("key", "main", parts(F.col("all") - F.col("inside")).alias("p"), parts(F.col("inside")).alias("q"))
    own, most = F.xxhash64("row", "key"), F.col("root") == F.col("main")
    block = F.pmod(own, F.when(most, F.col("q")).otherwise(F.col("p"))).cast("int")
    wide = F.col("p") + F.col("q")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    outer = F.transform(upto(wide), lambda k: F.when(k < F.col("p"), F.least(k, F.col("block")) * wide + F.greatest(k, F.col("block"))).otherwise(F.col("block") * wide + k))
    inner = F.transform(upto(F.col("p")), lambda k: k * wide + F.col("p") + F.col("block"))
    dealt = rooted.join(main, "key").withColumn("block", block).select("key", "row", "root", F.explode(F.when(most, inner).otherwise(outer)).alias("cell"))
    cells = dealt.join(n.select("row", "packed"), "row")
    return cells.groupBy("key", "cell").applyInArrow(_block_links(width, threshold), schema("a long, b long"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id that each id of `edges` (a, b) can reach, by large-star and small-star steps.

    Every step is an aggregate and a join on ids; stars only shrink towards their smallest id, and the steps end when
    nothing changes. The driver sees two numbers a step. Edges go on in as many tasks as their number asks for, as each task of
    each step leaves files.
    """
    few = lambda x: x.coalesce(max(LEAST_TASKS, -(-size // TASK_EDGES)))
    e = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct())
    before, size = None, e.count()
    for _ in range(rounds):
        e = few(e)
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        e = few(both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")))  # as many as before; the round's end drops repeats
        least = e.groupBy("v").agg(F.min("u").alias("m"))
        small = few(e.join(least, "v"))
        e = cut(few(small.filter("u != m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(few(least).select("v", F.col("m").alias("u"))).filter("u < v").distinct()))
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            return e.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "id")
        before, size = now, now[0]
    raise RuntimeError("components did not settle")


def near_duplicates(df: DataFrame, width: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: groups linked by shingle-set similarity of `threshold` percent.

    Equal sets collapse to one row first, however many there are. Of the rest, each band bucket links its
    members to three centres, so buckets give stars, not pairs: the member that shares most buckets with most others (copies with
    the fewest edits; a copy that is similar to any is most similar to these), one drawn by that number, and one drawn evenly, all by
    hashes that differ from bucket to bucket. Size and sketch discard most candidates; then full sets decide, first on each
    document's likeliest candidate, then on the candidates that still join different groups and on all members of a bucket that are
    in different groups, centres or not. Two ends of a link share a bucket with a probability over 1 - 10^-6, and
    then their groups are one.

    A text that is null, empty or without words has n_shingles 0 and is its own group. A null id takes no part: component null,
    kept. Rows that repeat an id are rows of their own: those of equal text are in one group, those of different texts in the
    groups of their texts; `kept` holds for all rows with their group's smallest id. An empty table gives an empty result; other columns
    play no part.
    """
    return _grouped(df, width, threshold, doc_id, text, [])[1].drop("row", "first")


def distinct_texts(df: DataFrame, width: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near_duplicates(), the first of those with the smallest id, with all columns of `df` as they are.

    Rows are kept and dropped one by one, so a text never goes for another's id. Rows without words and rows without id stay.
    """
    feats, groups = _grouped(df, width, threshold, doc_id, text, [c for c in df.columns if c != text])
    left = feats.join(groups.filter("not first").select("row"), "row", "left_anti")
    names, out = [f.name for f in df.schema], df.schema

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            texts = [None if gone else unzip.decompress(z).decode() for gone, z in zip(b.column("no_text").to_pylist(), b.column("packed").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else b.column(_CARRIED + c) for c in names], names=names)

    return left.select("no_text", "packed", *[f"`{_CARRIED}{c}`" for c in names if c != text]).mapInArrow(run, out)


_CARRIED = "carried_"


def _grouped(df: DataFrame, width: int, threshold: int, doc_id: str, text: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(features of every row, (row, doc_id, n_shingles, component_id, kept, first)); `row` is a number that each row has alone."""
    spark = df.sparkSession
    carried = [F.col(f"`{c}`").alias(_CARRIED + c) for c in carry]
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *carried)
    ddl = schema("doc_id long, n long, hi long, lo long, s0 long, s1 long, bands array<long>, packed binary, no_text boolean")
    more = [rows.schema[_CARRIED + c] for c in carry]
    feats = rows.mapInArrow(_features(width, band_rows(threshold), [f.name for f in more]), type(ddl)([*ddl.fields, *more]))
    feats = cut(feats.withColumn("row", F.monotonically_increasing_id()))
    some = feats.filter("n > 0 and doc_id is not null")
    sets = cut(some.groupBy("n", "hi", "lo").agg(F.min(F.struct("doc_id", "row")).alias("f"), F.min(F.struct("row", "s0", "s1")).alias("r")).select("n", "hi", "lo", F.col("r.row").alias("rep"), "r.s0", "r.s1", "f"))
    reps = some.select("row", "bands").join(sets.select(F.col("rep").alias("row")), "row", "left_semi")
    keyed = reps.select("row", F.explode("bands").alias("key")).repartition(shuffle_width(spark), "key")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = cut(keyed.join(sizes, "key"))
    liked = met.groupBy("row").agg(F.sum("size").alias("liked"))
    chance = F.shiftrightunsigned(F.xxhash64("key", "row"), 32) / F.lit(float(1 << 32))
    ranked = met.join(liked, "row").select("key", "row", "liked", (F.col("liked") * chance).alias("varied"), chance.alias("chance"))
    centre = ranked.groupBy("key").agg(F.array_distinct(F.array(*[F.max_by("row", F.struct(c, "row")) for c in ("liked", "varied", "chance")])).alias("cs"))
    stars = met.join(centre, "key").select("row", F.explode("cs").alias("c")).filter("row != c")
    pairs = stars.select(F.least("row", "c").alias("a"), F.greatest("row", "c").alias("b")).distinct()
    side = sets.select("rep", "n", "s0", "s1")
    left, right = (side.select(*[F.col(c).alias(f"{c}_{x}") for c in side.columns]) for x in "ab")
    differ = F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))) + F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b")))
    known = pairs.join(left, F.col("a") == F.col("rep_a")).join(right, F.col("b") == F.col("rep_b"))
    size = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold
    close = (F.least("n_a", "n_b") < SKETCH_LEAST_SET) | (differ <= SKETCH_MOST)
    cand = cut(known.filter(size & close).select("a", "b", differ.cast("int").alias("differ")))

    ends = cand.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    payload = cut(feats.select("row", "packed").join(ends, "row", "left_semi"))
    ways = cand.select(F.col("a").alias("x"), F.col("b").alias("y"), "differ").unionAll(cand.select(F.col("b").alias("x"), F.col("a").alias("y"), "differ"))
    best = ways.groupBy("x").agg(F.min(F.struct("differ", "y")).alias("m")).select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b")).distinct()
    true = cut(links(best, payload, width, threshold))
    root = components(true)
    at = lambda x: root.select(F.col("id").alias(f"id_{x}"), F.col("root").alias(f"root_{x}"))
    apart = cand.join(best, ["a", "b"], "left_anti").join(at("a"), F.col("a") == F.col("id_a"), "left").join(at("b"), F.col("b") == F.col("id_b"), "left")
    apart = apart.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    more = links(cut(apart), payload, width, threshold).unionAll(links_inside(met, root, feats, width, threshold))
    root = components(root.select(F.col("id").alias("a"), F.col("root").alias("b")).unionAll(more))

    rooted = sets.join(root, F.col("rep") == F.col("id"), "left").select("n", "hi", "lo", "f", F.coalesce("root", "rep").alias("root"))
    groups = rooted.join(rooted.groupBy("root").agg(F.min("f").alias("g")), "root").select("n", "hi", "lo", "g")
    out = feats.select("row", "doc_id", "n", "hi", "lo").join(groups, ["n", "hi", "lo"], "left")
    known = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    component = F.when(known, F.col("g.doc_id")).otherwise(F.col("doc_id"))
    kept, first = (F.when(known, x).otherwise(F.lit(True)) for x in (component == F.col("doc_id"), F.col("g.row") == F.col("row")))
    return feats, out.select("row", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), first.alias("first"))


def op6_minhash_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Groups of all documents by three-word shingles at a similarity of 0.85 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, threshold=85)
