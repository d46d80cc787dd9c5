"""Removal of byte strings that an earlier document has: two-stage suffix sorting of the places that can repeat."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, batch, cut, mix, prefix_hashes, schema, slices, text_bytes

#: Text of one block, and of anchors' text that one sorting task gets on average.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 3 << 20
#: Strings of a common anchor that a block deals out in one go.
STRINGS = 1 << 16
_LOW = np.uint64((1 << 40) - 1)
_POS = np.uint64((1 << 28) - 1)
#: A longer text gives its anchors window by window, as places in a window have 28 bits.
LONGEST = 1 << 24


# --- two-stage suffix sorting -------------------------------------------------------------------------------------


def _words(text: np.ndarray) -> np.ndarray:
    """At each place the next 8 bytes as one big-endian number; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(64, np.uint8)]).astype(np.uint64)
    w = padded
    for k in (1, 2, 4):  # joins neighbours of k bytes
        w = np.concatenate([w[:-k] << np.uint64(8 * k) | w[k:], w[-k:]])
    return w


def _sort_by_prefix(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """`places` in the order of the `depth` bytes that follow each; equal ones keep the order of places."""
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    tie = np.zeros(len(order) + 1, bool)
    tie[1:-1] = key[1:] == key[:-1]  # tie[i]: equal to the one before
    at = 8
    while at < depth and tie.any():
        part = np.flatnonzero(tie[:-1] | tie[1:])
        group = np.cumsum(~tie[:-1])[part]
        key = words[order[part] + at]
        sub = np.lexsort((key, group))
        order[part] = order[part][sub]
        same = np.zeros(len(part), bool)
        same[1:] = (group[1:] == group[:-1]) & (key[sub][1:] == key[sub][:-1]) & (np.diff(part) == 1)
        tie[part] = same
        at += 8
    return order


def two_stage_suffix_array(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """All places of `text`, ordered by the suffixes' first `depth` bytes at least (the text's end is lowest).

    Stage 1 sorts directly only the suffixes that are smaller than their successor. Stage 2 scans buckets of equal first byte
    upwards: a sorted suffix puts the one that starts a byte earlier, if that is larger, at the next place of its bucket.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    words = _words(text) if words is None else words
    t = text.astype(np.int16)
    rising, falling = np.empty(n, bool), np.zeros(n, bool)
    step = np.concatenate([np.sign(np.diff(t)), [-1]])  # the last suffix is larger than the empty one
    turn = np.flatnonzero(step != 0)
    nxt = turn[np.searchsorted(turn, np.arange(n))]
    falling[:] = step[nxt] < 0
    rising[:] = ~falling
    small = _sort_by_prefix(np.flatnonzero(rising), words, depth)
    starts = np.searchsorted(text[small], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        own = small[starts[c] : starts[c + 1]]
        if not waiting[c] and not len(own):
            continue
        large = []
        frontier = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        while len(frontier):  # runs of c grow leftwards inside the bucket
            large.append(frontier)
            before = frontier[frontier > 0] - 1
            frontier = before[(text[before] == c)]
        bucket = np.concatenate([*large, own])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for piece in np.split(before, cuts):
                waiting[text[piece[0]]].append(piece)
    return np.concatenate(out)


def equal_prefixes(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """For each place of `order` whether the common prefix with the one before is `depth` bytes or more."""
    same = np.ones(len(order), bool)
    same[:1] = False
    for at in [*range(0, depth - 7, 8), depth - 8]:
        live = np.flatnonzero(same)
        same[live] = words[order[live] + at] == words[order[live - 1] + at]
    return same


# --- anchors: where equal strings meet ----------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, powers: Powers):
    """(hash, document, first start, starts, hash of the text around): each `length`-byte string inside a document belongs to the anchor gram it holds
    with the smallest hash (the leftmost of equals); strings that share an anchor and follow each other are one row.

    Equal strings have equal anchors, so each pair of equal strings meets under one hash.
    """
    gram = min(20, max(8, length // 2))
    width, n = length - gram + 1, len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    h, down = prefix_hashes(data, powers)
    g = mix((h[gram:] - h[:-gram]) * down[: n - gram + 1])
    key = (g & ~_POS) | np.arange(len(g), dtype=np.uint64)
    pad = -len(key) % width
    k = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    left, right = np.minimum.accumulate(k, 1).ravel(), np.minimum.accumulate(k[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(right[: n - length + 1], left[width - 1 : width - 1 + n - length + 1])
    place = (low & _POS).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - length + 1]
    inside = np.arange(n - length + 1) + length <= offsets[1:][doc]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.concatenate([np.cumsum(inside) - inside, [inside.sum()]])[np.concatenate([at, [n - length + 1]])])
    around = (h[at + count + length - 1] - h[at]) * down[at]
    return mix(g[place[at]] + np.uint64(1)), doc[at], at, count, around


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of data[start : start + size], one after another."""
    total = int(size.sum())
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return data[shift + np.arange(total)]


def _pack(**arrays: np.ndarray) -> bytes:
    import io

    out = io.BytesIO()
    for x in arrays.values():
        np.lib.format.write_array(out, np.ascontiguousarray(x), allow_pickle=False)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def _unpack(blob: bytes) -> list[np.ndarray]:
    import io

    raw = io.BytesIO(zstandard.ZstdDecompressor().decompress(blob))
    out = []
    while raw.tell() < raw.getbuffer().nbytes:
        out.append(np.lib.format.read_array(raw, allow_pickle=False))
    return out


BLOCK = "block long, ids binary, sizes binary, texts binary, extra binary"


def _frozen(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue().to_pybytes())


def _thawed(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def _blocks(block_bytes: int, carry: list[str]):
    def run(batches):
        block = TaskContext.get().partitionId() << 32
        ids, known, sizes, texts, extra, held = [], [], [], [], [], 0

        def full():
            body = zstandard.ZstdCompressor(level=1).compress(np.concatenate([*texts, np.empty(0, np.uint8)]).tobytes())
            return batch({"block": [block], "ids": [_pack(ids=np.array(ids, np.int64), known=np.array(known, bool))], "sizes": [_pack(sizes=np.concatenate([*sizes, np.empty(0, np.int64)]).astype(np.int64))], "texts": [body], "extra": [_frozen(pa.Table.from_batches(extra)) if carry else b""]})

        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            for at, to in slices(offsets, block_bytes // 4):
                for i in b.column("doc_id")[at:to].to_pylist():
                    ids.append(i or 0)
                    known.append(i is not None)
                sizes.append(np.diff(offsets[at : to + 1]))
                texts.append(data[offsets[at] : offsets[to]])
                if carry:
                    extra.append(b.select(carry).slice(at, to - at))
                held += int(offsets[to] - offsets[at])
                if held >= block_bytes:
                    yield full()
                    block, ids, known, sizes, texts, extra, held = block + 1, [], [], [], [], [], 0
        if ids:
            yield full()

    return run


class _Block:
    def __init__(self, row):
        self.ids, self.known = _unpack(row["ids"])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"]), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(_unpack(row["sizes"])[0])])

    def anchors(self, length: int, powers: Powers):
        """Over slices of bounded size; documents and starts count from the block's beginning."""
        for at, to in slices(self.offsets):
            base, end = int(self.offsets[at]), int(self.offsets[to])
            if end - base > LONGEST:  # one text; each of its strings starts in one window
                for i in range(base, end - length + 1, LONGEST) if self.known[at] else ():
                    part = self.data[i : min(end, i + LONGEST + length - 1)]
                    h, doc, start, count, around = anchors(part, np.array([0, len(part)]), length, powers)
                    yield h, doc + at, start + i, count, around
                continue
            h, doc, start, count, around = anchors(self.data[base : self.offsets[to]], self.offsets[at : to + 1] - base, length, powers)
            keep = self.known[doc + at]
            yield h[keep], doc[keep] + at, start[keep] + base, count[keep], around[keep]

    def all_anchors(self, length: int, powers: Powers):
        parts = list(self.anchors(length, powers))
        return [np.concatenate([p[i] for p in parts]) for i in range(5)] if parts else [np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3, np.empty(0, np.uint64)]


def _split(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of sorted bucket numbers."""
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else []
    return [(int(bucket[i]), int(i), int(j)) for i, j in zip(edges[:-1], edges[1:])]


def _fingerprints(length: int, buckets: int, few: int):
    """By block and bucket: the anchors' hashes, 40 bits each, which of them two documents of the block have, and how many distinct texts
    and strings lie around those with more than `few` such texts."""

    def run(batches):
        powers = Powers()
        for b in batches:
            for row in b.to_pylist():
                block = _Block(row)
                h, doc, _, count, around = block.all_anchors(length, powers)
                bucket, rest = (h % np.uint64(buckets)).astype(np.int64), h // np.uint64(buckets) & _LOW
                order = np.lexsort((block.ids[doc], rest, bucket))
                bucket, rest, who = bucket[order], rest[order], block.ids[doc][order]
                first = np.ones(len(rest), bool)
                first[1:] = (rest[1:] != rest[:-1]) | (bucket[1:] != bucket[:-1])
                at = np.flatnonzero(first)
                last = np.concatenate([at[1:], [len(rest)]]) - 1 if len(at) else at
                many = who[at] != who[last] if len(at) else np.empty(0, bool)
                occurs = last - at + 1
                some = np.flatnonzero(np.repeat(occurs > few, occurs))
                anchor = np.repeat(np.arange(len(at)), occurs)[some]
                once = np.unique(mix(around[order[some]] + anchor.astype(np.uint64) * _LOW), return_index=True)[1]
                texts = np.bincount(anchor[once], minlength=len(at))
                strings = np.bincount(anchor[once], count[order[some[once]]], len(at)).astype(np.int64)
                rest, found = rest[at], _split(bucket[at])
                small = [rest[i:j].view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for _, i, j in found]
                heavy = [(i, i + np.flatnonzero(texts[i:j] > few)) for _, i, j in found]
                common = [_pack(at=(x - i).astype(np.uint32), texts=texts[x].astype(np.uint32), strings=strings[x].astype(np.uint32)) if len(x) else None for i, x in heavy]
                yield batch({"bucket": np.array([x[0] for x in found], np.int64), "block": np.full(len(found), row["block"], np.int64), "hashes": pa.array(small, pa.binary()), "many": pa.array([np.packbits(many[i:j]).tobytes() for _, i, j in found], pa.binary()), "common": pa.array(common, pa.binary())})

    return run


def _hashes(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _shared(length: int, hot_bytes: int, bucket_bytes: int):
    """Of one bucket: for each block its hashes that another block, or another of its documents, has; and the hashes around which
    all blocks together have more than `hot_bytes` of distinct text, with the number of parts that their strings are dealt to."""

    def run(key, table):
        rows = table.select(["block", "hashes", "many", "common"]).to_pylist()
        parts = [_hashes(r["hashes"]) for r in rows]
        values, count = np.unique(np.concatenate(parts), return_counts=True)
        out = []
        for r, p in zip(rows, parts):
            many = np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(p)).astype(bool)
            values_many = p[many]
            count[np.searchsorted(values, values_many)] = 2
        twice = values[count > 1]
        hot, dealt = None, 0
        common = [(p[at], *sizes) for r, p in zip(rows, parts) if r["common"] for at, *sizes in [_unpack(r["common"])]]
        if common:
            rest, texts, strings = (np.concatenate(x) for x in zip(*common))
            rest, which = np.unique(rest, return_inverse=True)
            texts, strings = (np.bincount(which, x).astype(np.int64) for x in (texts, strings))
            large = strings + texts * (length - 1) > hot_bytes
            if large.any():
                hot, dealt = _pack(rest=rest[large]), -(-int(strings[large].sum()) * length // bucket_bytes)
        for r, p in zip(rows, parts):
            hit = p[np.isin(p, twice, assume_unique=True)]
            if len(hit):
                out.append((r["block"], hit.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()))
        b = key[0].as_py()
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "bucket": pa.array([b] * len(out), pa.int64()), "hashes": pa.array([x[1] for x in out], pa.binary()), "hot": pa.array([hot] * len(out), pa.binary()), "parts": pa.array([dealt] * len(out), pa.int64())})

    return run


def _joined(begin: np.ndarray, end: np.ndarray) -> bytes:
    """Runs of bytes; those that overlap or touch become one."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    begin, end = begin[new], end[np.concatenate([new[1:], [True]])]
    return _pack(begin=begin.astype(np.uint32), size=(end - begin).astype(np.uint32))


def _distinct(text: bytes, size: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different ones of texts of these sizes that stand one after another, and which of them each is."""
    seen: dict[bytes, int] = {}
    ends = np.cumsum(size.astype(np.int64)).tolist()
    which = np.array([seen.setdefault(text[e - s : e], len(seen)) for s, e in zip(size.tolist(), ends)], np.int64)
    return list(seen), which


def _asking(which: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Whether a place is one of the smallest id that has its text."""
    least = np.full(int(which.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, which, who)
    return who == least[which]


def _contexts(length: int, buckets: int):
    """Of one block: the text around each shared anchor, by bucket; equal texts of the block once, with the places in the document
    of the smallest id. The other places of the text are decided here: their runs go on under a number below 0 of their own.

    The text around a hot anchor goes string by string to the parts of its bucket, a string's hash says which: equal strings meet
    as before, and no task gets all that stands around an anchor.
    """

    def packed(texts, which, ids, start):
        return _pack(text=np.frombuffer(b"".join(texts), np.uint8), size=np.array([len(x) for x in texts], np.uint32), which=which.astype(np.uint32), ids=ids, start=start.astype(np.uint32))

    def strings(block, bucket, parts, ids, start, count, powers):
        """(bucket, packed) of the parts; (begin, end) of the places that are decided here."""
        up, windows = powers.to(length)[0], np.lib.stride_tricks.sliding_window_view(block.data, length)
        ends = np.cumsum(count)
        for at in range(0, int(ends[-1]) if len(ends) else 0, STRINGS):
            n = np.arange(at, min(at + STRINGS, int(ends[-1])))
            run = np.searchsorted(ends, n, "right")
            place, who = start[run] + n - (ends - count)[run], ids[run]
            texts, which = _distinct(windows[place].tobytes(), np.full(len(place), length))
            hashes = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, length).astype(np.uint64) + np.uint64(1)
            part = (mix((hashes * up).sum(1)) % np.uint64(parts)).astype(np.int64)
            ask = np.flatnonzero(_asking(which, who))
            rows = []
            ask = ask[np.argsort(part[which[ask]], kind="stable")]
            for p, i, j in _split(part[which[ask]]):
                own, code = np.unique(which[ask[i:j]], return_inverse=True)
                rows.append((bucket + buckets * (1 + p), packed([texts[k] for k in own.tolist()], code, who[ask[i:j]], place[ask[i:j]])))
            rest = np.delete(place, ask)
            yield rows, rest, rest + length

    def run(key, blocks, shared):
        found, begin, end = [], [], []
        if shared.num_rows:
            block, powers = _Block(blocks.to_pylist()[0]), Powers()
            h, doc, start, count, _ = block.all_anchors(length, powers)
            bucket, rest = (h % np.uint64(buckets)).astype(np.int64), h // np.uint64(buckets) & _LOW
            order = np.lexsort((rest, bucket))
            runs = {b: (i, j) for b, i, j in _split(bucket[order])}
            for r in shared.select(["bucket", "hashes", "hot", "parts"]).to_pylist():
                i, j = runs[r["bucket"]]
                own = order[i:j]
                own = own[np.isin(rest[own], _hashes(r["hashes"]))]
                size = count[own] + length - 1
                texts, which = _distinct(_gather(block.data, start[own], size).tobytes(), size)
                who = block.ids[doc[own]]
                ask = _asking(which, who)
                begin.append(start[own][~ask])
                end.append(begin[-1] + size[~ask])
                if r["hot"]:
                    hot = np.isin(rest[own], _unpack(r["hot"])[0])
                    for rows, *decided in strings(block, r["bucket"], r["parts"], who[ask & hot], start[own][ask & hot], count[own][ask & hot], powers):
                        found += rows
                        begin.append(decided[0])
                        end.append(decided[1])
                    ask &= ~hot
                    left, code = np.unique(which[ask], return_inverse=True)
                    texts = [texts[k] for k in left.tolist()]
                else:
                    code = which[ask]
                if len(code):
                    found.append((r["bucket"], packed(texts, code, who[ask], start[own][ask])))
            begin, end = np.concatenate(begin), np.concatenate(end)
            if len(begin):
                found.append((-1 - key[0].as_py(), _joined(begin, end)))
        return pa.table({"bucket": pa.array([x[0] for x in found], pa.int64()), "block": pa.array([key[0].as_py()] * len(found), pa.int64()), "packed": pa.array([x[1] for x in found], pa.binary())})

    return run


def _repeats(length: int):
    """Of one bucket: sorts the suffixes of all its distinct contexts and gives, by block, the runs of bytes that a document
    with a smaller id has too."""

    def run(key, table):
        if key[0].as_py() < 0:  # runs that a block knows already
            return table.select(["block", "packed"])
        rows = table.select(["block", "packed"]).to_pylist()
        seen: dict[bytes, int] = {}
        places = []
        for r in rows:
            text, size, which, ids, start = _unpack(r["packed"])
            raw, ends = text.tobytes(), np.cumsum(size.astype(np.int64)).tolist()
            code = np.array([seen.setdefault(raw[e - s : e], len(seen)) for s, e in zip(size.tolist(), ends)], np.int64)
            places.append((r["block"], code[which], ids, start.astype(np.int64)))
        text = np.frombuffer(b"".join(seen), np.uint8)
        size = np.array([len(x) for x in seen], np.int64)
        del seen
        base = np.cumsum(size) - size
        count = size - length + 1
        least = np.full(len(size), np.iinfo(np.int64).max)
        for _, code, ids, _ in places:
            np.minimum.at(least, code, ids)
        words = _words(text)
        wanted = np.zeros(len(text) + 1, np.int32)
        np.add.at(wanted, base, 1)
        np.add.at(wanted, base + count, -1)
        wanted = np.cumsum(wanted[:-1]) > 0
        order = two_stage_suffix_array(text, length, words)
        order = order[wanted[order]]
        group = np.cumsum(~equal_prefixes(order, words, length)) - 1
        owner = np.repeat(np.arange(len(size)), size)
        smallest = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(smallest, group, least[owner[order]])
        first = np.zeros(len(text), np.int64)
        first[order] = smallest[group]
        out = []
        for block, code, ids, start in places:
            n = count[code]
            shift = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(shift, n)
            gone = first[np.repeat(base[code], n) + step] < np.repeat(ids, n)
            where = (np.repeat(start, n) + step)[gone]
            if len(where):
                where.sort()
                new = np.concatenate([[True], np.diff(where) > 1])
                begin = where[new]
                end = where[np.concatenate([new[1:], [True]])] + length
                out.append((block, _pack(begin=begin.astype(np.uint32), size=(end - begin).astype(np.uint32))))
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "packed": pa.array([x[1] for x in out], pa.binary())})

    return run


def _kept(with_text: bool, carry: list[str]):
    """Of one block: each document's bytes outside all runs."""

    def run(key, blocks, runs):
        row = blocks.to_pylist()[0]
        block = _Block(row)
        edge = np.zeros(len(block.data) + 1, np.int32)
        for r in runs.column("packed").to_pylist():
            begin, size = (x.astype(np.int64) for x in _unpack(r))
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + size, -1)
        gone = np.cumsum(edge[:-1]) > 0
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        starts = block.offsets[:-1]
        inside = starts[starts < len(gone)]
        head[inside] = gone[inside]
        removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, head))
        digests, texts = [], []
        for i, j in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
            part = block.data[i:j]
            kept = part[~gone[i:j]].tobytes() if removed[j] > removed[i] else part.tobytes()
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                whole = part.tobytes() if removed[j] == removed[i] else _whole_characters(part, ~gone[i:j])
                texts.append(whole.decode("utf-8"))
        diff = lambda x: x[block.offsets[1:]] - x[block.offsets[:-1]]
        columns = {"doc_id": pa.array(block.ids, pa.int64(), mask=~block.known), "n_bytes": np.diff(block.offsets), "n_removed": diff(removed).astype(np.int64), "n_spans": diff(spans).astype(np.int64), "kept_sha256": digests}
        more = _thawed(row["extra"]) if carry else None
        return pa.table(columns | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}) | {c: more.column(c) for c in carry})

    return run


def _whole_characters(part: np.ndarray, kept: np.ndarray) -> bytes:
    """The kept bytes without those of characters that a cut has split."""
    lead = np.flatnonzero((part & 0xC0) != 0x80)
    whole = np.minimum.reduceat(kept, lead)
    return part[np.repeat(whole, np.diff(np.append(lead, len(part))))].tobytes()


def remove_repeats(df: DataFrame, length: int = 50, with_text: bool = False, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text][, carried columns]) of every row: without each byte covered by a `length`-byte
    string (8 at least) that also starts in a row with a smaller id.

    1. Each string has an anchor, the gram in it with the smallest hash. Blocks of text send their anchors' fingerprints
       to buckets, and each bucket tells the blocks which of their anchors occur in two documents. Fingerprints only
       choose places to look at: a false match costs time, and equal strings can't be missed.
    2. Blocks send the text around shared anchors to the anchor's bucket, equal texts once and with the smallest id alone: the
       block's other rows of that text lose it in any case.
    3. Each bucket sorts the suffixes of its distinct texts in two stages and compares neighbours: suffixes with a common
       prefix of `length` bytes form a group, whose smallest id tells which rows lose these bytes.
    4. Blocks join the runs of bytes to remove.
    The number of buckets follows the text's bytes, so what a task holds does not; an anchor that a third of all rows has meets as one
    distinct text per block, with one id. Where an anchor's distinct texts are more than a quarter of `bucket_bytes`, its strings are
    dealt to as many parts of the bucket as they need, and each part sorts its own.

    A null or empty text has nothing removed (the sha256 of no bytes). Strings repeated only in one row, or in rows of the same
    id, stay. A row whose id is null keeps all and takes no part. An empty table gives an empty result; columns named by
    `carry` come along unless the result has their name, others play no part. A text of any length is looked at as a whole. `kept_text` also loses the rest of a character that a cut has split.
    """
    if length < 8:
        raise ValueError("length must be 8 or more")
    carry = [c for c in carry if c not in ("doc_id", "text", "block", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")]
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *[F.col(f"`{c}`") for c in carry])
    blocks = cut(rows.mapInArrow(_blocks(block_bytes, carry), schema(BLOCK)))
    zipped, n_blocks = blocks.agg(F.sum(F.octet_length("texts")), F.count("*")).first()
    zipped, hot_bytes = zipped or 0, bucket_bytes // 4
    few = max(1, hot_bytes // (2 * length * max(1, n_blocks)))  # what blocks don't tell of an anchor is hot_bytes together, or one text a block
    buckets = max(64, int(3 * zipped // bucket_bytes) + 1)
    prints = blocks.mapInArrow(_fingerprints(length, buckets, few), schema("bucket long, block long, hashes binary, many binary, common binary"))
    shared = prints.groupBy("bucket").applyInArrow(_shared(length, hot_bytes, bucket_bytes), schema("block long, bucket long, hashes binary, hot binary, parts long"))
    contexts = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_contexts(length, buckets), schema("bucket long, block long, packed binary"))
    runs = contexts.groupBy("bucket").applyInArrow(_repeats(length), schema("block long, packed binary"))
    out = schema("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
    out = type(out)([*out.fields, *[rows.schema[c] for c in carry]])
    return blocks.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(_kept(with_text, carry), out)


def op9_two_stage_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without bytes covered by 50-byte strings of documents with smaller ids."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
