"""Packing of documents into token windows: bounded-space online best fit."""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, schema

WINDOW = 1024
#: Windows that stay open in each partition.
OPEN = 64
#: So many tasks' leftover windows are merged by one task, in as many rounds as it takes.
MERGE = 64
#: A worker forgets its words beyond this number.
WORDS = 250_000

PIECE = "doc_id {id}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, home long"


class WordCoder(dict):
    """Token ids of whole texts, as little-endian uint32 bytes, from the vocabulary file's merge ranks. `special` strings become
    their ids wherever they stand; the text between them is encoded by itself.

    The pattern that cuts texts before merging lets a token begin, never go on, at a space before another character;
    so a text without double spaces is the sequence of its space-led words, and each word is merged once.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int] | None = None):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = {x: np.array([i], "<u4").tobytes() for x, i in (special or {}).items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

    def __missing__(self, word: str) -> bytes:
        self[word] = out = self.whole(" " + word)
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return b"".join(self.special.get(part) or self.plain(part) for part in self.cut.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if "  " in text or text[-1:] == " ":
            return self.whole(text)
        if len(self) > WORDS:
            self.clear()
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


class Packer:
    """Open windows of one partition. Each is a list of pieces (doc, start, ids, doc_tokens) with its fill."""

    def __init__(self, window: int, most: int):
        self.window, self.most, self.open = window, most, []

    def add(self, doc, start: int, ids: bytes, total: int) -> list[list]:
        """Places ids; gives the windows that are done. Runs of a whole window stand alone. The rest goes to the open
        window it leaves least room in; if none has room and no more may open, the fullest is filled up and emitted."""
        done, n = [], len(ids) // 4
        while n >= self.window:
            done.append([(doc, start, ids[: 4 * self.window], total)])
            start, ids, n = start + self.window, ids[4 * self.window :], n - self.window
        while n:
            fits = [w for w in self.open if w[0] + n <= self.window]
            if fits or len(self.open) < self.most:
                if fits:
                    w = max(fits, key=lambda w: w[0])
                else:
                    self.open.append(w := [0, []])
                w[0] += n
                w[1].append((doc, start, ids, total))
                if w[0] == self.window:
                    self.open.remove(w)
                    done.append(w[1])
                break
            w = max(self.open, key=lambda w: w[0])
            room = self.window - w[0]
            w[1].append((doc, start, ids[: 4 * room], total))
            self.open.remove(w)
            done.append(w[1])
            start, ids, n = start + room, ids[4 * room :], n - room
        return done


class _Rows:
    """Collects pieces and turns them into record batches."""

    def __init__(self, id_type: pa.DataType, keep_ids: bool, level: int, home: int):
        if level >= 1 << 3 or home >= 1 << 30:
            raise OverflowError("sequence ids have room for 2^30 tasks")
        self.id_type, self.keep_ids, self.home, self.rows = id_type, keep_ids, home, []
        self.next = (level << 60) + (home << 30)
        self.end = self.next + (1 << 30)

    def window(self, pieces: list, final: bool = True) -> None:
        if self.next == self.end:
            raise OverflowError("a task has 2^30 windows; use more tasks")
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, ids if self.keep_ids or not final else None, zlib.crc32(ids), total, self.next, at, -1 if final else self.home))
            at += n
        self.next += 1

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 9
        self.rows = []
        types = [self.id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "home"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def pack_documents(df: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0, open_windows: int = OPEN, keep_ids: bool = True, doc_id: str = "doc_id", text: str = "text", special: dict[str, int] | None = None) -> DataFrame:
    """Pieces of documents in windows of at most `window` tokens: (doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset).

    `tokenizer` names a merge-rank file; a document is its ids and `end_id`; strings of `special` in a text become the ids given there. Each task packs what it reads into windows of
    which `open_windows` are open at a time; those still open at its end are merged, 64 tasks' at a time, until one task's
    are left. Pieces are cut only to fill a window, so only the last few windows have room. `ids` (little-endian uint32) is
    null without `keep_ids`. A null or empty text is its end id alone; a very long one fills windows of its own; rows
    that repeat an id are packed like others; null ids are kept; an empty table gives an empty result; other columns
    play no part. Sequence ids depend on how the table is dealt to tasks and are stable over reruns of a task.
    """
    import public_tokenizers

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    pattern, end = public_tokenizers.PATTERN, np.array([end_id], "<u4").tobytes()

    def first(batches):
        task = TaskContext.get().partitionId()
        coder, packer, out = WordCoder(tokenizer, pattern, special), Packer(window, open_windows), None
        for b in batches:
            out = out or _Rows(b.schema.field("doc_id").type, keep_ids, 0, task)
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = coder.encode(t.as_py() or "") + end
                for done in packer.add(doc, 0, ids, len(ids) // 4):
                    out.window(done)
                if len(out.rows) > 20_000:
                    yield out.take()
        if out:
            for _, pieces in packer.open:
                out.window(pieces, final=False)
            yield out.take()

    ddl = PIECE.format(id=kind.simpleString())
    pieces = cut(rows.mapInArrow(first, schema(ddl)))
    finals, level = [pieces.filter("home < 0")], 1
    rest = pieces.filter("home >= 0")
    tasks = (rest.agg(F.max("home")).first()[0] or 0) + 1
    while True:
        merged = rest.withColumn("group", F.floor(F.col("home") / MERGE).cast("long")).groupBy("group").applyInArrow(_merge(window, open_windows, keep_ids, level, tasks <= MERGE), schema(ddl))
        if tasks <= MERGE:
            finals.append(merged)
            break
        merged = cut(merged)
        finals.append(merged.filter("home < 0"))
        rest, tasks, level = merged.filter("home >= 0"), -(-tasks // MERGE), level + 1
    out = finals[0]
    for more in finals[1:]:
        out = out.unionAll(more)
    return out.drop("home")


def _merge(window: int, most: int, keep_ids: bool, level: int, last: bool):
    """Packs the leftover windows of a group of tasks: fullest first, cut to fill. What stays open goes on, or out if last."""

    def run(key, table):
        home = key[0].as_py()
        out = _Rows(table.schema.field("doc_id").type, keep_ids, level, home)
        packer = Packer(window, 1 if last else most)
        t = table.select(["sequence_id", "offset", "doc_id", "start", "ids", "doc_tokens"]).to_pylist()
        fill = Counter()
        for r in t:
            fill[r["sequence_id"]] += len(r["ids"])
        t.sort(key=lambda r: (-fill[r["sequence_id"]], r["sequence_id"], r["offset"]))
        for r in t:
            for done in packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]):
                out.window(done)
        for _, pieces in packer.open:
            out.window(pieces, final=last)
        return pa.Table.from_batches([out.take()])

    return run


#: The special token of the 50k byte-level vocabulary (fixed value): its string in a text is this id.
SPECIAL = {"<|endoftext|>": 50256}


def op10_bounded_space_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents as pieces in windows of 1024 ids of the 50k byte-level vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pack_documents(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False, special=SPECIAL)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
