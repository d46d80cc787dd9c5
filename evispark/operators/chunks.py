"""Chunks of documents by headings or paragraphs, and hashed word vectors. A text is folded in order, so these run in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = "array<struct<chunk int, heading_path string, text string, start int, stop int, words int>>"
TARGET, OVERLAP = 1200, 200
_HEADING = re.compile(r"^[^\S\n]*(#{1,6}) +(\S.*)$", re.M)
_WORD = re.compile(r"\S+")


def sections(text: str) -> Iterator[tuple[str, int, int]]:
    """(heading path, start, stop): a heading of level n replaces what the path has from its n-th place on."""
    path: list[str] = []
    start, name = 0, ""
    for m in _HEADING.finditer(text):
        if m.start() > start:
            yield name, start, m.start()
        path[len(m[1]) - 1 :] = [m[2].strip()]
        start, name = m.start(), " > ".join(path)
    if start < len(text) or not text:
        yield name, start, len(text)


def windows(text: str, start: int, stop: int, target: int, overlap: int) -> Iterator[tuple[int, int]]:
    """The whole range if it has at most `target` words, else runs of so many, each sharing `overlap` with the next."""
    spans = [m.span() for m in _WORD.finditer(text, start, stop)]
    if len(spans) <= target:
        yield start, stop
        return
    step = max(1, target - min(overlap, target - 1))
    for first in range(0, max(1, len(spans) - target + step), step):
        yield spans[first][0], spans[min(first + target, len(spans)) - 1][1]


def by_heading(text: str, target: int, overlap: int) -> list[tuple]:
    return [(name, text[i:j].strip(), i, j) for name, a, b in sections(text) for i, j in windows(text, a, b, target, overlap)]


def by_paragraph(text: str, target: int, overlap: int) -> list[tuple]:
    """Paragraphs, joined as long as they have `target` words together; a longer one is cut into windows of its own."""
    out, held, size, at = [], [], 0, 0

    def close():
        if held:
            out.append(("", "".join(text[i:j] for i, j in held).strip(), held[0][0], held[-1][1]))
            held.clear()

    for part in text.split("\n\n"):
        i, j, n = at, min(at + len(part) + 2, len(text)), len(_WORD.findall(part))
        at = j
        if not n:
            continue
        if n > target or size + n > target:
            close()
            size = 0
        if n > target:
            out += [("", text[a:b].strip(), a, b) for a, b in windows(text, i, j, target, overlap)]
        else:
            held.append((i, j))
            size += n
    close()
    return out


def chunks(df: DataFrame, headings: bool, target: int = TARGET, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, heading_path, text, start, stop, words) of every row; offsets count characters. A null text has no chunk,
    an empty one has an empty chunk by headings and none by paragraphs."""
    cut = by_heading if headings else by_paragraph

    @F.pandas_udf(CHUNK)
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            return [] if t is None else [(k, h, c, a, b, len(_WORD.findall(c))) for k, (h, c, a, b) in enumerate(cut(t, target, overlap))]

        return pd.Series([one(t) for t in texts], dtype=object)

    return df.select(F.col(key), F.inline(run(F.col(text))))


def hashed_vector(dim: int = 384):
    """A column function: counts of words at hashed places with hashed signs, to length 1. A text without words is one word; null
    gives null."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, int]] = {}

        def place(word):
            if len(known) > 200_000:
                known.clear()
            if word not in known:
                digest = hashlib.blake2b(word.encode("utf-8"), digest_size=16).digest()
                known[word] = int.from_bytes(digest[:4], "big") % dim, 1 - 2 * (digest[4] & 1)
            return known[word]

        def one(text):
            if text is None:
                return None
            v = np.zeros(dim)
            for word, n in (Counter(re.findall(r"[a-z0-9_]+", text.lower())) or {text: 1}).items():
                at, sign = place(word)
                v[at] += sign * n
            return v / (np.linalg.norm(v) or 1.0)

        return pd.Series([one(t) for t in texts], dtype=object)

    return run
