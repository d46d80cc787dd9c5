"""Language ID by error-correcting output codes over hashed byte trigrams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, extended, held_out, schema, slices, text_bytes

DIMS = 1 << 13
#: Codeword distances closer than this are flagged as ambiguous.
AMBIGUOUS = 0.05
UNDETERMINED = "und"


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of each byte trigram inside a document, ASCII letters lower-cased, digits and marks as spaces."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[[*range(65), *range(91, 97), *range(123, 128)]] = 32
    low = fold[data].astype(np.uint32)
    if len(low) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = (doc[:-2] == doc[2:]) & (code != 0x202020)
    return bucket[inside], doc[:-2][inside]


def _count(batches):
    """Rows (lang, bucket, n) of one task: at most DIMS for each language, however many texts it read."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column("lang").to_pylist()
        data, offsets = text_bytes(b.column("text"))
        for at, to in slices(offsets):
            bucket, doc = _grams(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            names = sorted({x for x in langs[at:to] if x is not None})
            code = np.array([names.index(x) if x is not None else -1 for x in langs[at:to]], np.int64)[doc]
            known = code >= 0
            found = np.bincount(code[known] * DIMS + bucket[known], minlength=len(names) * DIMS).reshape(-1, DIMS)
            for i, x in enumerate(names):
                sums[x] = sums[x] + found[i] if x in sums else found[i].copy()
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield batch({"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": total[at].astype(np.int64)})
    if not sums:
        yield batch({"lang": pa.array([], pa.string()), "bucket": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})


def codewords(classes: int, seed: int = 0) -> np.ndarray:
    """+1/-1, one row a class: the exhaustive code up to 6 classes, above it the best spread of 50 random dense codes."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 6:
        columns = np.arange(1, 1 << (classes - 1))
        return np.array([np.ones(len(columns))] + [np.where(columns >> i & 1, -1.0, 1.0) for i in range(classes - 1)])
    rng, bits, best, spread = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(classes))), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (classes, bits))
        code[0, np.abs(code.sum(0)) == classes] *= -1
        away = (bits - code @ code.T) / 2
        np.fill_diagonal(away, bits)
        if away.min() > spread:
            best, spread = code, away.min()
    return best


class Model:
    """Codewords, and for each bit a linear classifier over trigram buckets with a weight by how well it separates."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.code = codewords(len(self.langs))
        if not self.langs:
            self.weights, self.bits = np.zeros((DIMS, 0), np.float32), np.zeros(0)
            return
        share = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * DIMS) for x in self.langs])
        columns, apart = [], []
        for bit in self.code.T:
            sides = [share[bit == s].mean(0) if (bit == s).any() else np.full(DIMS, 1 / DIMS) for s in (1, -1)]
            columns.append(np.log(sides[0]) - np.log(sides[1]))
            apart.append(((sides[0] - sides[1]) * columns[-1]).sum())
        self.weights = np.array(columns, np.float32).T.copy()
        self.bits = np.array(apart) / max(np.mean(apart), 1e-12)

    def decode(self, sums: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, score, ambiguous) by the weighted logistic loss between bit margins and each codeword."""
        if len(self.langs) == 1:
            return np.zeros(len(sums), int), np.ones(len(sums)), np.zeros(len(sums), bool)
        margin = sums / np.sqrt(grams + 1.0)[:, None]
        loss = np.array([np.logaddexp(0, -margin * c) @ self.bits for c in self.code]).T / len(self.bits)
        best = loss.argmin(1)
        score = np.exp(-(loss - loss.min(1, keepdims=True)) * len(self.bits))
        two = np.partition(loss, 1, axis=1)
        return best, 1 / score.sum(1), two[:, 1] - two[:, 0] < AMBIGUOUS


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model from all rows with a language: trigram counts by language are summed by Spark; what comes to the driver
    are DIMS numbers for each language. Null languages teach nothing, null and empty texts have no trigrams, repeated rows count
    each, other columns play no part."""
    rows = df.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sums = rows.mapInArrow(_count, schema("lang string, bucket int, n long")).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for name, bucket, n in sums.collect():
        counts.setdefault(name, np.zeros(DIMS))[bucket] = n
    return Model(counts)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = np.zeros(256, np.int64)
    letter[[*range(65, 91), *range(97, 123)]] = 1
    seen = np.concatenate([[0], np.cumsum(letter[data])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds `lang_pred`, `score` (0 to 1) and `ambiguous` to all rows.

    A text that is null, empty or without a letter gets `und`, score 0, not ambiguous; so does every text if nothing was
    learned. A text with letters but under three bytes has no trigram: it gets the language that comes first in the alphabet among those
    the zero margins leave equal, and is ambiguous where several were learned; so do ties. Equal texts get equal predictions, very long
    texts are read whole, null ids and repeated rows are like others, an empty table gives an empty result. Columns of the added
    names are replaced.
    """
    df = df.drop("lang_pred", "score", "ambiguous")

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(text))
            pred, score, unsure = [], [], []
            for at, to in slices(offsets):
                part, where = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
                ok = _has_letter(part, where) & bool(model.langs)
                if not model.langs:
                    pred += [UNDETERMINED] * (to - at)
                    score.append(np.zeros(to - at))
                    unsure.append(np.zeros(to - at, bool))
                    continue
                bucket, doc = _grams(part, where)
                n = np.bincount(doc, minlength=to - at)
                sums = np.stack([np.bincount(doc, weights=w[bucket], minlength=to - at) for w in model.weights.T], 1)
                best, sure, close = model.decode(sums, n)
                pred += [model.langs[k] if x else UNDETERMINED for k, x in zip(best, ok)]
                score.append(np.where(ok, sure, 0.0))
                unsure.append(close & ok)
            more = [pa.array(pred, pa.string()), pa.array(np.concatenate([*score, []]).astype(float)), pa.array(np.concatenate([*unsure, []]).astype(bool))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "lang_pred", "score", "ambiguous"])

    return df.mapInArrow(run, extended(df, "lang_pred string, score double, ambiguous boolean"))


def op7_ecoc_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document; learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 3, 1))
    model = learn(docs.filter(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
