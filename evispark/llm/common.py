"""What the operators of this package share: zero-copy text access, hashing and lineage cuts."""

from __future__ import annotations

import gc
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that numpy looks at in one go; temporaries are about 60 times as large.
SLICE_BYTES = 1 << 20
#: Tasks that share a range of equal values.
SALTS = 64

_ODD = 0x9E3779B97F4A7C15 | 1
_INV = pow(_ODD, -1, 1 << 64)


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; a temporary one only where that is unset (local sessions, tests), as
    other executors can't read a machine-local folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="evispark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    release(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of earlier steps that nothing refers to any more: it does so when the driver's collector
    finds them, which in a driver with memory to spare is long after a loop of many small steps has left theirs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _ODD), ("down", _INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


def prefix_hashes(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(h, down): the hash of bytes s to e is (h[e] - h[s]) * down[s], wherever they stand."""
    up, down = powers.to(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=h[1:])
    return h, down


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return bytes_, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges whose texts have about `most` bytes; a longer text stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into `fold`; a null id is in none."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def extended(df: DataFrame, ddl: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *schema(ddl).fields])


def batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def rank_in(df: DataFrame, group: list[str], order: Column, out: str, rows_per_part: int = 50_000, bits: int = 64) -> DataFrame:
    """Adds `out`: the gapless position from 0 of each row in its group, by `order`, a long whose `bits` lower bits spread evenly.

    A group's rows are cut into ranges of `order`; a window numbers the rows of one range, and the ranges' counts
    give what to add. Where equal values make a range large, it is cut further by the rows' places in `df`, which is computed once
    for this. So no task sorts more than about `rows_per_part` rows, however large a group is or however many rows are equal. Rows of
    equal order in one part are numbered by all their columns.
    """
    keyed = cut(df.withColumns({"__order": order, "__row": F.monotonically_increasing_id()}))
    n = keyed.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-n // rows_per_part))
    keyed = keyed.withColumn("__part", F.floor((F.shiftrightunsigned("__order", bits - 32) * F.lit(parts)) / F.lit(float(1 << 32))).cast("long"))
    ranges = keyed.groupBy(*group, "__part").agg(F.ceil(F.count("*") / F.lit(2.0 * rows_per_part)).cast("long").alias("__cuts"))
    large = ranges.filter("__cuts > 1")
    if n > 2 * rows_per_part and large.limit(1).count():
        # a large range is split between tasks before it meets its number of cuts
        pieces = large.select(*group, "__part", "__cuts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
        keyed = keyed.withColumn("__salt", F.pmod(F.xxhash64("__row", F.lit("salt")), F.lit(SALTS)).cast("int")).join(pieces, [*group, "__part", "__salt"], "left")
        keyed = keyed.withColumn("__cut", F.coalesce(F.pmod(F.xxhash64("__row"), F.col("__cuts")), F.lit(0))).drop("__salt", "__cuts")
    else:
        keyed = keyed.withColumn("__cut", F.lit(0).cast("long"))
    counts = keyed.groupBy(*group, "__part", "__cut").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part", "__cut").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "__part", "__cut", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    plain = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    inside = Window.partitionBy(*group, "__part", "__cut").orderBy("__order", *plain)
    numbered = keyed.withColumn("__at", F.row_number().over(inside) - 1)
    return numbered.join(counts, [*group, "__part", "__cut"]).withColumn(out, (F.col("__before") + F.col("__at")).cast("long")).drop("__order", "__row", "__part", "__cut", "__before", "__at")
