"""Mixing sources to target weights by Poisson replication; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, rank_in, shuffle_width

#: Without given weights, a source's target weight is its share of the rows to this power, scaled to sum 1.
TEMPERATURE = 0.7
#: Rates and steps are broadcast while they are at most so many numbers (16 MB); beyond, rows meet them in a join over SALTS parts a source.
BROADCAST_NUMBERS, SALTS = 2_000_000, 64
#: No number of `uniform` is larger.
_LARGEST = ((1 << 52) - 0.5) / (1 << 52)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of the parts, joined by `:`; engines agree on it."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """Cumulative Poisson probabilities for 0, 1, 2 ... of a mean, as far as a uniform number can be above them.

    Terms are exp(k ln m - m - ln k!), so that large means don't underflow.
    """
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0.0).alias("fact"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("steps"))

    def step(s: Column, k: Column) -> Column:
        fact = s["fact"] + F.when(k > 0, F.ln(F.greatest(k, F.lit(1)).cast("double"))).otherwise(0.0)
        total = s["sum"] + F.exp(k * F.ln(rate) - rate - fact)
        return F.struct(fact.alias("fact"), total.alias("sum"), F.concat(s["steps"], F.array(total)).alias("steps"))

    steps = F.aggregate(F.sequence(F.lit(0), most), start, step)["steps"]
    return F.when(rate > 0, F.filter(steps, lambda x: x < F.lit(_LARGEST))).otherwise(F.array().cast("array<double>"))


def source_rates(df: DataFrame, source: str, weights: dict | None, target_rows: int | None) -> DataFrame:
    """`source`, its rows and `rate` = target_rows * weight / rows: the mean number of times a row is to be repeated.

    One row per source; sums over sources are aggregates, and joins leave the choice of broadcast to sizes that Spark
    has measured.
    """
    counts = df.groupBy(source).agg(F.count("*").alias("__rows"))
    if weights is None:
        share = F.pow(F.col("__rows").cast("double"), F.lit(TEMPERATURE))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        share = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(source)), F.lit(0.0)) if pairs else F.lit(0.0)
    counts = counts.withColumn("__share", share)
    total = counts.agg(F.sum("__share").alias("__shares"), F.sum("__rows").alias("__all"))
    target = F.col("__all") if target_rows is None else F.lit(target_rows)
    one = counts.withColumn("__one", F.lit(1)).join(total.withColumn("__one", F.lit(1)), "__one")
    return one.select(source, F.coalesce(F.try_divide(target * F.col("__share"), F.col("__shares") * F.col("__rows")), F.lit(0.0)).alias("rate"))


def mix_sources(df: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: dict | None = None, target_rows: int | None = None, seed: int = 0, position: bool = True) -> DataFrame:
    """Repeats each row as often as a Poisson variable of its source's rate says, and shuffles all copies.

    Adds `copy` (from 1), `copies`, `rate`, `shuffle_key` and, if asked for, `position`: the gapless place in the global
    shuffle. The number of copies inverts the distribution at a uniform number hashed from seed and id, so a rerun, a lost executor
    or other rows change nothing. A null source is a source of its own (weight by its rows; 0 if weights are given and lack
    it); a null id hashes as `~`; rows that repeat an id get the same count. An empty table gives an empty result. Columns of the
    added names are replaced, names with `__` are kept for the operator. A hot source is no group: its rate is broadcast where rates
    are few, and met by salted keys where they aren't; equal shuffle keys are numbered in several tasks.
    """
    df = df.drop("copy", "copies", "rate", "shuffle_key", "position")
    u = uniform(F.lit(f"count{seed}"), F.col(doc_id))
    joined = _with_rates(df, source, source_rates(df.select(source), source, weights, target_rows))
    copies = F.size(F.filter("__steps", lambda upto: upto < F.col("__u")))
    many = joined.withColumn("__u", u).withColumn("copies", copies).drop("__steps", "__u").filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    many = many.withColumn("shuffle_key", shuffle_key(seed, F.col(doc_id), F.col("copy")))
    if not position:
        return many.repartition(shuffle_width(df.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")
    return rank_in(many.withColumn("__all", F.lit(0)), ["__all"], F.col("shuffle_key"), "position", bits=60).drop("__all")


def shuffle_key(seed: int, doc_id: Column, copy: Column) -> Column:
    """60 bits of a hash; engines agree on it."""
    name = F.concat_ws(":", F.lit(f"shuffle{seed}"), F.coalesce(doc_id.cast("string"), F.lit("~")), copy.cast("string"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def _with_rates(df: DataFrame, source: str, rates: DataFrame) -> DataFrame:
    """`df` with `rate` and `__steps` of each row's source, nulls included."""
    rates = cut(rates.withColumn("__steps", poisson_steps(F.col("rate"))).withColumnRenamed(source, "__source"))
    numbers = rates.agg(F.sum(F.size("__steps") + 4)).first()[0] or 0
    if numbers <= BROADCAST_NUMBERS:
        return df.join(F.broadcast(rates), df[source].eqNullSafe(rates["__source"])).drop("__source")
    salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = df.withColumn("__by", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant"))]), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, dealt[source].eqNullSafe(salted["__source"]) & (F.col("__by") == F.col("__salt"))).drop("__source", "__by", "__salt")


def op8_poisson_mix(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed to the tempered weights of their sources and shuffled: doc_id, source, copy, copies, rate and the place
    of each copy in the global shuffle."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix_sources(docs).select("doc_id", "source", "copy", "copies", F.round("rate", 9).alias("rate"), "shuffle_key", "position")


def op8_sql() -> str:
    return f"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), {TEMPERATURE}) AS share FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM c) * share / ((SELECT sum(share) FROM c) * n) AS rate FROM c),
p AS (SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS upto FROM r
    UNION ALL SELECT source, rate, k + 1, term * rate / (k + 1), upto + term * rate / (k + 1) FROM p WHERE k < rate + 12 * sqrt(rate) + 30),
d AS (SELECT doc_id, source, (CAST('0x' || substr(md5('count0:' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
m AS (SELECT doc_id, d.source, p.rate, CAST(sum(CASE WHEN upto < u THEN 1 ELSE 0 END) AS INTEGER) AS copies FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source GROUP BY doc_id, d.source, p.rate),
e AS (SELECT doc_id, source, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS "copy", copies, rate FROM m WHERE copies > 0),
k AS (SELECT *, CAST('0x' || substr(md5('shuffle0:' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || "copy"), 1, 15) AS BIGINT) AS shuffle_key FROM e)
SELECT doc_id, source, "copy", copies, round(rate, 9) AS rate, shuffle_key, row_number() OVER (ORDER BY shuffle_key, doc_id, source, "copy") - 1 AS position FROM k"""
