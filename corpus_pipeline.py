"""The corpus pipeline: language ID, near duplicates, repeated passages, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of `documents`; the last returns pieces of
token windows. A stage sees all that the one before kept. Columns beyond those of `documents`, clashing names among them, are
dropped at a stage's start. An empty table passes through every stage as an empty one. What stages do with nulls and repeated rows is said at each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import common, langid, mixing, neardup, packing, sadedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Passages of this many bytes or more that an earlier document has are removed: well under 50 words, well over a sentence's set phrase.
PASSAGE_BYTES = 100
#: A document is rejected if its codeword is ambiguous and its score is under this; one without a letter always is.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) or without a clear language; learns from all rows with a language.
    Null ids and repeated rows are judged by their texts, like others."""
    docs = docs.select(*COLUMNS)
    out = langid.predict(docs, langid.learn(docs))
    return out.filter((F.col("lang_pred") != langid.UNDETERMINED) & ~(F.col("ambiguous") & (F.col("score") < LEAST_SCORE))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, the first of those with the smallest doc_id: five-word shingles, similarity 0.8. Rows are dropped one
    by one, whatever ids they share; rows without words and rows without id stay."""
    return neardup.distinct_texts(docs.select(*COLUMNS), 5, 80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out of texts that a document with a smaller id has. A text of which nothing is left goes. Null texts are empty ones
    from here on; null ids take no part; rows of one id don't cut each other."""
    kept = sadedup.remove_repeats(docs.select(*COLUMNS), PASSAGE_BYTES, with_text=True, carry=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    size = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.filter(~changed | F.col("kept_text").rlike(r"\S")).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", size.alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents towards tempered source weights, in a global shuffle. A null source is a source; rows that repeat an id
    get the same number of copies."""
    return mixing.mix_sources(docs.select(*COLUMNS), position=False).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens. A null or empty text is its end token; ids may be null or repeat."""
    import public_tokenizers

    return packing.pack_documents(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False, special=packing.SPECIAL)


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mixing", mixture),
    ("packing", packing_stage),
]
#: Models, sets of shingles and tokenizers can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
