"""Readers and writers: text folders, JSON lines, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESERVED = r"(^|/)(\.|_|manifest)[^/]*$"


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, source_type) of all files below a folder, without hidden and reserved names."""
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    out = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("bytes"))
    return out.filter(~F.col("path").rlike(RESERVED)).withColumn("source_type", source_type(F.col("path"), F.col("text")))


def source_type(path: Column, text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 2000))
    return F.when(path.rlike(r"\.jsonl$"), "agent_session_log").when(~path.rlike(r"\.(md|markdown|txt)$"), None).when(head.contains("transcript"), "meeting_transcript").otherwise("markdown_note")


def json_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Rows of line JSON; broken lines are left out."""
    lines = spark.read.text(path).select(F.from_json("value", ddl, {"mode": "PERMISSIVE"}).alias("r"), "value").filter(F.trim("value") != "")
    valid = F.try_parse_json("value").isNotNull()
    return lines.filter(valid & F.col("r").isNotNull()).select("r.*")


def front_matter(text: Column) -> Column:
    """The block between a leading `---` line and the next, null without one."""
    got = F.regexp_extract(text, r"\A---\n([\s\S]*?)\n---(\n|\z)", 1)
    return F.when(got != "", got)


def front_matter_value(text: Column, key: str) -> Column:
    got = F.regexp_extract(front_matter(text), rf"(?m)^{key}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)
    return F.when(got != "", got)


def title(path: Column, text: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1), "[-_]+", " ")
    return F.substring(F.coalesce(front_matter_value(text, "title"), F.initcap(stem)), 1, 200)


def replace_documents(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of `new`, and those of `old` whose keys it lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
