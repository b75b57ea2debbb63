"""Reading notes: Markdown files with a `key: value` header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = r"^---\n((?:[^\n]*\n)*?)---\n?"


def read_vault(spark: SparkSession, folder: str) -> DataFrame:
    """source, mtime, text of every Markdown file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    return files.select(F.col("path").alias("source"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"))


def front_matter(text: Column) -> Column:
    """Map of the header's keys to values, split at the first colon; empty values and texts without header give nothing."""
    lines = F.filter(F.split(F.regexp_extract(text, HEADER, 1), "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    first = F.filter(pairs, lambda p: p["v"] != "")
    return F.map_from_entries(F.aggregate(first, F.array().cast("array<struct<k:string,v:string>>"), lambda a, p: F.when(F.exists(a, lambda q: q["k"] == p["k"]), a).otherwise(F.concat(a, F.array(p)))))


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, HEADER, "")
