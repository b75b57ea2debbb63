"""Index maintenance: what to process again, what to purge, who owns a path, which text is a clone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(files: DataFrame, index: DataFrame, version: int) -> DataFrame:
    """source, reason of files to process: not indexed, changed since, or indexed by an older version."""
    seen = index.groupBy("source").agg(F.max("mtime").alias("indexed"), F.min("meta_v").alias("v"))
    reason = F.when(F.col("indexed").isNull(), "new").when(F.col("mtime") > F.col("indexed"), "changed").when(F.col("v") < version, "version")
    return files.join(seen, "source", "left").select("source", reason.alias("reason")).filter("reason IS NOT NULL")


def orphans(index: DataFrame, files: DataFrame) -> DataFrame:
    """Sources of the index that are no longer among the files."""
    return index.select("source").distinct().join(files.select("source"), "source", "left_anti")


def owner_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, root: the deepest root that is the path or a folder above it, null if none.

    Every prefix of a path at a slash is looked up, so this is an equi-join, whatever the number of roots.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = paths.select("path").distinct().withColumn("root", F.explode(prefixes)).join(roots.select("root").distinct(), "root")
    best = each.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(best, "path", "left")


def clones(docs: DataFrame, key: Column, order: str) -> DataFrame:
    """Every row with its place among rows of equal key; place 1 is kept."""
    return docs.withColumn("place", F.row_number().over(Window.partitionBy(F.md5(key)).orderBy(order)))


def siblings(rows: DataFrame, seeds: DataFrame, id_column: str, group: list[str], text: str, most: int) -> DataFrame:
    """seed, id_column: of each seed the `most` rows of its group with the smallest ids whose text is another one.

    Seeds meet a bounded list of their group, whatever its size: of each text the first `most` rows, and of these the first
    2 * most, for at most half of them have the seed's own text. Rows with a null in group or text have no siblings.
    """
    known = rows.select(id_column, *group, text).dropna(subset=[*group, text])
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(id_column))
    few = known.withColumn("_n", nth(*group, text)).filter(F.col("_n") <= most).drop("_n")
    few = few.withColumn("_n", nth(*group)).filter(F.col("_n") <= 2 * most).drop("_n")
    asked = seeds.select(F.col(id_column).alias("seed"), *group, F.col(text).alias("_own"))
    met = asked.join(few, group).filter(F.col(text) != F.col("_own"))
    return met.withColumn("_n", nth("seed")).filter(F.col("_n") <= most).select("seed", id_column)
