"""Stored intermediate tables in the folder that all nodes share."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that Spark hands to a Python worker, about, and Spark's own bound, which it takes the place of.
ARROW_BYTES, SPARK_ARROW_BYTES = "4m", "67108864b"
#: Paths of the stored tables of this process that have not been dropped.
_stored: list[str] = []
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a new local one, with a warning: that suits one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _own_dir:
        warnings.warn("spark.checkpoint.dir is unset: tables are stored in a local folder, which a cluster can't share", stacklevel=2)
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="lumenote-"))
    return _own_dir[0]


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back.

    A lost executor then costs no recomputation, and several readers share one computation. The shuffle files of the
    write are deleted with its end.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    _stored.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what came of them is stored itself."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)


def keep_only(df: DataFrame, since: int = 0) -> None:
    """Delete all stored tables but this one that were written after the first `since` of stored_count()."""
    for path in [p for p in _stored[since:] if p != df.stored_at]:
        _delete(df.sparkSession, path)


def stored_count() -> int:
    return len(_stored)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _stored.remove(path)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by fewer bytes, unless the session has a bound of its own: Python workers stay small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == SPARK_ARROW_BYTES:
        spark.conf.set(key, ARROW_BYTES)
