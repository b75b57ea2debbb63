"""A scheduler's ticks as micro-batches: each dispatches what is due, once, also when a batch is replayed.

A tick is a micro-batch of new items (id, due, period in seconds or null). Its time is the latest one seen so far. Items
due by then are dispatched, the others wait; an item with a period waits for its next time after the tick (times that
were missed while nothing ran are passed over). All that a batch writes goes to folders named by its number and replaces
what an earlier try of the same batch wrote there, and what it reads besides its rows is the folder of the batch before.
So a batch that is run again, as Spark does after a failure, leaves the same files. Items that arrive twice (the
same id and due time, in one batch or while the first waits) count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM = "id long, due timestamp, period double"
WAITING = ITEM + ", clock timestamp"
SENT = ITEM + ", tick timestamp"


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def tick(rows: DataFrame, batch: int, folder: str, time: str = "ts") -> None:
    """Run one tick on a micro-batch of items with the time they came."""
    spark = rows.sparkSession
    files, last = _folder(spark, f"{folder}/waiting/batch={batch - 1}")
    before = spark.read.schema(WAITING).parquet(str(last)) if files.exists(last) else spark.createDataFrame([], WAITING)
    clock = rows.agg(F.max(time).alias("t")).unionByName(before.agg(F.max("clock").alias("t"))).agg(F.max("t").alias("clock"))
    every = before.select("id", "due", "period").unionByName(rows.select("id", "due", "period")).filter("due IS NOT NULL")
    every = every.groupBy("id", "due").agg(F.min("period").alias("period")).crossJoin(F.broadcast(clock))  # one row
    due = every.filter("due <= clock")
    due.select("id", "due", "period", F.col("clock").alias("tick")).write.mode("overwrite").parquet(f"{folder}/sent/batch={batch}")
    missed = F.floor((F.unix_micros("clock") - F.unix_micros("due")) / (F.col("period") * 1e6)) + 1
    later = due.filter("period > 0").withColumn("due", F.timestamp_micros(F.unix_micros("due") + (missed * F.col("period") * 1e6).cast("long")))
    # the clock goes on in a row without an item
    empty = clock.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("timestamp").alias("due"), F.lit(None).cast("double").alias("period"), "clock")
    waiting = later.unionByName(every.filter("due > clock")).select("id", "due", "period", "clock").unionByName(empty)
    waiting.write.mode("overwrite").parquet(f"{folder}/waiting/batch={batch}")
    files.delete(_folder(spark, f"{folder}/waiting/batch={batch - 2}")[1], True)  # no batch reads it again


def sent(spark: SparkSession, folder: str) -> DataFrame:
    """id, due, tick, batch of everything dispatched."""
    return spark.read.schema(SENT + ", batch long").option("basePath", f"{folder}/sent").parquet(f"{folder}/sent").select("id", "due", "tick", "batch")


def run_ticks(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Run a stream of items to its end, one tick a micro-batch."""
    stream.writeStream.foreachBatch(lambda rows, batch: tick(rows, batch, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

