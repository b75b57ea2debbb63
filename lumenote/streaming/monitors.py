"""Monitors over event streams: sessions, throttles, breakers, windowed counts with late data.

Times must be TIMESTAMP; a TIMESTAMP_NTZ column is cast, as session windows need it. `available_now` runs a file stream
to its end, which tests and back-fills use; a live job gives the same frame another trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, files: str, schema, late: str = "10 minutes") -> DataFrame:
    """The Parquet files of a folder whose names match `files` as a stream of events with watermarked time."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """One row per key and session: a run of events no further apart than `gap`."""
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def hourly(events: DataFrame, key: str) -> DataFrame:
    """Counts per key and hour; events later than the watermark are dropped."""
    grouped = events.groupBy(F.window("ts", "1 hour").alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("hour"), "n")


def throttle(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """Let an event of a key through if none of it was let through in the last `seconds`. Events of a micro-batch are
    taken in time order; the state is the last time let through, dropped once the watermark has passed its window."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t.timestamp() for frame in frames for t in frame["ts"]):
            if last is None or t - last >= seconds:
                out.append(t)
                last = t
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(int(max((last + seconds) * 1000, state.getCurrentWatermarkMs() + 1)) + 1)
        yield pd.DataFrame({key: [name[0]] * len(out), "s": out})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, s double", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def available_now(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run the stream over what is there, write it to Parquet, and return what was written."""
    stream.writeStream.format("parquet").option("compression", "zstd").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def replayed(rows: DataFrame, slices: int, folder: str, run) -> None:
    """Feed rows (with their number in the column `slice`) to a stream in that many steps, each at least one micro-batch.

    run(stream, checkpoint) starts a query on the stream of the files so far, to their end; the checkpoint is the same in
    every step, so the query goes on where it stopped.
    """
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c != "slice"]
    schema = rows.select(*columns).schema
    for s in range(slices):
        rows.filter(F.col("slice") == s).select(*columns).write.mode("append").option("compression", "zstd").parquet(f"{folder}/in")
        run(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/state")
