"""Calendars in ICS files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_calendars(spark: SparkSession, folder: str) -> DataFrame:
    """path, summary, start of the events in a folder's ICS files."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.ics").text(folder)
    return events(files.select(F.col("_metadata.file_path").alias("path"), "value"), "value").drop("value")


def events(df: DataFrame, text: str) -> DataFrame:
    """One row per event with a summary and a start; folded lines are joined, repeating events left out, zones ignored."""
    unfolded = F.regexp_replace(F.col(text), r"\r?\n[ \t]", "")
    blocks = F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))

    def field(block: Column, name: str) -> Column:
        return F.trim(F.regexp_extract(block, rf"(?m)^{name}(?:;[^:\n]*)?:([^\r\n]*)", 1))

    each = df.withColumn("_event", F.explode(blocks))
    stamp = field(F.col("_event"), "DTSTART")
    start = F.coalesce(F.try_to_timestamp(F.substring(stamp, 1, 15), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(F.substring(stamp, 1, 8), F.lit("yyyyMMdd")))
    found = each.withColumn("summary", field(F.col("_event"), "SUMMARY")).withColumn("start", start)
    return found.filter((F.col("summary") != "") & F.col("start").isNotNull() & ~F.col("_event").rlike(r"(?m)^RRULE")).drop("_event")


def on_day(calendar: DataFrame, day: str) -> DataFrame:
    return calendar.filter(F.to_date("start") == F.to_date(F.lit(day))).orderBy("start", "summary")
