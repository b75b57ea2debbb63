"""Telemetry analytics: sane rows, nearest-rank percentiles, counting upserts, islands, counters, integrals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """key, share, value at index round-half-even(share * (n - 1)) of the key's sorted values; nulls are left out."""
    w = Window.partitionBy(key)
    ranked = df.filter(F.col(value).isNotNull()).select(key, value, (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    asked = F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")
    return ranked.select(key, value, "i", "n", asked).filter(F.col("i") == F.bround(F.col("share") * (F.col("n") - 1))).select(key, "share", value)


def last_rows(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n rows of each key that come last by a unique order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= n).drop("_nth")


def counting_upsert(df: DataFrame, keys: list[str], text: str, seq: str, seen: Column) -> DataFrame:
    """n, first text and last time of each key: what repeated count-or-insert leaves."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(text, seq).alias("first_text"), F.max(seen).alias("last_seen"))


def streaks(days: DataFrame, key: str, day: str, today: str) -> DataFrame:
    """Length of each key's run of consecutive days that ends today, or yesterday if today is unmarked; else 0."""
    one = days.select(key, F.col(day).alias("day")).distinct().filter(F.col("day") <= F.to_date(F.lit(today)))
    island = one.withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day"))))
    runs = island.groupBy(key, "island").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    now = F.when(F.col("last") >= F.date_sub(F.to_date(F.lit(today)), 1), F.col("n")).otherwise(0)
    return runs.groupBy(key).agg(F.max(now).cast("long").alias("streak"))


def counter_steps(df: DataFrame, key: str, order: str, seconds: str, reading: str, most_gap: float, most_step: float) -> DataFrame:
    """step and reason between consecutive readings of a rising counter. The baseline always moves on.

    Reasons: first, backward_clock, gap, reset, absurd, ok; only ok has a step.
    """
    w = Window.partitionBy(key).orderBy(order)
    before, then = F.lag(reading).over(w), F.lag(seconds).over(w)
    dt, dv = F.col(seconds) - then, F.col(reading) - before
    reason = F.when(before.isNull(), "first").when(dt <= 0, "backward_clock").when(dt > most_gap, "gap").when(dv < 0, "reset").when(dv > most_step, "absurd").otherwise("ok")
    return df.withColumn("reason", reason).withColumn("step", F.when(F.col("reason") == "ok", dv))


def trapezoids(df: DataFrame, key: str, order: str, seconds: str, power: str, most_gap: float) -> DataFrame:
    """energy between consecutive valid readings: mean of both ends times the time between. A missing or negative
    reading drops the baseline, so the next one starts anew."""
    w = Window.partitionBy(key).orderBy(order)
    before, then = F.lag(power).over(w), F.lag(seconds).over(w)
    dt = F.col(seconds) - then
    valid = (before >= 0) & (F.col(power) >= 0) & (dt > 0) & (dt <= most_gap)
    return df.withColumn("energy", F.when(valid, (before + F.col(power)) / 2 * dt).otherwise(0.0))


def daily_spine(daily: DataFrame, key: str, day: str, first: str, last: str, value: str) -> DataFrame:
    """Every day from first to last of every key with its value, 0 where there is none."""
    days = F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias(day)
    return daily.select(key).distinct().select(key, days).join(daily, [key, day], "left").select(key, day, F.coalesce(value, F.lit(0.0)).alias(value))


def back_off(failures: Column, free: int, base: float, most: float) -> Column:
    """Seconds to wait after so many consecutive failures: none at first, then doubling, capped."""
    return F.when(failures <= free, F.lit(0.0)).otherwise(F.least(base * F.pow(F.lit(2.0), F.least(failures - free - 1, F.lit(20))), F.lit(float(most))))


def next_occurrence(kind: Column, at: Column, seconds: Column, now: Column) -> Column:
    """The first time after now of a daily, weekly or every-n-seconds schedule that was due at `at` (timestamps)."""
    period = F.when(kind == "diario", F.lit(86_400)).when(kind == "semanal", F.lit(7 * 86_400)).otherwise(seconds)
    late = F.unix_timestamp(now) - F.unix_timestamp(at)
    steps = F.when(late < 0, F.lit(0)).otherwise(F.floor(late / period) + 1)
    return F.timestamp_seconds(F.unix_timestamp(at) + steps * period)


def leitner(box: Column, right: Column, intervals: list[int]) -> tuple[Column, Column]:
    """Next box and the days until the card is due: up one when right (capped), back to 0 when wrong."""
    days = F.array(*(F.lit(x) for x in (intervals or [1])))
    step = F.when(right, F.least(box + 1, F.lit(len(intervals or [1]) - 1))).otherwise(0)
    return step, F.get(days, step)


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between the points, and the end points' values beyond them."""
    points = sorted(points)
    out = F.lit(points[-1][1])
    for (a, ya), (b, yb) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(x <= b, ya + (yb - ya) * (x - a) / (b - a)).otherwise(out)
    return F.when(x <= points[0][0], points[0][1]).otherwise(out)
