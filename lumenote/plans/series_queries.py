"""Queries over ordered data: streaks, counters, integrals, spines, sliding windows, schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import telemetry as M
from .base import query, table

TODAY = "2024-01-30"


def seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


ORDERED = "SELECT *, epoch_us(ts) / 1e6 AS s FROM events"


@query(
    "g1_streaks",
    f"""WITH o AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) <= DATE '{TODAY}'),
    i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM o),
    r AS (SELECT user_id, island, count(*) AS n, max(day) AS last FROM i GROUP BY 1, 2)
    SELECT user_id, CAST(max(CASE WHEN last >= DATE '{TODAY}' - 1 THEN n ELSE 0 END) AS BIGINT) AS streak FROM r GROUP BY user_id""",
)
def g1(spark, d):
    return M.streaks(table(spark, d, "events").withColumn("day", F.to_date("ts")), "user_id", "day", TODAY)


STEPS = f"""WITH o AS ({ORDERED}), l AS (SELECT *, lag(value) OVER w AS before, lag(s) OVER w AS prev FROM o WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 r AS (SELECT *, CASE WHEN before IS NULL THEN 'first' WHEN s - prev <= 0 THEN 'backward_clock' WHEN s - prev > 20000 THEN 'gap' WHEN value - before < 0 THEN 'reset' WHEN value - before > 100 THEN 'absurd' ELSE 'ok' END AS reason FROM l) """


@query("g2_counter_steps", STEPS + "SELECT user_id, reason, count(*) AS n, round(coalesce(sum(CASE WHEN reason = 'ok' THEN value - before END), 0), 4) AS total FROM r GROUP BY 1, 2")
def g2(spark, d):
    steps = M.counter_steps(table(spark, d, "events").withColumn("s", seconds()), "user_id", "event_id", "s", "value", 20_000, 100)
    return steps.groupBy("user_id", "reason").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("step"), F.lit(0.0)), 4).alias("total"))


@query("f25_discard_reasons", STEPS + "SELECT reason, count(*) AS n FROM r WHERE reason <> 'ok' GROUP BY reason")
def f25(spark, d):
    steps = M.counter_steps(table(spark, d, "events").withColumn("s", seconds()), "user_id", "event_id", "s", "value", 20_000, 100)
    return steps.filter("reason <> 'ok'").groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "g3_trapezoids",
    f"""WITH o AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS w FROM ({ORDERED})),
    l AS (SELECT *, lag(w) OVER x AS before, s - lag(s) OVER x AS dt FROM o WINDOW x AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, round(sum(CASE WHEN before >= 0 AND w >= 0 AND dt > 0 AND dt <= 20000 THEN (before + w) / 2 * dt ELSE 0 END), 2) AS energy FROM l GROUP BY user_id""",
)
def g3(spark, d):
    rows = table(spark, d, "events").withColumn("s", seconds()).withColumn("w", F.when(F.col("event_type") != "error", F.col("value")))
    return M.trapezoids(rows, "user_id", "event_id", "s", "w", 20_000).groupBy("user_id").agg(F.round(F.sum("energy"), 2).alias("energy"))


@query(
    "g5_daily_spine",
    "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS total FROM events GROUP BY 1, 2) SELECT user_id, strftime(s.day, '%Y-%m-%d') AS day, round(coalesce(total, 0), 4) AS total FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN d USING (user_id, day)",
)
def g5(spark, d):
    daily = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    return M.daily_spine(daily, "user_id", "day", "2023-12-30", "2024-02-02", "total").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("total", 4).alias("total"))


@query("g6_coverage", "SELECT strftime(ts, '%Y-%m-%d') AS day, round(least(count(DISTINCT date_trunc('hour', ts)) * 3600.0 / 86400, 1), 4) AS coverage, round(sum(value) / 3600, 6) AS wh FROM events GROUP BY 1")
def g6(spark, d):
    hours = F.count_distinct(F.date_trunc("hour", "ts"))
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.least(hours * 3600.0 / 86400, F.lit(1.0)), 4).alias("coverage"), F.round(F.sum("value") / 3600, 6).alias("wh"))


@query("g8_failures_in_window", "SELECT event_id, n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error') WHERE n >= 2")
def g8(spark, d):
    errors = table(spark, d, "events").filter("event_type = 'error'").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-6 * 3_600_000_000, 0)
    return errors.select("event_id", F.count("*").over(w).alias("n")).filter("n >= 2")


@query(
    "g9_back_off",
    """WITH o AS (SELECT *, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
    r AS (SELECT event_id, count(*) OVER (PARTITION BY user_id, g ORDER BY event_id) AS run FROM o WHERE bad)
    SELECT event_id, CASE WHEN run <= 2 THEN 0.0::DOUBLE ELSE least(5.0::DOUBLE * pow(2.0, least(run - 3, 20)), 60.0::DOUBLE) END AS wait FROM r""",
)
def g9(spark, d):
    good = (F.col("event_type") != "error").cast("int")
    w = Window.partitionBy("user_id").orderBy("event_id")
    runs = table(spark, d, "events").withColumn("g", F.sum(good).over(w)).filter("event_type = 'error'")
    run = F.count("*").over(Window.partitionBy("user_id", "g").orderBy("event_id"))
    return runs.withColumn("run", run).select("event_id", M.back_off(F.col("run"), 2, 5.0, 60.0).alias("wait"))


@query(
    "g14_next_occurrence",
    "WITH s AS (SELECT event_id, epoch(ts) AS due, CASE WHEN event_type = 'view' THEN 86400 WHEN event_type = 'click' THEN 604800 ELSE CAST(1 + user_id AS INT) * 60 END AS p, epoch(TIMESTAMP '2024-01-15 12:00:00') - epoch(ts) AS late FROM (SELECT event_id, event_type, user_id, date_trunc('second', ts) AS ts FROM events)) SELECT event_id, strftime(to_timestamp(due + CASE WHEN late < 0 THEN 0 ELSE (floor(late / p) + 1) * p END) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS next FROM s",
)
def g14(spark, d):
    """Every event as a daily, weekly or every-n-seconds schedule that was first due at its time."""
    kind = F.when(F.col("event_type") == "view", "diario").when(F.col("event_type") == "click", "semanal").otherwise("intervalo")
    at, now = F.date_trunc("second", "ts").cast("timestamp"), F.lit("2024-01-15 12:00:00").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.date_format(M.next_occurrence(kind, at, ((1 + F.col("user_id")) * 60).cast("int"), now), "yyyy-MM-dd HH:mm:ss").alias("next"))


@query("g16_leitner", "SELECT event_id, CAST(n AS INT) AS next_box, CAST([1, 3, 7, 16, 35][n + 1] AS INT) AS days FROM (SELECT event_id, CASE WHEN value > 20 THEN least(event_id % 5 + 1, 4) ELSE 0 END AS n FROM events)")
def g16(spark, d):
    box, days = M.leitner((F.col("event_id") % 5).cast("int"), F.col("value") > 20, [1, 3, 7, 16, 35])
    return table(spark, d, "events").select("event_id", box.cast("int").alias("next_box"), days.alias("days"))


@query("g19_reading_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity / 10), l_extendedprice, l_linenumber) AS place FROM lineitem")
def g19(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.floor(F.col("l_quantity") / 10), "l_extendedprice", "l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))
