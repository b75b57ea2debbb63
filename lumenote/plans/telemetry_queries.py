"""Queries over the events and conversations tables: latencies, counts, lists. The wall clock is always a literal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import telemetry as M
from ..operators.classify import within_caps
from .base import query, table

CAP = 150.0
STAMP = "yyyy-MM-dd HH:mm:ss"
SQL_STAMP = "'%Y-%m-%d %H:%M:%S'"


def events(spark, d):
    return table(spark, d, "events")


@query("d38_outliers", f"SELECT event_type, count(*) FILTER (NOT coalesce(value <= {CAP}, true)) AS outliers, count(*) AS n FROM events GROUP BY event_type")
def d38(spark, d):
    sane = within_caps(F.col("value"), F.lit(None).cast("double"), CAP)
    return events(spark, d).groupBy("event_type").agg(F.count_if(~sane).alias("outliers"), F.count("*").alias("n"))


@query("f7_latency_averages", f"SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events WHERE coalesce(value <= {CAP}, true) GROUP BY event_type")
def f7(spark, d):
    sane = events(spark, d).filter(within_caps(F.col("value"), F.lit(None).cast("double"), CAP))
    return sane.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


@query(
    "f8_latency_percentiles",
    f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events WHERE coalesce(value <= {CAP}, true)),
    s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM l WHERE r <= 200 AND value IS NOT NULL)
    SELECT event_type, share, value FROM s, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) q(share) WHERE i = round_even(share * (n - 1), 0)""",
)
def f8(spark, d):
    sane = events(spark, d).filter(within_caps(F.col("value"), F.lit(None).cast("double"), CAP))
    return M.nearest_rank(M.last_rows(sane, "event_type", "event_id", 200), "event_type", "value", [0.5, 0.95])


@query("f9_week_counts", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'error') AND ts >= TIMESTAMP '2024-01-23 00:00:00' AND ts < TIMESTAMP '2024-01-30 00:00:00' GROUP BY event_type")
def f9(spark, d):
    week = (F.col("ts") >= F.lit("2024-01-23 00:00:00").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
    return events(spark, d).filter(F.col("event_type").isin("click", "view", "error") & week).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "f10_conversations",
    "SELECT conv_id, count(*) FILTER (role = 'user') AS n_questions, max(turn) AS last_turn, coalesce(left(arg_min(text, turn) FILTER (role = 'user'), 60), 'Conversa') AS title FROM conversations GROUP BY conv_id",
)
def f10(spark, d):
    question = F.when(F.col("role") == "user", F.col("turn"))
    title = F.min_by(F.when(F.col("role") == "user", F.col("text")), question)
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_questions"), F.max("turn").alias("last_turn"), F.coalesce(F.substring(title, 1, 60), F.lit("Conversa")).alias("title"))


@query("f11_monthly", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def f11(spark, d):
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    return table(spark, d, "orders").groupBy(month).agg(F.count_distinct(F.to_date("o_orderdate")).alias("days"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("f12_daily_sums", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1, 2")
def f12(spark, d):
    return events(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


@query("f13_counting_upserts", f"SELECT user_id, event_type, count(*) AS n, arg_min(props, event_id) AS first_text, strftime(max(ts), {SQL_STAMP}) AS last_seen FROM events GROUP BY user_id, event_type")
def f13(spark, d):
    out = M.counting_upsert(events(spark, d), ["user_id", "event_type"], "props", "event_id", F.col("ts"))
    return out.withColumn("last_seen", F.date_format("last_seen", STAMP))


@query("f14_first_wins", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1, 2")
def f14(spark, d):
    pair = table(spark, d, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), "l_orderkey")
    return pair.groupBy("a", "b").agg(F.min("l_orderkey").alias("first_order"))


@query("f15_facets", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def f15(spark, d):
    return table(spark, d, "documents").groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"))


@query("f20_distribution", "SELECT lang, round(quantile_cont(n_chars, 0.25), 4) AS p25, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.75), 4) AS p75, round(quantile_cont(n_chars, 0.9), 4) AS p90 FROM documents GROUP BY lang")
def f20(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(*(F.round(F.percentile("n_chars", q), 4).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75, 0.9)))


@query("f21_group_medians", "SELECT source, round(median(n_chars), 4) AS median_chars, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END), 6) AS share_en, count(*) AS n FROM documents GROUP BY source")
def f21(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.round(F.median("n_chars"), 4).alias("median_chars"), F.round(F.avg((F.col("lang") == "en").cast("double")), 6).alias("share_en"), F.count("*").alias("n"))


@query(
    "f23_power_profile",
    "WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL) SELECT user_id, share, value FROM s, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE), (1.0::DOUBLE)) q(share) WHERE i = round_even(share * (n - 1), 0)",
)
def f23(spark, d):
    return M.nearest_rank(events(spark, d), "user_id", "value", [0.0, 0.5, 0.95, 1.0])


@query("f24_requests_by_user", f"SELECT user_id, count(*) AS n, strftime(max(ts), {SQL_STAMP}) AS last FROM events GROUP BY user_id")
def f24(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), STAMP).alias("last"))


@query("f26_label_counts", "SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64) AS whole FROM embeddings GROUP BY label")
def f26(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") == 64).alias("whole"))


@query(
    "f27_turn_rates",
    "SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n, round(CASE WHEN count(*) > 1 AND max(epoch_us(ts)) > min(epoch_us(ts)) THEN (count(*) - 1) * 1e6 / (max(epoch_us(ts)) - min(epoch_us(ts))) END, 9) AS rate FROM events GROUP BY 1, 2",
)
def f27(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span = F.max(us) - F.min(us)
    n = F.count("*")
    return events(spark, d).groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(n.alias("n"), F.round(F.when((n > 1) & (span > 0), (n - 1) * 1e6 / span), 9).alias("rate"))


@query("g18_last_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def g18(spark, d):
    return M.last_rows(table(spark, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query("h15_topic_queue", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, max(ts) AS seen FROM events GROUP BY 1, 2) WHERE n >= 5 AND seen < TIMESTAMP '2024-01-29 00:00:00'")
def h15(spark, d):
    g = events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("seen"))
    return g.filter((F.col("n") >= 5) & (F.col("seen") < F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))).select("user_id", "event_type", "n")


@query("h16_due", "SELECT event_id, user_id FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-05 12:00:00' ORDER BY ts, event_id LIMIT 50")
def h16(spark, d):
    due = (F.col("event_type") == "signup") & (F.col("ts") <= F.lit("2024-01-05 12:00:00").cast("timestamp_ntz"))
    return events(spark, d).filter(due).orderBy("ts", "event_id").limit(50).select("event_id", "user_id")


@query("h17_history", "SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 100")
def h17(spark, d):
    return events(spark, d).orderBy(F.desc("event_id")).limit(100).select("event_id", "event_type", "value")


@query("h20_first_useful", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type <> 'error' AND value > 10) WHERE r <= 3")
def h20(spark, d):
    useful = events(spark, d).filter((F.col("event_type") != "error") & (F.col("value") > 10))
    return useful.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("r <= 3").select("user_id", "event_id")


@query("a8_request_log", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) ORDER BY event_id DESC LIMIT 500")
def a8(spark, d):
    parsed = events(spark, d).select("event_id", F.from_json("props", "k long").alias("p")).filter("p IS NOT NULL")
    return parsed.orderBy(F.desc("event_id")).limit(500).select("event_id", "p.k")


@query("e16_next_thread", "SELECT conv_id, n FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) WHERE n >= 3 AND conv_id <> 0 ORDER BY conv_id DESC LIMIT 1")
def e16(spark, d):
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.filter("n >= 3 AND conv_id <> 0").orderBy(F.desc("conv_id")).limit(1)


@query("b10_snapshot", "SELECT source, count(*) AS n, count(*) FILTER (contains(text, '!!')) AS marked FROM documents GROUP BY source")
def b10(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.contains("text", F.lit("!!"))).alias("marked"))
