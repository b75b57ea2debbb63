"""Queries on folds, personal data and page layout. Where SQL has no such fold the tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import folds, pii
from ..functions.text import tokens
from ..operators import ordered
from ..operators.tables import stored
from . import ranking_queries
from .base import query, table
from .text_queries import TOKENS


@query("c17_batches")
def c17(spark, d):
    b = folds.batches(F.col("text"), 400, "\n")
    return table(spark, d, "documents").select("doc_id", F.posexplode(b).alias("nth", "batch"))


@query("d12_masked")
def d12(spark, d):
    text, kinds = pii.masked(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.alias("text"), F.array_join(kinds, ",").alias("kinds"))


def candidates(spark, d, **columns):
    """item_id, items (id and columns of the whole documents, best first): what h11 finds for an item, at most 40."""
    # stored, so that its size is known and the documents are not shuffled to meet it
    found = stored(ranking_queries.h11(spark, d).select("item_id", F.col("doc_id").alias("id"), (-F.col("score")).alias("order")), "found")
    docs = table(spark, d, "documents").join(found.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    docs = docs.select(F.col("doc_id").alias("id"), *(c.alias(k) for k, c in columns.items()))
    lists = found.join(docs, "id").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("order", "id", *columns))).alias("items"))
    return lists.select("item_id", F.transform("items", lambda x: F.struct(*(x[k].alias(k) for k in ("id", *columns)))).alias("items"))


@query("h6_near_duplicates")
def h6(spark, d):
    lists = candidates(spark, d, tokens=F.array_distinct(tokens(F.col("text"))))
    return lists.select("item_id", F.explode(folds.near_duplicate_drop(F.col("items"), 0.9)).alias("doc_id"))


@query("h8_budgeted")
def h8(spark, d):
    lists = candidates(spark, d, size=F.length("text"), figure=F.col("doc_id") % 3 == 0)
    return lists.select("item_id", F.explode(folds.budgeted(F.col("items"), 12_000, 0.4)).alias("doc_id"))


def timed(spark, d):
    return table(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query("g4_integral_means")
def g4(spark, d):
    # a user's history stands for one device's readings
    readings = timed(spark, d).withColumn("mj", F.col("value") * 1000)
    return ordered.integral_means(readings, "user_id", "event_id", "s", "mj", 3600.0, 1e9)


@query("g7_throttled")
def g7(spark, d):
    return ordered.throttled(timed(spark, d), "user_id", "s", 86_400.0)


@query(
    "k4_breaker",
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, event_type <> 'error' AS ok FROM events), r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY s, event_id) AS run FROM e),
    n AS (SELECT *, CASE WHEN ok THEN 0 ELSE sum((NOT ok)::INT) OVER (PARTITION BY user_id, run ORDER BY s, event_id) END AS failures FROM r)
    SELECT event_id, coalesce(lag(failures) OVER w >= 2 AND s < lag(s) OVER w + 43200, false) AS open FROM n WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)""",
)
def k4(spark, d):
    outcomes = timed(spark, d).withColumn("ok", F.col("event_type") != "error")
    return ordered.breaker_opens(outcomes, "user_id", "s", "event_id", "ok", 2, 43_200.0).select("event_id", "open")


@query(
    "g17_leitner_history",
    "WITH w AS (SELECT user_id, max(CASE WHEN value <= 20 THEN {'ts': ts, 'id': event_id} END) AS wrong FROM events GROUP BY 1) SELECT user_id, CAST(least(4, count(e.event_id)) AS INT) AS box FROM w LEFT JOIN events e USING (user_id) WHERE wrong IS NULL OR {'ts': ts, 'id': event_id} > wrong GROUP BY 1 UNION ALL SELECT user_id, 0 FROM w WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = w.user_id AND (wrong IS NULL OR {'ts': ts, 'id': event_id} > wrong))",
)
def g17(spark, d):
    answers = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") > 20).alias("ok"))
    return ordered.leitner_boxes(answers, "user_id", ["ts", "event_id"], "ok", [1, 3, 7, 16, 35])


@query("f16_themes", f"WITH t AS (SELECT item_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM (SELECT item_id, list_filter({TOKENS}, lambda x: length(x) >= 4) AS ts FROM benchmark)), g AS (SELECT item_id, term, count(*) AS n, min(pos) AS first FROM t GROUP BY 1, 2) SELECT item_id, term, n FROM g QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, first) <= 3")
def f16(spark, d):
    from pyspark.sql import Window

    words = F.filter(tokens(F.col("text")), lambda t: F.length(t) >= 4)
    each = table(spark, d, "benchmark").select("item_id", F.posexplode(words).alias("pos", "term")).groupBy("item_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy("item_id").orderBy(F.desc("n"), "first")
    return each.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("item_id", "term", "n")
