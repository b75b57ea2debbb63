"""Queries on language, routes, facts, works, calendars and page images."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import text as T
from ..operators.index import siblings
from .base import query, table
from .text_queries import KEYWORDS, NORM

WORDS = "regexp_extract_all(lower(text), '[a-zà-ÿ]+')"
COUNT = lambda words: f"len(list_filter({WORDS}, lambda w: list_contains([{', '.join(repr(w) for w in words)}], w)))"
ANY = lambda phrases: f"len(list_filter([{', '.join(repr(p) for p in phrases)}], lambda p: contains({NORM}, p))) > 0"


@query("d21_english_body", f"SELECT doc_id, CAST({COUNT(L.ENGLISH)} AS BIGINT) AS en, CAST({COUNT(L.PORTUGUESE)} AS BIGINT) AS pt, {COUNT(L.ENGLISH)} > {COUNT(L.PORTUGUESE)} AS english FROM documents")
def d21(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", L.function_words(t, L.ENGLISH).cast("long").alias("en"), L.function_words(t, L.PORTUGUESE).cast("long").alias("pt"), L.english_body(t).alias("english"))


@query("d10_searchable_gap", f"SELECT item_id, len({KEYWORDS}) >= 2 AND len(list_filter({KEYWORDS}, lambda k: NOT regexp_matches(k, '^[0-9]+$'))) >= 1 AS searchable FROM benchmark")
def d10(spark, d):
    keys = T.keywords(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", ((F.size(keys) >= 2) & (F.size(F.filter(keys, lambda k: ~k.rlike("^[0-9]+$"))) >= 1)).alias("searchable"))


PRECEDENCE = lambda c: f"CASE WHEN {c} = 'src1' THEN 2 WHEN {c} = 'src2' THEN 1 ELSE 0 END"


@query("d29_replaces", f"SELECT a.doc_id, b.source IN ('src4', 'src5') AND {PRECEDENCE('a.source')} > {PRECEDENCE('b.source')} AS replaces FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def d29(spark, d):
    """Whether a note of its work takes the place of the next one's; `src1` and `src2` are preferred, `src4` and `src5` superseded."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("Livro '"), "source", F.lit("' — cap")).alias("new"))
    old = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("new").alias("old"))
    return docs.join(old, "doc_id").select("doc_id", L.replaces(F.col("new"), F.col("old"), ["'src1'", "'src2'"], ["'src4'", "'src5'"]).alias("replaces"))


@query("d30_facets_filter", "SELECT doc_id FROM documents WHERE source = 'src3' AND lang = 'en' AND n_chars >= 500")
def d30(spark, d):
    return table(spark, d, "documents").filter("source = 'src3' AND lang = 'en' AND n_chars >= 500").select("doc_id")


@query("a16_scanned_books", "SELECT source, median(n_chars) < 800 AS scanned FROM documents GROUP BY source")
def a16(spark, d):
    return table(spark, d, "documents").groupBy("source").agg((F.percentile("n_chars", 0.5) < 800).alias("scanned"))


@query("a12_page_outline", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS items, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs FROM pages")
def a12(spark, d):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"), count("<li>").alias("items"), count("<a href=").alias("links"), count("<p>").alias("paragraphs"))


@query("e3_siblings", "SELECT a.doc_id AS seed, b.doc_id AS sibling FROM documents a JOIN documents b ON a.source = b.source AND a.lang = b.lang AND a.text <> b.text WHERE a.doc_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id) <= 12")
def e3(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.md5("text").alias("text"))
    return siblings(docs, docs.filter("doc_id % 50 = 0"), "doc_id", ["source", "lang"], "text", 12).select(F.col("seed").alias("seed"), F.col("doc_id").alias("sibling"))


@query("e15_conversation_match", f"WITH q AS (SELECT item_id, unnest({KEYWORDS}) AS k FROM benchmark), c AS (SELECT DISTINCT conv_id, unnest({KEYWORDS}) AS k FROM conversations), s AS (SELECT item_id, conv_id, count(*) AS shared FROM q JOIN c USING (k) GROUP BY 1, 2) SELECT item_id, conv_id, shared FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, conv_id DESC) = 1")
def e15(spark, d):
    """For each question the conversation that shares most keywords, the latest on a tie."""
    asked = table(spark, d, "benchmark").select("item_id", F.explode(T.keywords(F.col("text"))).alias("k"))
    words = table(spark, d, "conversations").select("conv_id", F.explode(T.keywords(F.col("text"))).alias("k")).distinct()
    shared = words.join(asked, "k").groupBy("item_id", "conv_id").agg(F.count("*").alias("shared"))
    best = F.max(F.struct("shared", "conv_id")).alias("m")
    return shared.groupBy("item_id").agg(best).select("item_id", "m.conv_id", "m.shared")


@query("g11_token_budget", "SELECT event_id, CAST(CASE WHEN f IS NULL OR f <= 0.5 THEN 4000 WHEN f >= 0.9 THEN 1000 ELSE round_even(4000 - (f - 0.5) / 0.4 * 3000, 0) END AS BIGINT) AS budget FROM (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN value / 100 END AS f FROM events)")
def g11(spark, d):
    f = F.when(F.col("event_id") % 11 > 0, F.col("value") / 100)
    budget = F.when(f.isNull() | (f <= 0.5), 4000).when(f >= 0.9, 1000).otherwise(F.bround(4000 - (f - 0.5) / 0.4 * 3000))
    return table(spark, d, "events").select("event_id", budget.cast("long").alias("budget"))


@query("h14_recent_documents", "SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 100")
def h14(spark, d):
    return table(spark, d, "documents").filter("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").limit(100).select("doc_id")


@query("k2_loud_runs", "WITH o AS (SELECT *, sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events), r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) AS n FROM o WHERE value > 50) SELECT user_id, event_id FROM r WHERE n = 3")
def k2(spark, d):
    quiet = (~(F.col("value") > 50)).cast("int")
    runs = table(spark, d, "events").withColumn("g", F.sum(quiet).over(Window.partitionBy("user_id").orderBy("event_id"))).filter("value > 50")
    n = F.row_number().over(Window.partitionBy("user_id", "g").orderBy("event_id"))
    return runs.withColumn("n", n).filter("n = 3").select("user_id", "event_id")
