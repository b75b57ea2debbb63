"""Queries on retrieval and its evaluation. Vectors are `embeddings`, documents the corpus, benchmark texts the questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cosine
from ..operators import ranking as R
from .base import query, table
from .text_queries import KEYWORDS, STOP, TOKENS

DISTANCE = "round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12)"


def vectors(spark, d):
    return table(spark, d, "embeddings")


@query("h1_cosine_top_k", f"SELECT a.vec_id AS query_id, b.vec_id AS id, round({DISTANCE}, 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {DISTANCE}, b.vec_id) <= 10")
def h1(spark, d):
    v = vectors(spark, d)
    return R.nearest(v, v.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10).select("query_id", "id", F.round("distance", 6).alias("distance"))


@query(
    "h3_merged_collections",
    f"WITH p AS (SELECT a.vec_id AS query_id, b.label % 2 AS part, b.vec_id AS id, {DISTANCE} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0), t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, part ORDER BY dist, id) <= 20) SELECT query_id, id, round(dist, 6) AS distance FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, id) <= 20",
)
def h3(spark, d):
    v = vectors(spark, d)
    asked = v.filter("vec_id % 50 = 0")
    parts = [R.nearest(v.filter(F.col("label") % 2 == p), asked, "vec_id", "embedding", 20) for p in (0, 1)]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return parts[0].unionByName(parts[1]).withColumn("place", place).filter("place <= 20").select("query_id", "id", F.round("distance", 6).alias("distance"))


@query("h4_relative_cut", f"WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {DISTANCE} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id AND b.label <> 0) SELECT query_id, id, round(dist, 6) AS distance FROM p WHERE dist <= 1.1 * (SELECT min(dist) FROM p z WHERE z.query_id = p.query_id)")
def h4(spark, d):
    v = vectors(spark, d)
    of, asked = v.filter("label <> 0"), v.filter("vec_id % 50 = 0")
    first = cosine.compared(of, asked, "vec_id", "embedding", k=1, others=True)
    cut = first.select(F.col("query_id").alias("vec_id"), (F.col("distance") * 1.1).alias("cut"))
    # the comparison takes what is below; a row at the cut counts too
    asked = asked.join(cut, "vec_id").withColumn("above", F.col("cut") + 1e-9)
    near = cosine.compared(of, asked, "vec_id", "embedding", below="above", others=True).join(cut.withColumnRenamed("vec_id", "query_id"), "query_id")
    return near.filter("distance <= cut").select("query_id", "id", F.round("distance", 6).alias("distance"))


@query("e6_nearest_in_band", f"WITH n AS (SELECT a.vec_id, arg_min(b.vec_id, {DISTANCE}) AS near, min({DISTANCE}) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id) SELECT vec_id, near, CASE WHEN dist < 0.3 THEN 'duplicate' WHEN dist < 0.6 THEN 'related' ELSE 'far' END AS verdict FROM n")
def e6(spark, d):
    v = vectors(spark, d)
    near = R.nearest(v, v.filter("vec_id % 50 = 0"), "vec_id", "embedding", 1, others=True)
    verdict = F.when(F.col("distance") < 0.3, "duplicate").when(F.col("distance") < 0.6, "related").otherwise("far")
    return near.select(F.col("query_id").alias("vec_id"), F.col("id").alias("near"), verdict.alias("verdict"))


@query("e5_other_label_twin", f"WITH n AS (SELECT a.vec_id, min({DISTANCE}) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.label <> b.label GROUP BY a.vec_id) SELECT vec_id, round(dist, 6) AS distance FROM n WHERE dist < 0.9")
def e5(spark, d):
    v = vectors(spark, d)
    best = cosine.compared(v, v.filter("vec_id % 50 = 0"), "vec_id", "embedding", k=1, below=0.9, differ="label")
    return best.select(F.col("query_id").alias("vec_id"), F.round("distance", 6).alias("distance"))


BM25 = f"""WITH d AS (SELECT doc_id, list_filter({TOKENS}, lambda t: NOT list_contains({STOP}, t)) AS t FROM documents),
 s AS (SELECT count(*) AS n, avg(len(t)) AS m FROM d), e AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM e GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(list_filter({TOKENS}, lambda t: NOT list_contains({STOP}, t))) AS term FROM benchmark) GROUP BY ALL),
 b AS (SELECT item_id, doc_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / m))) AS score FROM tf JOIN q USING (term) JOIN df USING (term), s GROUP BY 1, 2) """


@query("h10_bm25", BM25 + "SELECT item_id, doc_id, round(score, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) <= 10")
def h10(spark, d):
    best = R.Retrieval(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id").bm25(10)
    return best.select("item_id", "doc_id", F.round("score", 6).alias("score"))


RANKED = "r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM b), "
SHARED = f"k AS (SELECT item_id, list_distinct({TOKENS}) AS ks FROM benchmark), o AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY sum(1) DESC, doc_id) AS place FROM (SELECT item_id, unnest(ks) AS term FROM k) JOIN (SELECT DISTINCT doc_id, term FROM e) USING (term) GROUP BY 1, 2) "


@query("h11_rank_fusion", BM25[:-1] + ", " + RANKED + SHARED + "SELECT item_id, doc_id, round(sum(1.0 / (60 + place - 1)), 9) AS score FROM (SELECT * FROM r WHERE place <= 20 UNION ALL SELECT * FROM o WHERE place <= 20) GROUP BY 1, 2")
def h11(spark, d):
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark")
    found = R.Retrieval(docs, asked, "doc_id", "item_id")
    fused = R.fuse([found.bm25(20), found.shared(20)], ["item_id", "doc_id"])
    return fused.select("item_id", "doc_id", F.round("score", 9).alias("score"))


@query(
    "f18_known_item",
    f"""WITH p AS (SELECT a.vec_id AS q, a.label AS ql, b.label AS l, {DISTANCE} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT q, 1 + count(*) FILTER (dist < (SELECT min(dist) FROM p z WHERE z.q = p.q AND z.l = z.ql)) AS rank FROM p GROUP BY q)
    SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr_10 FROM r""",
)
def f18(spark, d):
    v = vectors(spark, d)
    asked = v.filter("vec_id % 50 = 0")
    best = cosine.compared(v, asked, "vec_id", "embedding", k=1, agree="label", others=True)
    known = asked.join(best.select(F.col("query_id").alias("vec_id"), F.col("distance").alias("best")), "vec_id", "left")
    nearer = cosine.compared(v, known, "vec_id", "embedding", below="best", others=True, count=True)
    ranks = asked.select(F.col("vec_id").alias("query_id")).join(nearer, "query_id", "left").select((F.coalesce("n", F.lit(0)) + 1).alias("rank"))
    share = lambda k: F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"recall_{k}")
    return ranks.agg(share(1), share(5), share(10), F.round(F.avg(F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias("mrr_10"))


@query(
    "f19_best_threshold",
    """WITH s AS (SELECT n_chars AS x, quality FROM labels JOIN documents USING (doc_id)), p AS (SELECT x, sum(quality) AS pos, sum(1 - quality) AS neg FROM s GROUP BY x),
    j AS (SELECT x, round(sum(pos) OVER (ORDER BY x DESC)::DOUBLE / sum(pos) OVER () - sum(neg) OVER (ORDER BY x DESC)::DOUBLE / sum(neg) OVER (), 9) AS j FROM p) SELECT x AS threshold, j FROM j ORDER BY j DESC, x LIMIT 1""",
)
def f19(spark, d):
    scored = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return R.best_threshold(scored, "n_chars", "quality")


HYBRID = f"""WITH p AS (SELECT b.vec_id AS doc_id, {DISTANCE} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id = 0),
 d AS (SELECT doc_id, {KEYWORDS} AS ks FROM documents), n AS (SELECT count(*) AS n FROM d), f AS (SELECT k, count(*) AS df FROM (SELECT unnest(ks) AS k FROM d) GROUP BY k),
 q AS (SELECT unnest({KEYWORDS}) AS k FROM benchmark WHERE item_id = 0), r AS (SELECT k FROM q JOIN f USING (k), n WHERE ln(n / df) >= 1.5),
 g AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(ks) AS k FROM d) JOIN r USING (k))
 SELECT doc_id, round(dist, 6) AS distance, g.doc_id IS NOT NULL AS grounded FROM p JOIN d USING (doc_id) LEFT JOIN g USING (doc_id) WHERE dist < 0.9 AND (g.doc_id IS NOT NULL OR dist < 0.6) ORDER BY dist, doc_id LIMIT 40"""


@query("hybrid_topk", HYBRID.replace("g.doc_id IS NOT NULL AS grounded", "g.doc_id IS NOT NULL AS grounded"))
def hybrid(spark, d):
    """Exact cosine, then the gate: near enough, and either grounded in a rare keyword of the question or very near."""
    v, docs = vectors(spark, d), table(spark, d, "documents").select("doc_id", "text")
    # far vectors never pass the gate below
    near = cosine.compared(v, v.filter("vec_id = 0"), "vec_id", "embedding", below=0.9).select(F.col("id").alias("doc_id"), "distance")
    words = docs.select("doc_id", F.explode(T.keywords(F.col("text"))).alias("k"))
    asked = table(spark, d, "benchmark").filter("item_id = 0").select(F.explode(T.keywords(F.col("text"))).alias("k"))
    total = docs.agg(F.count("*").alias("n"))
    rare = words.join(asked, "k").groupBy("k").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).filter(F.ln(F.col("n") / F.col("df")) >= 1.5)  # one row
    grounded = words.join(rare.select("k"), "k", "left_semi").select("doc_id").distinct().withColumn("grounded", F.lit(True))
    gate = near.join(docs.select("doc_id"), "doc_id").join(grounded, "doc_id", "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))
    kept = gate.filter((F.col("distance") < 0.9) & (F.col("grounded") | (F.col("distance") < 0.6)))
    return kept.orderBy("distance", "doc_id").limit(40).select("doc_id", F.round("distance", 6).alias("distance"), "grounded")
