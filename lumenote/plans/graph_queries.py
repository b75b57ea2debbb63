"""Queries over the concept graph: orders are the atoms, their parts the concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from .base import query, table
from .text_queries import KEYWORDS

EDGES = "WITH e AS (SELECT DISTINCT l_orderkey AS atom, l_partkey AS concept FROM lineitem), i AS (SELECT concept, count(*) AS df, ln((SELECT count(DISTINCT atom) FROM e) / count(*)) AS idf FROM e GROUP BY concept) "


def edges(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("atom"), F.col("l_partkey").alias("concept"))


@query("f1_concept_idf", EDGES + "SELECT concept, df, round(idf, 6) AS idf FROM i")
def f1(spark, d):
    return G.with_idf(edges(spark, d)).select("concept", "df", F.round("idf", 6).alias("idf"))


@query("f2_word_idf", f"WITH w AS (SELECT doc_id, unnest({KEYWORDS}) AS k FROM documents) SELECT k, count(*) AS df, round(ln((SELECT count(*) FROM documents) / count(*)), 6) AS idf FROM w GROUP BY k HAVING count(*) >= 5")
def f2(spark, d):
    docs = table(spark, d, "documents")
    df = docs.select(F.explode(T.keywords(F.col("text"))).alias("k")).groupBy("k").agg(F.count("*").alias("df")).filter("df >= 5")
    n = docs.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("k", "df", F.round(F.ln(F.col("n") / F.col("df")), 6).alias("idf"))  # one row


@query("e1_shared_concepts", EDGES + "SELECT a.atom AS atom, count(DISTINCT b.atom) AS neighbours FROM e a JOIN e b ON a.concept = b.concept AND a.atom <> b.atom GROUP BY a.atom")
def e1(spark, d):
    return G.shared_neighbours(edges(spark, d))


@query("e2_neighbours", EDGES + ", s AS (SELECT DISTINCT concept FROM e WHERE atom <= 10) SELECT atom, round(sum(idf), 6) AS score FROM e JOIN s USING (concept) JOIN i USING (concept) WHERE atom > 10 AND idf >= 1.5 GROUP BY atom")
def e2(spark, d):
    e = edges(spark, d)
    return G.neighbours(e, e.filter("atom <= 10"), 1.5).select("atom", F.round("score", 6).alias("score"))


@query("f3_centrality", EDGES + ", w AS (SELECT concept, count(*) - 1 AS k FROM e GROUP BY concept) SELECT atom, round(sum(idf * k), 6) AS score FROM e JOIN w USING (concept) JOIN i USING (concept) GROUP BY atom")
def f3(spark, d):
    e = edges(spark, d)
    return G.centrality(e, e).select("atom", F.round("score", 6).alias("score"))


@query(
    "f4_connectivity",
    EDGES + ", a AS (SELECT atom, max(df) AS top, count(*) AS links FROM e JOIN i USING (concept) GROUP BY atom) SELECT count(*) AS concepts, count(*) FILTER (df = 1) AS singletons, count(*) FILTER (df BETWEEN 2 AND 30) AS connectors, (SELECT count(*) FILTER (top = 1) FROM a) AS inert, (SELECT round(avg(links), 6) FROM a) AS links_per_atom FROM i",
)
def f4(spark, d):
    return G.connectivity(edges(spark, d), 30)


@query("f5_cooccurrence", EDGES + "SELECT a.concept AS a, b.concept AS b, count(*) AS n FROM e a JOIN e b ON a.atom = b.atom AND a.concept < b.concept GROUP BY 1, 2 HAVING count(*) >= 2")
def f5(spark, d):
    return G.cooccurrence(edges(spark, d), 2)


@query(
    "j2_bridges",
    EDGES + """, c AS (SELECT a.concept AS a, b.concept AS b, count(*) AS n FROM e a JOIN e b ON a.atom = b.atom AND a.concept < b.concept GROUP BY 1, 2),
    s AS (SELECT a AS c, b AS o FROM c UNION ALL SELECT b, a FROM c), k AS (SELECT c, list(o) AS os FROM s GROUP BY c),
    p AS (SELECT a, b, n, list_filter(x.os, lambda o: o <> b) AS u, list_filter(y.os, lambda o: o <> a) AS v FROM c JOIN i p ON p.concept = a JOIN i q ON q.concept = b JOIN k x ON x.c = a JOIN k y ON y.c = b WHERE p.df >= 36 AND q.df >= 36 AND n <= 1)
    SELECT a, b, n, round(CASE WHEN len(u) + len(v) - len(list_intersect(u, v)) > 0 THEN 1 - len(list_intersect(u, v))::DOUBLE / (len(u) + len(v) - len(list_intersect(u, v))) ELSE 1 END, 6) AS surprise FROM p""",
)
def j2(spark, d):
    return G.bridges(edges(spark, d), 36, 1).select("a", "b", "n", F.round("surprise", 6).alias("surprise"))
