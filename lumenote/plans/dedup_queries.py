"""Queries on clustering and deduplication of vectors, and on distances in the concept graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators import near
from .base import query, table
from .graph_queries import EDGES, edges
from .ranking_queries import DISTANCE

#: A distance that a few tens of pairs are below at sf0.01.
NEAR = 0.6
PAIRS = f"p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {DISTANCE} < {NEAR})"


def rows(spark, d):
    return near.usable(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("j5_kept")
def j5(spark, d):
    return D.kept(rows(spark, d), NEAR).select(F.col("id").alias("vec_id"), "kept")


@query("j4_twin_clusters", f"WITH RECURSIVE {PAIRS}, e AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), r(node, seen) AS (SELECT x, x FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen) SELECT node, min(seen) AS label FROM r GROUP BY node")
def j4(spark, d):
    return D.clusters(near.links(rows(spark, d), NEAR))


@query("j3_leader_clusters")
def j3(spark, d):
    return D.leaders(rows(spark, d), NEAR).select(F.col("id").alias("node"), "leader")


@query(
    "j6_write_decision",
    f"WITH n AS (SELECT a.vec_id, arg_min(b.vec_id, {DISTANCE}) AS near, min({DISTANCE}) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id <> a.vec_id GROUP BY a.vec_id) SELECT vec_id, CASE WHEN dist < 0.7 AND near < vec_id THEN 'replace' WHEN dist < 0.6 THEN 'drop' ELSE 'keep' END AS decision FROM n",
)
def j6(spark, d):
    v = rows(spark, d)
    nearest = near.nearest_within(v, v, 0.7).withColumn("newer", F.col("near") < F.col("id"))
    every = v.select("id").join(nearest, "id", "left").select("id", F.coalesce("distance", F.lit(2.0)).alias("distance"), F.coalesce("newer", F.lit(False)).alias("newer"))
    return D.write_decision(every, 0.6, 0.7).select(F.col("id").alias("vec_id"), "decision")


@query(
    "j8_hop_counts",
    EDGES + ", s AS (SELECT DISTINCT atom FROM e WHERE atom <= 2), c1 AS (SELECT DISTINCT concept FROM e JOIN s USING (atom)), h1 AS (SELECT DISTINCT atom FROM e JOIN c1 USING (concept) WHERE atom NOT IN (SELECT atom FROM s)), c2 AS (SELECT DISTINCT concept FROM e JOIN h1 USING (atom)), h2 AS (SELECT DISTINCT atom FROM e JOIN c2 USING (concept) WHERE atom NOT IN (SELECT atom FROM s) AND atom NOT IN (SELECT atom FROM h1)) SELECT 0 AS hops, count(*) AS n FROM s UNION ALL SELECT 1, count(*) FROM h1 UNION ALL SELECT 2, count(*) FROM h2",
)
def j8(spark, d):
    e = edges(spark, d)
    return D.hop_distances(e, e.filter("atom <= 2"), 2).groupBy("hops").agg(F.count("*").alias("n"))
