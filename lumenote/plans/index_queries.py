"""Queries on index maintenance, set operations and exact clones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import index as I
from .base import query, table
from .text_queries import NORM, T, sql_values, values

FILES = "f AS (SELECT doc_id AS source, n_chars AS mtime FROM documents WHERE doc_id % 7 <> 0), x AS (SELECT doc_id AS source, n_chars - (doc_id % 3) AS mtime, CAST(doc_id % 5 AS INT) AS meta_v FROM documents WHERE doc_id % 4 <> 0)"


def files_and_index(spark, d):
    docs = table(spark, d, "documents")
    files = docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("source"), F.col("n_chars").alias("mtime"))
    index = docs.filter("doc_id % 4 <> 0").select(F.col("doc_id").alias("source"), (F.col("n_chars") - F.col("doc_id") % 3).alias("mtime"), (F.col("doc_id") % 5).cast("int").alias("meta_v"))
    return files, index


@query("b2_pending", f"WITH {FILES}, g AS (SELECT source, max(mtime) AS indexed, min(meta_v) AS v FROM x GROUP BY source) SELECT * FROM (SELECT source, CASE WHEN indexed IS NULL THEN 'new' WHEN mtime > indexed THEN 'changed' WHEN v < 3 THEN 'version' END AS reason FROM f LEFT JOIN g USING (source)) WHERE reason IS NOT NULL")
def b2(spark, d):
    return I.pending(*files_and_index(spark, d), version=3)


@query("b3_orphans", f"WITH {FILES} SELECT DISTINCT source FROM x WHERE source NOT IN (SELECT source FROM f)")
def b3(spark, d):
    files, index = files_and_index(spark, d)
    return I.orphans(index, files)


ROOTS = [("/en",), ("/fr",), ("/en/685",), ("/de",)]


@query("b4_owner_root", f"WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*|[?#].*$', '', 'g') AS path FROM pages), r AS (SELECT * FROM {sql_values('root', ROOTS)}) SELECT page_id, arg_max(root, length(root)) AS root FROM p LEFT JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY page_id")
def b4(spark, d):
    """The roots are settings; the paths are the pages' addresses."""
    paths = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*|[?#].*$", "").alias("path"))
    owners = I.owner_root(paths.select("path").distinct(), values(spark, "root string", ROOTS)).hint("shuffle_hash")
    return paths.join(owners, "path", "left").select("page_id", "root")


@query("b5_deleted_sources", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2')")
def b5(spark, d):
    gone = values(spark, "source string", [("src1",), ("src2",)])
    return table(spark, d, "documents").join(gone, "source", "left_anti").select("doc_id", "source")


@query("b7_promotion", "SELECT doc_id, md5(CASE WHEN l.doc_id IS NOT NULL THEN replace(text, '!!', '') ELSE text END) AS body FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id)")
def b7(spark, d):
    used = table(spark, d, "labels").filter("quality = 1").select("doc_id").distinct().withColumn("used", F.lit(True))
    body = F.when(F.col("used"), F.replace("text", F.lit("!!"), F.lit(""))).otherwise(F.col("text"))
    return table(spark, d, "documents").join(used, "doc_id", "left").select("doc_id", F.md5(body).alias("body"))


@query("i1_union", "SELECT doc_id AS id, 'documents' AS kind FROM documents UNION ALL SELECT page_id, 'pages' FROM pages")
def i1(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("kind"))
    return docs.unionByName(table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("pages").alias("kind")))


@query("i2_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def i2(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("i3_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def i3(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").filter("toxic = 1").select("doc_id"))


@query("i4_exact_clones", f"SELECT doc_id, row_number() OVER (PARTITION BY md5({NORM}) ORDER BY doc_id) AS place FROM documents")
def i4(spark, d):
    return I.clones(table(spark, d, "documents"), T.normalised(F.col("text")), "doc_id").select("doc_id", F.col("place").cast("long").alias("place"))


@query("i5_distinct_questions", f"SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY {NORM} ORDER BY conv_id, turn) AS r FROM conversations WHERE role = 'user' AND length(text) >= 12) WHERE r = 1 ORDER BY conv_id DESC, turn DESC LIMIT 100")
def i5(spark, d):
    asked = table(spark, d, "conversations").filter("role = 'user' AND length(text) >= 12")
    w = Window.partitionBy(T.normalised(F.col("text"))).orderBy("conv_id", "turn")
    return asked.withColumn("r", F.row_number().over(w)).filter("r = 1").orderBy(F.desc("conv_id"), F.desc("turn")).limit(100).select("conv_id", "turn")


@query("e12_pages_in_range", "WITH c AS (SELECT conv_id AS chapter, conv_id * 3 AS lo, conv_id * 3 + count(*) AS hi FROM conversations GROUP BY conv_id) SELECT chapter, page_id AS fig FROM c JOIN pages ON page_id BETWEEN lo AND hi")
def e12(spark, d):
    """Pages within a chapter's range, joined on buckets of 64 pages that the range touches."""
    chapters = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("chapter"), (F.col("conv_id") * 3).alias("lo"), (F.col("conv_id") * 3 + F.col("n")).alias("hi"))
    bucket = lambda c: F.floor(F.col(c) / 64)
    spread = chapters.withColumn("bucket", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    figures = table(spark, d, "pages").select(F.col("page_id").alias("fig"), bucket("page_id").alias("bucket"))
    return spread.join(figures, "bucket").filter(F.col("fig").between(F.col("lo"), F.col("hi"))).select("chapter", "fig")


TRIGGERS = [(1, "user", "the"), (2, "user", ""), (3, "assistant", "tion"), (4, "system", "zzz")]


@query("e17_triggers", f"WITH e AS (SELECT conv_id, turn, role AS event, {NORM} AS n FROM conversations), t AS (SELECT * FROM {sql_values('id, event, cond', TRIGGERS)}) SELECT id, conv_id, turn FROM t JOIN e USING (event) WHERE cond = '' OR contains(n, cond)")
def e17(spark, d):
    """Triggers are settings, a handful of rows; what is heard is every turn."""
    heard = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("event"), T.normalised(F.col("text")).alias("context"))
    known = F.broadcast(values(spark, "id int, event string, cond string", TRIGGERS))
    return heard.join(known, "event").filter((F.col("cond") == "") | F.contains("context", "cond")).select("id", "conv_id", "turn")
