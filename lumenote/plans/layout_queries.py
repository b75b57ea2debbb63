"""Queries on page layout. An order is a page, its lines are boxes: place and size from the line's values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from .base import query, table

AREA = lambda t: f"(({t}.x1 - {t}.x0) * ({t}.y1 - {t}.y0))"
INTER = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
IOU = f"({INTER})::DOUBLE / ({AREA('a')} + {AREA('b')} - ({INTER}))"
SAME = f"({INTER}) > 0 AND ({IOU} >= 0.35 OR ({INTER})::DOUBLE / least({AREA('a')}, {AREA('b')}) >= 0.8)"
BOXES_SQL = """b0 AS (SELECT l_orderkey AS page, l_linenumber AS nth, x0, y0, least(999, x0 + w) AS x1, least(999, y0 + h) AS y1, CASE l_linenumber % 4 WHEN 0 THEN 'text' WHEN 3 THEN 'caption' ELSE 'figure' END AS kind FROM (
 SELECT *, CAST(CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE l_partkey % 700 END AS INT) AS x0, CAST(CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE l_suppkey * 37 % 700 END AS INT) AS y0,
 CAST(CASE WHEN l_partkey % 50 = 0 THEN 999 ELSE 20 + l_quantity * 8 END AS INT) AS w, CAST(CASE WHEN l_partkey % 50 = 0 THEN 999 ELSE 20 + l_partkey % 300 END AS INT) AS h FROM lineitem))"""
TEXTS_SQL = f"g AS (SELECT a.page, a.nth, a.x0, a.y0, a.x1, a.y1, sum(CASE WHEN b.kind = 'text' THEN {INTER} ELSE 0 END) AS under, count(CASE WHEN b.kind = 'text' THEN 1 END) AS texts FROM b0 a JOIN b0 b USING (page) WHERE a.kind = 'figure' GROUP BY a.page, a.nth, a.x0, a.y0, a.x1, a.y1), c AS (SELECT page, nth, {AREA('g')} AS area, least(x1 - x0, y1 - y0) AS low, greatest(x1 - x0, y1 - y0) AS high, least(1.0, under::DOUBLE / {AREA('g')}) AS cover, texts FROM g)"


def boxes(spark, d):
    """page, nth, kind, box. Every 50th part is a box of the page's size."""
    blur = F.col("l_partkey") % 50 == 0
    x0 = F.when(blur, 0).otherwise(F.col("l_partkey") % 700).cast("int")
    y0 = F.when(blur, 0).otherwise(F.col("l_suppkey") * 37 % 700).cast("int")
    w = F.when(blur, 999).otherwise(20 + F.col("l_quantity") * 8).cast("int")
    h = F.when(blur, 999).otherwise(20 + F.col("l_partkey") % 300).cast("int")
    box = F.struct(x0.alias("x0"), y0.alias("y0"), F.least(F.lit(999), x0 + w).alias("x1"), F.least(F.lit(999), y0 + h).alias("y1"))
    kind = F.when(F.col("l_linenumber") % 4 == 0, "text").when(F.col("l_linenumber") % 4 == 3, "caption").otherwise("figure")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("nth"), kind.alias("kind"), box.alias("box"))


def pages(spark, d):
    """page with its figures of two passes, texts and captions, each in order of nth. A page has few boxes."""
    one = F.struct("nth", "kind", F.struct("box", F.when(F.col("kind") == "caption", F.concat(F.lit("Fig. "), F.col("nth").cast("string"))).otherwise("").alias("caption")).alias("f"))
    rows = boxes(spark, d).groupBy("page").agg(F.array_sort(F.collect_list(one)).alias("all"))
    pick = lambda keep: F.transform(F.filter("all", keep), lambda x: x["f"])
    return rows.select(
        "page", pick(lambda x: (x["kind"] == "figure") & (x["nth"] % 2 == 1)).alias("main"), pick(lambda x: (x["kind"] == "figure") & (x["nth"] % 2 == 0)).alias("more"),
        F.transform(pick(lambda x: x["kind"] == "text"), lambda f: f["box"]).alias("texts"), pick(lambda x: x["kind"] == "caption").alias("captions"),
    )


def box_pairs(spark, d):
    a = boxes(spark, d).select("page", F.col("nth").alias("a"), F.col("kind").alias("ka"), F.col("box").alias("x"))
    b = boxes(spark, d).select("page", F.col("nth").alias("b"), F.col("kind").alias("kb"), F.col("box").alias("y"))
    return a.join(b, "page")


@query("l1_box_pairs", f"WITH {BOXES_SQL} SELECT a.page AS page, a.nth AS a, b.nth AS b, round({IOU}, 6) AS iou, a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 AS inside, CAST(greatest(greatest(a.x0 - b.x1, b.x0 - a.x1, 0), greatest(a.y0 - b.y1, b.y0 - a.y1, 0)) AS INT) AS gap FROM b0 a JOIN b0 b ON a.page = b.page AND a.nth <> b.nth")
def l1(spark, d):
    x, y = F.col("x"), F.col("y")
    return box_pairs(spark, d).filter("a <> b").select("page", "a", "b", F.round(G.iou(x, y), 6).alias("iou"), G.contains(x, y).alias("inside"), G.gap(x, y).alias("gap"))


@query("l3_same_object", f"WITH {BOXES_SQL} SELECT a.page AS page, a.nth AS a, b.nth AS b FROM b0 a JOIN b0 b ON a.page = b.page AND a.nth < b.nth WHERE {SAME}")
def l3(spark, d):
    return box_pairs(spark, d).filter("a < b").filter(G.same_object(F.col("x"), F.col("y"))).select("page", "a", "b")


@query("l6_text_cover", f"WITH {BOXES_SQL}, {TEXTS_SQL} SELECT page, nth, round(cover, 6) AS cover FROM c")
def l6(spark, d):
    pairs = box_pairs(spark, d).filter("ka = 'figure'")
    under = F.sum(F.when(F.col("kb") == "text", G.intersection(F.col("x"), F.col("y"))).otherwise(0))
    return pairs.groupBy("page", F.col("a").alias("nth"), "x").agg(under.alias("under")).select("page", "nth", F.round(F.least(F.col("under") / G.area(F.col("x")), F.lit(1.0)), 6).alias("cover"))


@query("l7_figure_filter", f"WITH {BOXES_SQL}, {TEXTS_SQL} SELECT page, nth, CASE WHEN low < 35 OR area < 5000 THEN 'small' WHEN high > 8 * greatest(low, 1) THEN 'strip' WHEN cover > 0.75 THEN 'text' WHEN area >= 0.95 * 999 * 999 AND texts > 0 THEN 'full_page' END AS reason FROM c")
def l7(spark, d):
    pairs = box_pairs(spark, d).filter("ka = 'figure'")
    text = F.col("kb") == "text"
    each = pairs.groupBy("page", F.col("a").alias("nth"), "x").agg(F.sum(F.when(text, G.intersection(F.col("x"), F.col("y"))).otherwise(0)).alias("under"), F.count_if(text).alias("texts"))
    return each.select("page", "nth", G.rejected(F.col("x"), F.least(F.col("under") / G.area(F.col("x")), F.lit(1.0)), F.col("texts") > 0).alias("reason"))


@query("l8_blur_and_rescue", f"WITH {BOXES_SQL}, t AS (SELECT page, count(*) FILTER (kind = 'text') AS texts FROM b0 GROUP BY page), k AS (SELECT page, count(*) AS figures, count(*) FILTER (texts = 0 OR {AREA('b0')} < 0.95 * 999 * 999) AS kept FROM b0 JOIN t USING (page) WHERE kind = 'figure' GROUP BY page) SELECT page, figures, kept, kept = 0 AS rescue FROM k")
def l8(spark, d):
    """Page-size boxes go where the page has text; a page left without figures is asked again."""
    rows = pages(spark, d).withColumn("figures", F.concat("main", "more")).filter(F.size("figures") > 0)
    kept = F.size(G.without_blur(F.col("figures"), F.col("texts")))
    return rows.select("page", F.size("figures").cast("long").alias("figures"), kept.cast("long").alias("kept"), (kept == 0).alias("rescue"))


@query("l8_remapped", f"WITH {BOXES_SQL} SELECT page, nth, CAST(460 + floor(539 / 999.0 * x0) AS INT) AS x0, CAST(460 + floor(539 / 999.0 * x1) AS INT) AS x1, y0, y1 FROM b0")
def l8b(spark, d):
    strip = F.struct(F.lit(460).alias("x0"), F.lit(0).alias("y0"), F.lit(999).alias("x1"), F.lit(999).alias("y1"))
    return boxes(spark, d).select("page", "nth", G.remapped(F.col("box"), strip).alias("r")).select("page", "nth", "r.x0", "r.x1", "r.y0", "r.y1")


@query("l4_union")
def l4(spark, d):
    return pages(spark, d).select("page", F.posexplode(G.union(F.col("main"), F.col("more"))).alias("place", "f")).select("page", "place", "f.box.*", "f.caption")


@query("l5_absorbed")
def l5(spark, d):
    return pages(spark, d).select("page", F.posexplode(G.absorbed(F.concat("main", "more"))).alias("place", "f")).select("page", "place", "f.box.*", "f.caption")


@query("l9_page_figures")
def l9(spark, d):
    figures = G.page_figures(F.col("main"), F.col("more"), F.col("texts"), F.col("captions"))
    return pages(spark, d).select("page", F.posexplode(figures).alias("place", "f")).select("page", "place", "f.box.*", "f.caption")


@query("e13_near_captions", f"WITH {BOXES_SQL}, g AS (SELECT a.page, a.nth, b.nth AS c, CAST(greatest(greatest(a.x0 - b.x1, b.x0 - a.x1, 0), greatest(a.y0 - b.y1, b.y0 - a.y1, 0)) AS INT) AS gap FROM b0 a JOIN b0 b ON a.page = b.page WHERE a.kind = 'figure' AND b.kind = 'caption') SELECT page, nth, arg_min(c, {{'g': gap, 'c': c}}) AS caption FROM g WHERE gap <= 60 GROUP BY page, nth")
def e13(spark, d):
    near = box_pairs(spark, d).filter("ka = 'figure' AND kb = 'caption'").withColumn("gap", G.gap(F.col("x"), F.col("y"))).filter("gap <= 60")
    return near.groupBy("page", F.col("a").alias("nth")).agg(F.min_by("b", F.struct("gap", "b")).alias("caption"))


@query("l2_grounding", f"WITH {BOXES_SQL} SELECT page, nth, kind AS tag, x0, y0, x1, y1 FROM b0")
def l2(spark, d):
    """A page's boxes as a layout dump with corners swapped and values beyond the grid, parsed back."""
    line = F.format_string("%s[[%d, %d, %d, %d]]\nprosa %d", "kind", F.col("box.x1"), F.when(F.col("box.y0") == 0, -5).otherwise(F.col("box.y0")), F.col("box.x0"), F.when(F.col("box.y1") == 999, 1200).otherwise(F.col("box.y1")), "nth")
    dump = boxes(spark, d).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"]), "\n").alias("raw"))
    found = dump.select("page", F.explode(G.grounding(F.col("raw"))).alias("g"))
    return found.select("page", F.regexp_extract("g.content", r"(\d+)$", 1).cast("int").alias("nth"), "g.tag", "g.box.*")
