"""Page-layout boxes as struct columns x0, y0, x1, y1 on a grid of 0 to 999."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 999


def width(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0))


def height(b: Column) -> Column:
    return F.greatest(b["y1"] - b["y0"], F.lit(0))


def area(b: Column) -> Column:
    return width(b) * height(b)


def intersection(a: Column, b: Column) -> Column:
    dx = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    dy = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((dx > 0) & (dy > 0), dx * dy).otherwise(0)


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(0.0)


def contains(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def gap(a: Column, b: Column) -> Column:
    """Distance of two boxes along the axis on which they are further apart."""
    dx = F.greatest(a["x0"] - b["x1"], b["x0"] - a["x1"], F.lit(0))
    dy = F.greatest(a["y0"] - b["y1"], b["y0"] - a["y1"], F.lit(0))
    return F.greatest(dx, dy)


def same_object(a: Column, b: Column, least_iou: float = 0.35, least_inside: float = 0.8) -> Column:
    both = intersection(a, b)
    smaller = F.least(area(a), area(b))
    return (both > 0) & ((iou(a, b) >= least_iou) | ((smaller > 0) & (both / smaller >= least_inside)))


def rejected(b: Column, text_cover: Column, has_text: Column, side: int = 35, least: int = 5000, ratio: float = 8.0, page: float = 0.95, cover: float = 0.75) -> Column:
    """Why a box is no figure, null if it is one; the first rule that holds."""
    low, high = F.least(width(b), height(b)), F.greatest(width(b), height(b))
    return (
        F.when(area(b) <= 0, "degenerate")
        .when((low < side) | (area(b) < least), "small")
        .when(high > ratio * F.greatest(low, F.lit(1)), "strip")
        .when(text_cover > cover, "text")
        .when((area(b) >= page * GRID * GRID) & has_text, "full_page")
    )


def grounding(raw: Column) -> Column:
    """Detections tag[[x0, y0, x1, y1]] of a layout dump in order: tag, box (clamped, corners ordered), content."""
    pattern = r"\b(\w+)\[\[\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*\]\]"
    marked = F.split(F.regexp_replace(raw, f"(?={pattern})", "\u0001"), "\u0001")
    parts = F.filter(marked, lambda x: x.rlike(f"^{pattern}"))

    def value(x, i):
        return F.greatest(F.lit(0), F.least(F.lit(GRID), F.regexp_extract(x, f"^{pattern}", i).cast("int")))

    def box(x):
        return F.struct(F.least(value(x, 2), value(x, 4)).alias("x0"), F.least(value(x, 3), value(x, 5)).alias("y0"), F.greatest(value(x, 2), value(x, 4)).alias("x1"), F.greatest(value(x, 3), value(x, 5)).alias("y1"))

    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, f"^{pattern}", 1).alias("tag"), box(x).alias("box"), F.regexp_replace(F.regexp_replace(x, f"^{pattern}", ""), r"^\s+|\s+$", "").alias("content")))


def united(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def remapped(b: Column, strip: Column) -> Column:
    """A box found in a strip of the page, on the page's own grid."""
    def along(low, high, value):
        return (strip[low] + F.floor((strip[high] - strip[low]) / F.lit(float(GRID)) * value)).cast("int")

    return F.struct(along("x0", "x1", b["x0"]).alias("x0"), along("y0", "y1", b["y0"]).alias("y0"), along("x0", "x1", b["x1"]).alias("x1"), along("y0", "y1", b["y1"]).alias("y1"))


def text_cover(b: Column, texts: Column) -> Column:
    """Share of a box under the page's text boxes, 1 at most."""
    under = F.aggregate(texts, F.lit(0), lambda a, t: a + intersection(b, t))
    return F.when(area(b) > 0, F.least(under / area(b), F.lit(1.0))).otherwise(0.0)


def without_blur(figures: Column, texts: Column, page: float = 0.95) -> Column:
    """Figures (structs box, caption) but for boxes of the page's size, if the page has text."""
    return F.when(F.size(texts) == 0, figures).otherwise(F.filter(figures, lambda f: area(f["box"]) < page * GRID * GRID))


def union(main: Column, more: Column) -> Column:
    """Figures of both passes: one seen by both has the united box and the first caption; the first match counts."""

    def step(seen, f):
        hit = F.array_position(F.transform(seen, lambda s: same_object(f["box"], s["box"])), True)

        def merged(s, i):
            joined = F.struct(united(s["box"], f["box"]).alias("box"), F.when(s["caption"] != "", s["caption"]).otherwise(f["caption"]).alias("caption"))
            return F.when(i + 1 == hit, joined).otherwise(s)

        return F.when(hit == 0, F.concat(seen, F.array(f))).otherwise(F.transform(seen, merged))

    return F.aggregate(more, main, step)


def absorbed(figures: Column) -> Column:
    """Figures but for those within a larger one, which takes their caption if it has none; largest first."""
    by_size = F.transform(
        F.array_sort(F.transform(figures, lambda f, i: F.struct((-area(f["box"])).alias("size"), i.alias("place"), f.alias("f")))),
        lambda x: x["f"],
    )

    def step(kept, f):
        hit = F.array_position(F.transform(kept, lambda k: contains(k["box"], f["box"])), True)

        def captioned(k, i):
            return F.when((i + 1 == hit) & (k["caption"] == ""), F.struct(k["box"].alias("box"), f["caption"].alias("caption"))).otherwise(k)

        return F.when(hit == 0, F.concat(kept, F.array(f))).otherwise(F.transform(kept, captioned))

    return F.aggregate(by_size, F.array().cast("array<struct<box:struct<x0:int,y0:int,x1:int,y1:int>,caption:string>>"), step)


def captioned(figures: Column, captions: Column, most_gap: int = 60) -> Column:
    """A figure without caption takes the nearest one (ties: first in order of text) within the gap."""

    def own(f):
        near = F.filter(F.transform(captions, lambda c: F.struct(gap(f["box"], c["box"]).alias("gap"), c["caption"].alias("caption"))), lambda c: (c["gap"] <= most_gap) & (c["caption"] != ""))
        best = F.array_min(near)["caption"]
        return F.when((f["caption"] != "") | best.isNull(), f).otherwise(F.struct(f["box"].alias("box"), best.alias("caption")))

    return F.transform(figures, own)


def page_figures(main: Column, more: Column, texts: Column, captions: Column) -> Column:
    """The figures of a page from two passes: blur out, union, filter, nested ones absorbed, captions, reading order."""
    both = union(without_blur(main, texts), without_blur(more, texts))
    fit = F.filter(both, lambda f: rejected(f["box"], text_cover(f["box"], texts), F.size(texts) > 0).isNull())
    done = captioned(absorbed(fit), captions)
    placed = F.transform(done, lambda f: F.struct(F.floor(f["box"]["y0"] / 40).alias("band"), f["box"]["x0"].alias("x"), f["box"]["y0"].alias("y"), f.alias("f")))
    return F.transform(F.array_sort(placed), lambda p: p["f"])
