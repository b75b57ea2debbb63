"""Captions of figures: found in a page's text, dealt to its figures, and swapped in a figure's note."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# How a caption line and a mention in running text look; the longest caption and title.
LINE = r"(?imu)^\s*(?:figuras?|fig\.?)\s*([\dA-Z]+(?:[.\-]\d+)?)\s*[—\-–:.]\s*(.{4,300})"
MENTION = r"(?iu)([^.\n]{15,200}?\(?\s*(?:figuras?|fig\.?)\s*([\dA-Z]+(?:[.\-]\d+)?)\s*\)?)"
MOST, MOST_TITLE = 300, 120
# What a mention may take of the text behind `fig` and, in characters, before it, other than blanks.
FIG, BEHIND, BEFORE = r"(?iu)fig", r"(?iu)^[\dA-Z]*+\.?+\s*+[\dA-Z]*+[.\-]?+\d*+\s*+\)?+", 202
KEPT = "legenda_original: "


def _flat(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", ""), 1, MOST)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _about_figures(text: Column) -> Column:
    """The text without what is too far from any `fig` to be part of a mention; a sign that ends sentences stands for it.

    The search for mentions tries many lengths from every place, so it is kept to these few places.
    """

    def near(p: Column) -> Column:
        def cut(piece: Column, i: Column) -> Column:
            head = F.when(i == 0, 0).otherwise(F.length(F.regexp_extract(piece, BEHIND, 0)))
            blanks = F.length(piece) - F.length(F.rtrim(piece, F.lit(" \t\n\x0b\f\r")))
            tail = F.when(i == F.size(p["pieces"]) - 1, 0).otherwise(blanks + BEFORE)
            short = F.concat(F.substring(piece, F.lit(1), head), F.lit(";."), F.substring(piece, F.length(piece) - tail + 1, tail))
            return F.concat(F.when(F.length(piece) > head + tail, short).otherwise(piece), F.coalesce(F.get(p["figs"], i), F.lit("")))

        return F.array_join(F.transform(p["pieces"], cut), "")

    return let(F.struct(F.split(text, FIG).alias("pieces"), F.regexp_extract_all(text, F.lit(FIG), F.lit(0)).alias("figs")), near)


def page_captions(text: Column) -> Column:
    """Structs number, caption of a page, in the order found. Caption lines win (of one number the last, at the place of
    the first); numbers without one take the first sentence that mentions the figure. Null: none."""

    def found(text: Column, pattern: str, number: int, words: int) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(whole, lambda w: F.struct(F.regexp_extract(w, pattern, number).alias("n"), F.regexp_extract(w, pattern, words).alias("c")))

    def once(pairs: Column, last: bool) -> Column:
        def pick(xs: Column) -> Column:
            order = F.reverse(xs) if last else xs
            return F.transform(F.array_distinct(F.transform(xs, lambda x: x["n"])), lambda n: F.struct(n.alias("number"), _flat(F.get(F.filter(order, lambda x: x["n"] == n), F.lit(0))["c"]).alias("caption")))

        return let(pairs, pick)

    page = F.coalesce(text, F.lit(""))
    both = let(page, lambda t: F.struct(once(found(t, LINE, 1, 2), True).alias("lines"), once(found(_about_figures(t), MENTION, 2, 1), False).alias("mentions")))
    return let(both, lambda b: F.concat(b["lines"], F.filter(b["mentions"], lambda m: ~F.exists(b["lines"], lambda x: x["number"] == m["number"]))))


def caption_of(captions: Column, index: Column, figures: Column) -> Column:
    """The caption of the figure at an index (from 0) of a page: by order if there are as many as figures, else all of them."""
    return F.when(F.size(captions) == 0, F.lit("")).when(F.size(captions) == figures, F.get(captions, index)).otherwise(F.substring(F.array_join(captions, " | "), 1, MOST))


def _parts(note: Column) -> Column:
    """lines, at (of the title line, from 1; 0 if none), title, body_at (0 if there is no body line), body."""
    lines = F.split(note, "\n")

    def titled(xs: Column) -> Column:
        at = F.array_position(F.transform(xs, lambda x: x.startswith("## ")), F.lit(True))
        return F.struct(xs.alias("lines"), at.alias("at"), F.when(at > 0, _stripped(F.substring(F.get(xs, at - 1), F.lit(4), F.length(note)))).alias("title"))

    def bodied(t: Column) -> Column:
        after = F.transform(F.slice(t["lines"], t["at"] + 1, F.size(t["lines"])), _stripped)
        k = F.array_position(F.transform(after, lambda x: x != ""), F.lit(True))
        line = F.when(k > 0, F.get(after, k - 1))
        is_body = line.startswith(t["title"]) & ~line.rlike(r"^(!\[\[|\*\*Malha|#)")
        here = F.when(F.coalesce(is_body, F.lit(False)), t["at"] + k).otherwise(0)
        return F.struct(t["lines"].alias("lines"), t["at"].alias("at"), t["title"].alias("title"), here.alias("body_at"), F.when(here > 0, line).otherwise(t["title"]).alias("whole"))

    return let(let(lines, titled), bodied)


def note_caption(note: Column) -> Column:
    """The whole caption of a figure's note: the line below the title if it goes on from the title, else the title. Empty without one."""
    return F.when(note.isNotNull(), F.coalesce(_parts(note)["whole"], F.lit("")))


def swapped(note: Column, new: Column) -> Column:
    """The note with another caption in title (cut) and body, and the former one kept in the header; all else untouched.

    Null where nothing is to be done: swapped before, no title, no header, no new caption, or the same.
    """
    new = _stripped(F.coalesce(new, F.lit("")))

    def rewrite(p: Column) -> Column:
        place = lambda x, i: F.when(i + 1 == p["at"], F.concat(F.lit("## "), F.substring(new, 1, MOST_TITLE))).when(i + 1 == p["body_at"], new).otherwise(x)
        text = F.array_join(F.transform(p["lines"], place), "\n")
        header = r"(?s)^(---\r?\n.*?)(\r?\n---\r?\n)"

        def kept(t: Column) -> Column:
            head, end = F.regexp_extract(t, header, 1), F.regexp_extract(t, header, 2)
            rest = F.substring(t, F.length(head) + F.length(end) + 1, F.length(t))
            return F.when(end != "", F.concat(head, F.lit("\n" + KEPT), F.replace(p["whole"], F.lit('"'), F.lit("'")), end, rest))

        todo = (p["title"] != "") & (new != "") & (p["whole"] != new)
        return F.when(todo, let(text, kept))

    return F.when(~F.contains(note, F.lit(KEPT.strip())), let(_parts(note), rewrite))
