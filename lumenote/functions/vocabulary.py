"""Terms of a glossary in a text, words of the other vocabulary added to a query, pictures shown in an answer."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, without_accents

EMBED = r"!\[\[([^\[\]]+?)\]\]"


def _whole(text: Column, words: str) -> Column:
    return text.rlike(rf"(?U)\b{re.escape(words)}\b")


def glossary_terms(text: Column, terms: list[str]) -> Column:
    """The terms that occur as whole words, whatever their case, in the glossary's order. Null: none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return let(low, lambda t: F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(_whole(t, x), F.lit(x)) for x in terms))))


def bridged(query: Column, bridge: dict[str, list[str]]) -> Column:
    """The query with the equivalents of the words it has (of text without accents) behind it: each once, and none that
    it has already. Null and empty queries stay."""

    def more(t: Column) -> Column:
        found = (F.when(_whole(t, word) & ~_whole(t, other), F.lit(other)) for word, others in bridge.items() for other in others)
        return F.array_distinct(F.array_compact(F.array(F.lit(None).cast("string"), *found)))

    new = let(F.lower(without_accents(query)), more)
    return F.when((query == "") | (F.size(new) == 0), query).otherwise(F.concat_ws(" ", query, F.array_join(new, " ")))


def shown_images(text: Column) -> Column:
    """Structs file (without folder and ending), char (where its embed begins, from 0) of the embedded pictures, in order."""
    whole, names = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMBED), F.lit(g)) for g in (0, 1))
    before = F.split(F.coalesce(text, F.lit("")), EMBED)
    parts = F.arrays_zip(names.alias("n"), F.transform(whole, F.length).alias("w"), F.slice(F.transform(before, F.length), F.lit(1), F.size(names)).alias("b"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<file:string,char:int>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        name = F.regexp_extract(F.regexp_replace(p["n"], "/+$", ""), "([^/]*)$", 1)
        stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")
        here = a["at"] + p["b"]
        return F.struct((here + p["w"]).alias("at"), F.concat(a["out"], F.array(F.struct(stem.alias("file"), here.alias("char")))).alias("out"))

    return F.aggregate(parts, start, step, lambda a: a["out"])
