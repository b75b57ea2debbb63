"""JSON objects inside running text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An escape, a sign that counts, or a run of others: together every character once.
PIECES = r"(?s)\\.|[\"{}]|[^\"{}\\]+|\\"


def json_objects(text: Column) -> Column:
    """Every outermost `{...}` of the text with balanced braces, in order.

    Braces inside an object's strings don't count, and a backslash in a string takes the next character along. Outside of
    objects only `{` means anything. What is never closed is no object, nor is what follows it.
    """
    out = F.array().cast("array<struct<at:int,n:int>>")
    start = F.struct(F.lit(1).alias("pos"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), out.alias("out"))

    def step(a, piece):
        n = F.length(piece)
        escape = piece.startswith("\\")
        # outside of a string a backslash is a character like others, so the one behind it counts
        sign = F.when(escape & ~a["quoted"], F.substring(piece, 2, 1)).otherwise(piece)
        inside = a["depth"] > 0
        quote = inside & (sign == '"') & ~(escape & a["quoted"])
        opens, closes = (sign == "{") & ~a["quoted"], inside & (sign == "}") & ~a["quoted"]
        depth = a["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        begin = F.when(opens & ~inside, a["pos"] + n - 1).otherwise(a["at"])
        ends = closes & (depth == 0)
        found = F.when(ends, F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), (a["pos"] + n - a["at"]).alias("n"))))).otherwise(a["out"])
        return F.struct((a["pos"] + n).alias("pos"), depth.alias("depth"), F.when(quote, ~a["quoted"]).otherwise(a["quoted"]).alias("quoted"), begin.alias("at"), found.alias("out"))

    places = F.aggregate(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), start, step, lambda a: a["out"])
    return F.transform(places, lambda p: F.substring(text, p["at"], p["n"]))


def tool_call(text: Column) -> Column:
    """tool and args (JSON text) of the first valid object whose `tool` is a string that isn't empty; else null.

    Arguments that are no object count as none. An object with one name twice is not valid.
    """
    kind = F.schema_of_variant
    parsed = F.transform(json_objects(text), lambda c: F.try_parse_json(c))
    named = F.filter(parsed, lambda v: (kind(F.try_variant_get(v, "$.tool", "variant")) == "STRING") & (F.try_variant_get(v, "$.tool", "string") != ""))
    first = F.get(named, F.lit(0))
    args = F.try_variant_get(first, "$.args", "variant")
    whole = F.when(kind(args).startswith("OBJECT"), F.to_json(args)).otherwise("{}")
    return F.when(F.size(named) > 0, F.struct(F.try_variant_get(first, "$.tool", "string").alias("tool"), whole.alias("args")))
