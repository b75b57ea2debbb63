"""Order-dependent text and list operators as native folds over arrays: no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import jaccard, let, normalised


def distinct_by_key(items: Column, key) -> Column:
    """The first item of each key, in order; items with an empty key are left out. Keys are computed once and sorted."""
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = let(keyed, lambda s: F.filter(s, lambda e, i: (e["k"] != "") & ((i == 0) | (F.get(s, i - 1)["k"] != e["k"]))))
    return F.transform(F.array_sort(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def wikilinks(text: Column) -> Column:
    """Targets of [[target|alias]] links, blanks collapsed, one per normalised target: the first spelling stays."""
    targets = F.regexp_extract_all(text, F.lit(r"(?<!!)\[\[([^\]|\n]+)(?:\|[^\]\n]*)?\]\]"), F.lit(1))
    clean = F.transform(targets, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return distinct_by_key(clean, normalised)


def batches(text: Column, budget: int, separator: str = "\n\n") -> Column:
    """Greedy batches of separated blocks of at most `budget` characters; a longer block is cut hard, nothing is lost.

    Batches of white space only are left out, as in the reference semantics.
    """
    blocks = F.split(text, separator)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def closed(a):
        return F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))

    def step(a, x):
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / budget).cast("int")), lambda i: F.substring(x, i * budget + 1, F.lit(budget)))
        joined = F.concat(a["open"], F.lit(separator), x)
        return (
            F.when(F.length(x) > budget, F.struct(F.concat(closed(a), pieces).alias("done"), F.lit(None).cast("string").alias("open")))
            .when(a["open"].isNull(), F.struct(a["done"].alias("done"), x.alias("open")))
            .when(F.length(joined) > budget, F.struct(closed(a).alias("done"), x.alias("open")))
            .otherwise(F.struct(a["done"].alias("done"), joined.alias("open")))
        )

    return F.filter(F.aggregate(blocks, empty, step, closed), lambda b: ~b.rlike(r"^\s*$"))


def budgeted(items: Column, budget: int, figure_share: float) -> Column:
    """Ids of items (structs id, size, figure) that fit in order. A figure over its own share is skipped; the first item
    over the budget ends the selection; the first accepted one always stays."""
    cap = int(budget * figure_share) if figure_share > 0 else budget
    start = F.struct(F.array().cast("array<long>").alias("ids"), F.lit(budget).alias("left"), F.lit(0).alias("figures"), F.lit(False).alias("over"))

    def state(ids, left, figures, over):
        return F.struct(ids.alias("ids"), left.alias("left"), figures.alias("figures"), over.alias("over"))

    def step(a, x):
        skipped = x["figure"] & (a["figures"] + x["size"] > cap)
        figures = a["figures"] + F.when(x["figure"], x["size"]).otherwise(0)
        return (
            F.when(a["over"] | skipped, a)
            .when((F.size(a["ids"]) > 0) & (x["size"] > a["left"]), state(a["ids"], a["left"], figures, F.lit(True)))
            .otherwise(state(F.concat(a["ids"], F.array(x["id"])), a["left"] - x["size"], figures, F.lit(False)))
        )

    return F.aggregate(items, start, step, lambda a: a["ids"])


def near_duplicate_drop(items: Column, most: float) -> Column:
    """Ids of items (structs id, tokens) kept in order: one goes if its token set is as near as `most` to a kept one."""
    start = F.array().cast("array<struct<id:bigint,tokens:array<string>>>")
    kept = F.aggregate(items, start, lambda a, x: F.when(F.exists(a, lambda y: jaccard(y["tokens"], x["tokens"]) >= most), a).otherwise(F.concat(a, F.array(x))))
    return F.transform(kept, lambda x: x["id"])


def throttled(seconds: Column, window: float) -> Column:
    """Of ascending times, those at least `window` after the last one that was let through."""
    return F.aggregate(seconds, F.array().cast("array<double>"), lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(a, -1) >= window), F.concat(a, F.array(t))).otherwise(a))


def integral_means(samples: Column, least_window: float, most_watts: float) -> Column:
    """Mean watts per reading (structs s, mj), null where none: the baseline stays while the window is too short, and
    moves on after the first reading, a counter that ran back, or an absurd mean."""
    start = F.struct(F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("mj"), F.array().cast("array<double>").alias("out"))

    def state(s, mj, a, w):
        return F.struct(s.alias("s"), mj.alias("mj"), F.concat(a["out"], F.array(w.cast("double"))).alias("out"))

    def step(a, x):
        none = F.lit(None)
        watts = (x["mj"] - a["mj"]) / 1000 / (x["s"] - a["s"])
        return (
            F.when(a["s"].isNull() | (x["mj"] < a["mj"]), state(x["s"], x["mj"], a, none))
            .when(x["s"] - a["s"] < least_window, state(a["s"], a["mj"], a, none))
            .when(watts > most_watts, state(x["s"], x["mj"], a, none))
            .otherwise(state(x["s"], x["mj"], a, watts))
        )

    return F.aggregate(samples, start, step, lambda a: a["out"])


def breaker_opens(outcomes: Column, limit: int, cooldown: float) -> Column:
    """For each outcome (structs s, ok) whether the breaker is open at that moment, before the outcome is noted.

    A failure from the `limit`-th in a row on opens it for `cooldown` seconds; a success closes it.
    """
    start = F.struct(F.lit(0).alias("failures"), F.lit(float("-inf")).alias("until"), F.array().cast("array<boolean>").alias("out"))

    def step(a, x):
        failures = F.when(x["ok"], 0).otherwise(a["failures"] + 1)
        until = F.when(x["ok"], F.lit(float("-inf"))).when(failures >= max(1, limit), x["s"] + cooldown).otherwise(a["until"])
        return F.struct(failures.alias("failures"), until.alias("until"), F.concat(a["out"], F.array(x["s"] < a["until"])).alias("out"))

    return F.aggregate(outcomes, start, step, lambda a: a["out"])


def without_thinking(text: Column) -> Column:
    """Strip one leading <think>...</think> block; without its end the text stays."""
    return F.regexp_replace(text, r"(?s)^\s*<think>.*?</think>\s*", "")


def leitner_history(answers: Column, intervals: list[int]) -> Column:
    """Box after a sequence of right and wrong answers."""
    top = max(len(intervals) - 1, 0)
    return F.aggregate(answers, F.lit(0), lambda box, ok: F.when(ok, F.least(box + 1, F.lit(top))).otherwise(0))
