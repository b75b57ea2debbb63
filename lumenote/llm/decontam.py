"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A mask looks at some of SPAN consecutive tokens and ignores the others. The two masks below were chosen so that any 13
tokens with at most two substitutions hold a place where one of them sees equal tokens only. Training and benchmark
hashes of all places are joined; each hit names a document, an item and how far they are shifted against each other.
Around a hit the two are compared token by token: a leak is an aligned window of WINDOW tokens (the whole item if it is
shorter) of which at least 80 % are equal.

Items of fewer than WINDOW tokens must be met whole, with the changes that 80 % leave them: none up to 4 tokens, one up
to 9, two up to 12. They have masks of their own over their first tokens: these are dealt into two blocks more than
changes are allowed, and there is a mask for every choice of that many blocks to ignore, so one ignores all changes.
Documents are hashed by the masks that the benchmark's lengths ask for. Items of fewer than `shortest` tokens are left out.

Tokens are runs of letters and digits of the lower-cased text.
Null and empty texts have no tokens. Repeated rows of an item count as one by item_id, repeated rows of a document as one
by doc_id; rows with a null doc_id are told apart by their texts and reported with the null.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import named, own_id, stored, unnamed

SPAN = 8
#: Token positions that each mask looks at (fixed values: with them no 13 tokens with two substitutions are missed).
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
WINDOW, LEAST = 13, 0.8
#: Tokens looked at and changes allowed of items under WINDOW tokens: an item takes the largest span that it fills.
SHORT = {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 8: 1, 10: 2}
#: Benchmark hashes (of 16 bytes each) that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def short_masks(span: int) -> tuple[tuple[int, ...], ...]:
    """Masks over the first `span` tokens of a short item, one for each choice of blocks to ignore."""
    changes = SHORT[span]
    blocks = [range(span * b // (changes + 2), span * (b + 1) // (changes + 2)) for b in range(changes + 2)]
    return tuple(tuple(i for i in range(span) if not any(i in b for b in ignored)) for ignored in combinations(blocks, changes))


def seeds(df: DataFrame, key: str, spans: list[int]) -> DataFrame:
    """key, place, seed: a hash of every mask at every place of the row's tokens `t`; masks take turns.

    spans: WINDOW for the masks of long items, or spans of short ones.
    """
    masks = [(n, i, SPAN if n == WINDOW else n, m) for n in spans for i, m in enumerate(MASKS if n == WINDOW else short_masks(n))]
    k, least = len(masks), min(span for _, _, span, _ in masks)
    places = F.sequence(F.lit(0), (F.size("t") - least + 1) * k - 1)
    step = df.filter(F.size("t") >= least).select(key, "t", F.explode(places).alias("step"))
    at = F.floor(F.col("step") / k).cast("int") if k & (k - 1) else F.shiftright("step", k.bit_length() - 1)
    step = step.select(key, "t", at.alias("place"), (F.col("step") % k).alias("mask"))

    def pick(values: list[Column]) -> Column:
        picked = values[-1]
        for m in range(k - 2, -1, -1):
            picked = F.when(F.col("mask") == m, values[m]).otherwise(picked)
        return picked

    if any(span > least for _, _, span, _ in masks):
        step = step.filter(F.col("place") + pick([F.lit(span) for _, _, span, _ in masks]) <= F.size("t"))
    seed = pick([F.xxhash64(F.lit(n), F.lit(i), *(F.get("t", F.col("place") + x) for x in m)) for n, i, _, m in masks])
    return step.select(key, "place", seed.alias("seed"))


def item_seeds(items: DataFrame, spans: list[int]) -> DataFrame:
    """item_id, item_place, seed: long items at every place, short ones (under WINDOW tokens) by their first tokens."""
    every = None
    for n in spans:
        if n == WINDOW:
            some = items.filter(F.size("u") >= WINDOW).select("item_id", F.col("u").alias("t"))
        else:
            above = min([x for x in (*SHORT, WINDOW) if x > n])
            some = items.filter((F.size("u") >= n) & (F.size("u") < above)).select("item_id", F.slice("u", 1, n).alias("t"))
        part = seeds(some, "item_id", [n])
        every = part if every is None else every.unionByName(part)
    return every.withColumnRenamed("place", "item_place")


def leaks(docs: DataFrame, benchmark: DataFrame, shortest: int = SPAN, stand_ins: bool = False) -> DataFrame:
    """doc_id, item_id, n_places, first_place, best_window, matched of every contaminated document and item.

    n_places counts the alignments that are leaks, first_place is the smallest document token the item's first token
    falls on (negative: before the text), best_window the equal tokens of the best window, matched those of the best
    whole alignment. stand_ins: leave the numbers that shared.own_id gives to rows without a doc_id.
    """
    items = benchmark.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text")).select("item_id", tokens(F.col("text")).alias("u")).filter(F.size("u") >= shortest)
    # at most WINDOW rows
    sizes = {r.n for r in items.select(F.least(F.size("u"), F.lit(WINDOW)).alias("n")).distinct().collect()}
    spans = [WINDOW, *sorted({max(x for x in SHORT if x <= n) for n in sizes if 0 < n < WINDOW})]
    known = stored(item_seeds(items, spans), "seeds")
    small = known.count() <= MOST_BROADCAST
    texts = named(docs).select("doc_id", tokens(F.col("text")).alias("t"))
    found = seeds(texts, "doc_id", spans).join(F.broadcast(known) if small else known, "seed")
    hits = stored(found.select("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct(), "hits")
    pairs = hits.join(texts, "doc_id").join(items, "item_id")
    low = F.greatest(-F.col("shift"), F.lit(0))
    width = F.least(F.size("u"), F.size("t") - F.col("shift")) - low
    pairs = pairs.withColumn("low", low).withColumn("width", width).withColumn("w", F.least(F.lit(WINDOW), F.size("u"))).filter("width >= w")
    equal = F.zip_with(F.slice("t", F.col("low") + F.col("shift") + 1, F.col("width")), F.slice("u", F.col("low") + 1, F.col("width")), lambda a, b: (a == b).cast("int"))
    pairs = pairs.select("doc_id", "item_id", "shift", "w", "width", equal.alias("equal"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("width") - F.col("w") + 1), lambda s: total(F.slice("equal", s, F.col("w")))))
    judged = pairs.select("doc_id", "item_id", "shift", "w", best.alias("best"), total(F.col("equal")).alias("matched")).filter(F.col("best") >= F.ceil(F.col("w") * F.lit(LEAST)))
    found = judged.groupBy("doc_id", "item_id").agg(F.count_distinct("shift").alias("n_places"), F.min("shift").alias("first_place"), F.max("best").alias("best_window"), F.max("matched").alias("matched"))
    return found if stand_ins else unnamed(found, "doc_id")


def clean(docs: DataFrame, benchmark: DataFrame, shortest: int = SPAN) -> DataFrame:
    """The documents without any leak, with all their columns."""
    found = leaks(docs, benchmark, shortest, stand_ins=True).select(F.col("doc_id").alias("_leaks")).distinct()
    return docs.join(found, own_id() == F.col("_leaks"), "left_anti")


LEAKS_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(min(text), '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS u FROM benchmark GROUP BY item_id),
dp AS (SELECT doc_id, t, unnest(range(len(t) - 7)) AS p FROM d WHERE len(t) >= 8),
bp AS (SELECT item_id, u, unnest(range(len(u) - 7)) AS q FROM b WHERE len(u) >= 8),
ds AS (SELECT doc_id, p, 0 AS m, concat_ws(' ', t[p+1], t[p+2], t[p+3], t[p+4], t[p+7], t[p+8]) AS s FROM dp
       UNION ALL SELECT doc_id, p, 1, concat_ws(' ', t[p+1], t[p+2], t[p+4], t[p+6], t[p+7], t[p+8]) FROM dp),
bs AS (SELECT item_id, q, 0 AS m, concat_ws(' ', u[q+1], u[q+2], u[q+3], u[q+4], u[q+7], u[q+8]) AS s FROM bp
       UNION ALL SELECT item_id, q, 1, concat_ws(' ', u[q+1], u[q+2], u[q+4], u[q+6], u[q+7], u[q+8]) FROM bp),
hits AS (SELECT DISTINCT doc_id, item_id, p - q AS shift FROM ds JOIN bs USING (m, s)),
a AS (SELECT doc_id, item_id, shift, t, u, greatest(-shift, 0) AS low, least(len(u), len(t) - shift) - greatest(-shift, 0) AS width,
             least(13, len(u)) AS w FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
e AS (SELECT doc_id, item_id, shift, width, w, list_transform(range(low, low + width), lambda k: CAST(t[shift + k + 1] = u[k + 1] AS INT)) AS eq FROM a WHERE width >= w),
j AS (SELECT doc_id, item_id, shift, w, list_max(list_transform(range(width - w + 1), lambda s: list_sum(eq[s+1:s+w]))) AS best, list_sum(eq) AS matched FROM e)
SELECT doc_id, item_id, count(*) AS n_places, CAST(min(shift) AS INT) AS first_place, CAST(max(best) AS INT) AS best_window, CAST(max(matched) AS INT) AS matched
FROM j WHERE best >= ceil(w * 0.8) GROUP BY doc_id, item_id
"""
