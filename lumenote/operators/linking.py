"""Concepts that a note might be linked with, and figures that go with what was found."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.text import is_stop_word, keywords, tokens
from . import cosine
from .classify import page_origin
from .graph import pairs_within
from .tables import small_batches, stored

#: Notes that are scored at once, and concepts at most whose scores are an array and not sorted.
NOTES, MOST_DENSE = 512, 8192
#: Notes of a task, about.
TASK_NOTES = 20_000


def useful_tokens(concept: Column) -> Column:
    return F.filter(tokens(concept), lambda t: ~is_stop_word(t) & (F.length(t) >= 3))


def candidate_concepts(notes: DataFrame, edges: DataFrame, most: int = 24, hubs: int = 10, around: int = 6, least_freq: int = 3, most_numbers: int = cosine.MOST_NUMBERS) -> DataFrame:
    """note, concept, score, place: the `most` best concepts for every note (note, text), from those in use (note, concept).

    Three sources add up. Words: 3 times the share of the concept's tokens that the note has, and ln(1 + freq) / 10.
    Neighbours: for each concept of the note used by two notes or more, the `around` that most often occur with it (ties
    by name), 1 + ln(1 + times together) / 10 each, if used by `least_freq` notes. Hubs: the most used concepts have 0.5
    less 0.01 for each place, so every note has them, behind what matches. Ties go by the concept's name.

    Concepts of up to `most_numbers` tokens and neighbours travel with the tasks, which sum up a note's sources and keep its
    best: nothing but notes with their concepts is shuffled. More of them are joined, and each source is summed up before
    anything is shuffled. Notes without text take part by their concepts; null concepts are none.
    """
    edges = edges.select("note", "concept").filter("concept IS NOT NULL")
    sets = stored(edges.groupBy("note").agg(F.array_sort(F.collect_set("concept")).alias("cs")))
    freq = stored(sets.select(F.explode("cs").alias("concept")).groupBy("concept").agg(F.count("*").alias("freq")))
    tokens_of = freq.select("concept", "freq", useful_tokens(F.col("concept")).alias("ts")).filter(F.size("ts") > 0)
    # a concept's token counts as often as it stands there
    each = tokens_of.select("concept", "freq", F.size("ts").alias("all"), F.explode("ts").alias("t")).groupBy("concept", "freq", "all", "t").agg(F.count("*").alias("times"))
    both = stored(pairs_within(sets))
    sides = both.select(F.col("a").alias("concept"), F.col("b").alias("near"), "n").unionByName(both.select(F.col("b").alias("concept"), F.col("a").alias("near"), "n"))
    nth = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("n"), "near"))
    closest = sides.withColumn("nth", nth).filter(F.col("nth") <= around).join(freq.filter(F.col("freq") >= least_freq).select(F.col("concept").alias("near")), "near", "left_semi")
    closest = stored(closest.join(freq.filter("freq >= 2").select("concept"), "concept", "left_semi").select("concept", "near", (1.0 + F.log1p("n") / 10).alias("score")))
    top = freq.orderBy(F.desc("freq"), "concept").limit(hubs)
    top = top.select("concept", (F.lit(0.5) - (F.row_number().over(Window.orderBy(F.desc("freq"), "concept")) - 1) * 0.01).alias("score"))
    said = notes.select("note", keywords(F.coalesce("text", F.lit(""))).alias("ws"))
    place = F.row_number().over(Window.partitionBy("note").orderBy(F.desc("score"), "concept"))
    if each.count() + closest.count() + freq.count() <= most_numbers:
        none = F.array().cast("array<string>")
        rows = said.select("note", "ws", F.lit(1).alias("copies"), none.alias("cs")).unionByName(sets.select("note", none.alias("ws"), F.lit(0).alias("copies"), "cs"))
        # tasks of a bounded number of notes: what is shuffled is small, what is done with it is not
        rows = rows.repartition(1 + sets.count() // TASK_NOTES, "note").groupBy("note").agg(F.flatten(F.collect_list("ws")).alias("ws"), F.sum("copies").cast("int").alias("copies"), F.flatten(F.collect_list("cs")).alias("cs"))
        small_batches(notes.sparkSession)
        schema = StructType([StructField("note", rows.schema["note"].dataType), StructField("concept", StringType()), StructField("score", DoubleType()), StructField("place", IntegerType())])
        names = pa.array(sorted((r.concept for r in freq.select("concept").collect()), key=str.encode), pa.string())
        return rows.mapInArrow(_best_concepts(names, each.toArrow(), closest.toArrow(), top.toArrow(), most), schema)
    words = said.select("note", F.explode("ws").alias("t"))
    by_words = words.join(each, "t").groupBy("note", "concept").agg((3.0 * F.sum("times") / F.first("all") + F.log1p(F.first("freq")) / 10).alias("score"))
    by_neighbours = sets.select("note", F.explode("cs").alias("concept")).join(closest, "concept").groupBy("note", F.col("near").alias("concept")).agg(F.sum("score").alias("score"))
    by_hubs = notes.select("note").crossJoin(F.broadcast(top))  # at most `hubs` rows
    every = by_words.unionByName(by_neighbours).unionByName(by_hubs.select("note", "concept", "score"))
    total = every.repartition("note").groupBy("note", "concept").agg(F.round(F.sum("score"), 9).alias("score"))
    return total.withColumn("place", place).filter(F.col("place") <= most)


def _best_concepts(names: pa.Array, each: pa.Table, closest: pa.Table, top: pa.Table, most: int):
    """(note, ws, copies, cs) to (note, concept, score, place), the `most` best of each note."""

    def lists(key: np.ndarray, n: int, *values: np.ndarray):
        order = np.argsort(key, kind="stable")
        return np.searchsorted(key[order], np.arange(n + 1)), *(v[order] for v in values)

    place_of = lambda table, column: cosine.codes(table.column(column).combine_chunks(), names)
    number = lambda table, column: table.column(column).to_numpy().astype(float)
    tokens_known = pc.unique(each.column("t")) if each.num_rows else pa.array([], pa.string())
    by_token = lists(cosine.codes(each.column("t").combine_chunks(), tokens_known), len(tokens_known), place_of(each, "concept"), number(each, "times"))
    length, bonus = np.ones(len(names)), np.zeros(len(names))
    length[place_of(each, "concept")] = number(each, "all")
    bonus[place_of(each, "concept")] = np.log1p(number(each, "freq")) / 10
    by_near = lists(place_of(closest, "concept"), len(names), place_of(closest, "near"), number(closest, "score"))
    hub, hub_score = place_of(top, "concept"), number(top, "score")

    def spread(row, code, begin, to, value):
        size = begin[code + 1] - begin[code]
        at = np.arange(size.sum()) + np.repeat(begin[code] - (np.cumsum(size) - size), size)
        return np.repeat(row, size), to[at], value[at]

    def summed(key, value):
        if len(names) <= MOST_DENSE:
            key, some = np.bincount(key, value, NOTES * len(names)), np.bincount(key, minlength=NOTES * len(names)).nonzero()[0]
            return some, key[some]
        key, back = np.unique(key, return_inverse=True)
        return key, np.bincount(back, value, len(key))

    def run(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, NOTES):
                batch = whole.slice(s, NOTES)
                row, words = cosine.listed(batch.column("ws"))
                code = cosine.codes(words, tokens_known)
                some = (code >= 0) & (code < len(tokens_known))
                row, concept, times = spread(row[some], code[some], *by_token)
                key, times = summed(row * len(names) + concept, times)
                concept = key % max(1, len(names))
                mine, own = cosine.listed(batch.column("cs"))
                near_row, near, near_score = spread(mine, cosine.codes(own, names), *by_near)
                copies = batch.column("copies").to_numpy()
                rows = np.arange(batch.num_rows)
                keys = np.concatenate([key, near_row * len(names) + near, np.repeat(rows, len(hub)) * len(names) + np.tile(hub, batch.num_rows)])
                scores = np.concatenate([3.0 * times / length[concept] + bonus[concept], near_score, np.repeat(copies, len(hub)) * np.tile(hub_score, batch.num_rows)])
                counted = np.concatenate([np.ones(len(key) + len(near), bool), np.repeat(copies > 0, len(hub))])
                key, score = summed(keys[counted], scores[counted])
                score = np.round(score, 9)
                row, concept = key // max(1, len(names)), key % max(1, len(names))
                order = np.lexsort((concept, -score, row))
                row = row[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row) + 1
                kept = order[nth <= most]
                yield pa.RecordBatch.from_arrays([batch.column("note").take(pa.array(key[kept] // max(1, len(names)))), names.take(pa.array(concept[kept])), pa.array(score[kept], pa.float64()), pa.array(nth[nth <= most].astype(np.int32))], names=["note", "concept", "score", "place"])

    return run


def first_origins(ranked: DataFrame, most: int = 6) -> DataFrame:
    """query_id, origin: the first `most` different page origins of each ranked list (query_id, place, origin).

    No list is gathered: an origin keeps its best place, and the order is taken over these.
    """
    pages = ranked.withColumn("origin", F.trim("origin")).filter(page_origin(F.col("origin")))
    best = pages.groupBy("query_id", "origin").agg(F.min("place").alias("place"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "origin"))
    return best.withColumn("nth", nth).filter(F.col("nth") <= most).select("query_id", "origin")


def colocated(ranked: DataFrame, queries: DataFrame, figures: DataFrame, pages: int = 6, looked_at: int = 8, margin: float = 1.1, most: int = 2) -> DataFrame:
    """query_id, source, place: the figures that go with what a query found.

    Of the figures (id, source, origin, suspect, v) on the first `pages` page origins of its list, the `looked_at` nearest
    to the query (id, v); suspect ones go before the cut, so that none of them sets it; what is farther than `margin`
    times the nearest goes; of a source the nearest figure stays, and the first `most` sources are taken. Ties by id.
    """
    origins = first_origins(ranked, pages).withColumnRenamed("query_id", "id").join(queries.select("id", "v"), "id")
    # a row for each origin of a query: a figure agrees with one of them
    near = cosine.compared(figures.withColumn("origin", F.trim("origin")), origins, "id", "v", k=looked_at, agree="origin")
    known = near.join(figures.select("id", "source", "suspect"), "id").filter("source <> '' AND NOT coalesce(suspect, false)")
    least = F.min("distance").over(Window.partitionBy("query_id"))
    kept = known.withColumn("least", least).filter(F.col("distance") <= F.col("least") * margin)
    best = kept.groupBy("query_id", "source").agg(F.min(F.struct("distance", "id")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    return best.withColumn("place", place).filter(F.col("place") <= most).select("query_id", "source", "place")
