"""Approximate nearest vectors by an inverted file, with filters on the indexed columns.

Centroids are fitted by spherical k-means on a bounded sample (the first rows by a hash of the id, `sample_numbers`
numbers in all). Every vector that has a direction goes to the list of its nearest centroid; the lists are one stored table, sorted by list, in
which a filter reaches the Parquet scan. A search looks through the lists nearest to a query and ranks what it finds by
exact distances (of `cosine`, with its ties and its rounding).

How many lists: `probes` is calibrated on the sample, as the smallest number that finds `target` of the true neighbours
of sample rows within the sample. A filter thins the lists, so a query takes its nearest lists that still hold rows,
further ones too until they hold `enough` rows in all. What a filter leaves of fewer rows than the sample had is looked
through whole: there the index is exact. Where nothing passes the filter, the search is over all rows.

A small query set travels with tasks that read the lists in place; a larger one meets them by list, in blocks of bounded
size. Queries without a direction, or of other dimensions than the index, find nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .cosine import MOST_NUMBERS, TILE_QUERIES, TILE_VECTORS, Comparison, Rule, unit_rows
from .tables import stored

#: Lists at most (their centroids travel with tasks), and sample rows that calibrate.
MOST_LISTS, CALIBRATING = 4096, 256


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Spherical k-means: unit centroids; an empty one moves to the sample row that is worst served."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = sample @ centroids.T
        own, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norm < 1e-12)
        centroids = sums / np.maximum(norm, 1e-12)[:, None]
        centroids[empty] = sample[np.argsort(best)[: len(empty)]]
    return centroids


def calibrated_probes(sample: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """The smallest number of lists that hold `target` of the k true neighbours of the first sample rows."""
    asked, k = sample[:CALIBRATING], min(k, len(sample) - 1)
    if k < 1:
        return 1
    away = 1 - asked @ sample.T
    away[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    true = np.argpartition(away, k - 1, axis=1)[:, :k]
    own = (sample @ centroids.T).argmax(axis=1)
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    rank[np.arange(len(asked))[:, None], order] = np.arange(len(centroids))
    place = rank[np.arange(len(asked))[:, None], own[true]]
    return 1 + int(np.quantile(place, target, method="inverted_cdf"))


def _listed(centroids: np.ndarray, names: list[str]):
    def run(batches):
        for batch in batches:
            rows, v = unit_rows(batch.column("v")).get(centroids.shape[1], (np.zeros(0, np.int64), np.zeros((0, centroids.shape[1]))))
            own = (v @ centroids.T).argmax(axis=1).astype(np.int32)
            some = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(own), *some.columns], names=["list", *names])

    return run


@dataclass
class VectorIndex:
    lists: DataFrame  # list, id, v and the indexed columns, stored
    centroids: np.ndarray
    probes: int
    sample_rows: int

    def search(self, queries: DataFrame, id_column: str, vector: str, k: int, where: Column | str | None = None, probes: int | None = None, enough: int | None = None, most_numbers: int = MOST_NUMBERS) -> DataFrame:
        """query_id, id, distance, place of the k nearest that are found for each query, among rows that pass `where`."""
        spark, rows = self.lists.sparkSession, self.lists
        rows = rows if where is None else rows.filter(where)
        sizes = {r["list"]: r.n for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MOST_LISTS rows
        if not sizes:
            rows = self.lists
            sizes = {r["list"]: r.n for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect()}
        n = np.zeros(len(self.centroids), np.int64)
        n[list(sizes)] = list(sizes.values())
        whole = n.sum() <= self.sample_rows
        take = len(n) if whole else (probes or self.probes)
        enough = max(4 * k, 64) if enough is None else enough
        kind = rows.schema["id"].dataType
        asked = queries.select(F.col(id_column).cast(kind).alias("id"), F.col(vector).alias("v"))
        schema = StructType([StructField("query_id", kind), StructField("id", kind), StructField("distance", DoubleType())])
        if asked.count() * self.centroids.shape[1] <= most_numbers:
            found = rows.select("list", "id", "v").mapInArrow(_in_place(asked.toArrow(), self.centroids, n, take, enough, k), schema)
        else:
            probed = asked.mapInArrow(_probing(self.centroids, n, take, enough), StructType([StructField("list", IntegerType()), *asked.schema.fields]))
            probed = stored(probed, "probed")
            asked_by = {r["list"]: r.n for r in probed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MOST_LISTS rows
            blocks = [(lst, -(-m // TILE_QUERIES), int(max(1, -(-n[lst] // TILE_VECTORS)))) for lst, m in asked_by.items()]
            blocks = F.broadcast(spark.createDataFrame(blocks, "list int, m int, n int"))
            nth = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
            every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
            a = probed.join(blocks, "list").withColumn("side", F.lit(0)).withColumn("i", nth("m")).withColumn("j", every("n"))
            b = rows.select("list", "id", "v").join(blocks, "list").withColumn("side", F.lit(1)).withColumn("j", nth("n")).withColumn("i", every("m"))
            names = ["list", "i", "j", "side", "id", "v"]
            found = a.select(names).unionByName(b.select(names)).groupBy("list", "i", "j").applyInArrow(_by_list(k), schema)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", F.asc_nulls_last("id")))
        return found.withColumn("place", place).filter(F.col("place") <= k)


def build_index(vectors: DataFrame, id_column: str, vector: str, columns: list[str] | None = None, lists: int | None = None, k: int = 10, target: float = 0.95, sample_numbers: int = 1 << 22, name: str = "vectors") -> VectorIndex:
    """Fit, assign and store. columns: other columns that searches may filter by. lists: by default about 4 * sqrt(n)
    rows a list. The sample has at most `sample_numbers` numbers."""
    # rows of another number of dimensions than most of the sample are left out
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v"), *(columns or []))
    size = rows.agg(F.count("v").alias("n"), F.max(F.size("v")).alias("dims")).first()
    dims = size.dims or 1
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(max(2, sample_numbers // max(1, dims))).toArrow()
    units = unit_rows(sample.column("v")) if sample.num_rows else {}
    units = {d: v for d, (_, v) in units.items() if len(v)}
    unit = max(units.values(), key=len) if units else np.ones((1, dims))
    count = lists or max(1, round(size.n**0.5 / 4))
    centroids = fit_centroids(unit, min(MOST_LISTS, count, len(unit)))
    names = ["id", "v", *(columns or [])]
    schema = StructType([StructField("list", IntegerType()), *rows.schema.fields])
    listed = rows.mapInArrow(_listed(centroids, names), schema).sortWithinPartitions("list")
    return VectorIndex(stored(listed, name), centroids, calibrated_probes(unit, centroids, k, target), len(unit))


def chosen_lists(units: np.ndarray, centroids: np.ndarray, sizes: np.ndarray, take: int, enough: int) -> np.ndarray:
    """Whether each query looks through each list: its `take` nearest that hold rows, and more until they hold enough."""
    order = np.argsort(-(units @ centroids.T), axis=1, kind="stable")
    size = sizes[order]
    before = np.cumsum(size, axis=1) - size
    yes = (size > 0) & ((np.cumsum(size > 0, axis=1) <= take) | (before < enough))
    out = np.zeros(order.shape, bool)
    np.put_along_axis(out, order, yes, axis=1)
    return out


def _in_place(queries: pa.Table, centroids: np.ndarray, sizes: np.ndarray, take: int, enough: int, k: int):
    def run(batches):
        work = Comparison(queries, Rule(k=k))
        at, units = work.units.get(centroids.shape[1], (np.zeros(0, np.int64), np.zeros((0, centroids.shape[1]))))
        looks = chosen_lists(units, centroids, sizes, take, enough)
        for batch in batches:
            own = batch.column("list").to_numpy()
            for lst in np.unique(own).tolist():
                which = at[looks[:, lst]]
                if len(which):
                    here = batch.take(pa.array(np.flatnonzero(own == lst)))
                    yield from (work.batch(x) for x in work.meet(here.column("id"), here.column("v"), which=which))
        yield from (work.batch(x) for x in work.rest())

    return run


def _probing(centroids: np.ndarray, sizes: np.ndarray, take: int, enough: int):
    """(id, v) to (list, id, v), a row for each list to look through."""

    def run(batches):
        for batch in batches:
            rows, v = unit_rows(batch.column("v")).get(centroids.shape[1], (np.zeros(0, np.int64), np.zeros((0, centroids.shape[1]))))
            for s in range(0, len(rows), 256):
                r, lst = np.nonzero(chosen_lists(v[s : s + 256], centroids, sizes, take, enough))
                for x in range(0, len(r), TILE_QUERIES):
                    some = batch.take(pa.array(rows[s : s + 256][r[x : x + TILE_QUERIES]]))
                    yield pa.RecordBatch.from_arrays([pa.array(lst[x : x + TILE_QUERIES].astype(np.int32)), *some.columns], names=["list", "id", "v"])

    return run


def _by_list(k: int):
    def run(rows: pa.Table) -> pa.Table:
        mine = pc.equal(rows.column("side"), 0)
        asked = rows.filter(mine).select(["id", "v"])
        work = Comparison(asked, Rule(k=k))
        for batch in rows.filter(pc.invert(mine)).combine_chunks().to_batches():
            list(work.meet(batch.column("id"), batch.column("v")))
        none = work.batch((np.zeros(0, np.int64), np.zeros(0), rows.column("id").combine_chunks().slice(0, 0)))
        return pa.concat_tables([pa.Table.from_batches([none]), *(pa.Table.from_batches([work.batch(x)]) for x in work.rest())])

    return run


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of the exact neighbours (query_id, id) that were found; a row for every query asked."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit")).distinct()
    return exact.select("query_id", "id").join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
