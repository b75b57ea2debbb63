"""Cosine distance of a stated set of queries to all vectors, by matrix products inside tasks.

Every vector is brought to unit length once; a pair costs one dot product. Distances are 1 less that, rounded to 12
digits, so equal vectors tie whatever the shape of the products, and ties go to the smaller id (of any type, null last).

A query set of up to `most_numbers` numbers travels with the tasks, which scan the vectors where they lie: nothing but
results is shuffled. A larger one meets the vectors in tiles, pairs of a block of queries and a block of vectors, each a
bounded group of one task. Both ways run the same comparison. Tasks keep k rows a query, or one count, where that is asked.

Vectors that are null, hold nulls or NaN, are all zeros, or have another number of dimensions than the query have no
distance to it. A null id stands for a row like any other. Repeated rows are compared each.

Pairs may also be asked whether they share a key. Only keys of queries are looked up, in the task that has the pair, so
what grows with the square of a frequent key's rows is bits of that task and never rows of a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .tables import small_batches

#: Numbers of a query set that travels with the tasks, and of one matrix product.
MOST_NUMBERS, PRODUCT = 1 << 20, 1 << 20
#: Queries and vectors of a tile.
TILE_QUERIES, TILE_VECTORS = 4096, 32_768
#: Keys of a query set that travels with the tasks, for each of MOST_NUMBERS.
MOST_KEYS = 4
DIGITS, ROUNDING = 12, 1e-11
COUNTS = ("n", "n_shared", "n_passed")


def unit_rows(column: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Number of dimensions: rows of a list column that have a direction, and their unit vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    begin, out = np.cumsum(size) - size, {}
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        v = flat.reshape(-1, n) if len(rows) * n == len(flat) else flat[begin[rows, None] + np.arange(n)]
        with np.errstate(all="ignore"):
            norm = np.sqrt((v * v).sum(axis=1))
        some = np.isfinite(norm) & (norm > 0)
        out[n] = rows[some], v[some] / norm[some, None]
    return out


def codes(values: pa.Array, known: pa.Array) -> np.ndarray:
    """Place of each value among the known ones, their number for others, -1 for null."""
    place = pc.fill_null(pc.index_in(values.cast(known.type), known, skip_nulls=True), len(known))
    return np.where(values.is_null().to_numpy(zero_copy_only=False), -1, place.to_numpy(zero_copy_only=False))


def listed(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each value of a list column, and the values."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), column.flatten()


class SharedKeys:
    """Which rows of batches hold a key of which queries: bits for keys of a 64th of the queries, lists for others."""

    def __init__(self, keys: pa.Array):
        self.n = len(keys)
        of, flat = listed(keys)
        self.known = pc.unique(flat)
        code = codes(flat, self.known)
        order = np.argsort(code, kind="stable")
        self.of, code = of[order], code[order]
        self.begin = np.searchsorted(code, np.arange(len(self.known) + 1))
        often = np.diff(self.begin) * 64 > self.n
        self.place = np.where(often, np.cumsum(often) - 1, -1)
        self.bits = np.zeros((int(often.sum()), -(-self.n // 8)), np.uint8)
        some = (code >= 0) & often[code] if len(often) else np.zeros(len(code), bool)
        np.bitwise_or.at(self.bits, (self.place[code[some]], self.of[some] >> 3), (1 << (self.of[some] & 7)).astype(np.uint8))

    def met(self, keys: pa.Array) -> np.ndarray:
        """Rows by queries: whether they share a key."""
        row, flat = listed(keys)
        code = codes(flat, self.known)
        some = (code >= 0) & (code < len(self.known))
        row, code = row[some], code[some]
        out = np.zeros((len(keys), self.n), bool)
        place = self.place[code]
        bits_row, bits_place = row[place >= 0], place[place >= 0]
        ends = np.searchsorted(bits_row, np.arange(len(keys) + 1))
        for r in np.unique(bits_row).tolist():
            mine = np.bitwise_or.reduce(self.bits[bits_place[ends[r] : ends[r + 1]]], axis=0)
            out[r] = np.unpackbits(mine, count=self.n, bitorder="little").view(bool)
        row, code = row[place < 0], code[place < 0]
        size = self.begin[code + 1] - self.begin[code]
        for part in np.split(np.arange(len(code)), np.flatnonzero(np.diff(np.cumsum(size) // PRODUCT)) + 1):
            n = size[part]
            at = np.arange(n.sum()) + np.repeat(self.begin[code[part]] - (np.cumsum(n) - n), n)
            out[np.repeat(row[part], n), self.of[at]] = True
        return out


@dataclass
class Rule:
    """What is kept of all pairs: see `compared`."""

    k: int | None = None
    below: bool = False
    agree: bool = False
    differ: bool = False
    others: bool = False
    count: bool = False
    shared: bool = False
    close: float = np.inf


class Comparison:
    """Queries (columns id, v, and cut, group where the rule has them) that meet batches of vectors (id, v, group)."""

    def __init__(self, queries: pa.Table, rule: Rule):
        self.queries, self.rule = queries.combine_chunks(), rule
        n = self.queries.num_rows
        self.units = unit_rows(self.queries.column("v"))
        self.known_ids = pc.unique(self.queries.column("id"))
        self.own = codes(self.queries.column("id").combine_chunks(), self.known_ids)
        if rule.agree or rule.differ:
            self.known_groups = pc.unique(self.queries.column("group"))
            self.group = codes(self.queries.column("group").combine_chunks(), self.known_groups)
        self.cut = self.queries.column("cut").to_numpy().astype(float) if rule.below else np.full(n, np.inf)
        self.cut = np.where(np.isnan(self.cut), -np.inf, self.cut)
        if rule.shared:
            self.keys = SharedKeys(self.queries.column("keys").combine_chunks())
        self.worst, self.counts = np.full(n, np.inf), np.zeros((3 if rule.shared else 1, n), np.int64)  # the kth distance so far
        self.held, self.n_held = [], 0

    def meet(self, ids: pa.Array, vectors: pa.Array, groups: pa.Array | None = None, which: np.ndarray | None = None, keys: pa.Array | None = None):
        """Compare a batch, with the queries at `which` only if given; yields (query, distance, id, shared) where pairs are kept as they come."""
        for n, (rows, v) in unit_rows(vectors).items():
            if n not in self.units:
                continue
            at, q = self.units[n]
            if which is not None:
                some = np.isin(at, which)
                at, q = at[some], q[some]
            own = codes(ids, self.known_ids)[rows] if self.rule.others else None
            group = codes(groups, self.known_groups)[rows] if groups is not None else None
            step = max(1, PRODUCT // max(1, len(at)))
            for s in range(0, len(rows) if len(at) else 0, step):
                away = 1 - v[s : s + step] @ q.T
                if own is not None:
                    away[(own[s : s + step, None] == self.own[at]) & (self.own[at] >= 0)] = np.inf
                if group is not None:
                    here = group[s : s + step, None]
                    same = here == self.group[at]
                    away[~((same if self.rule.agree else ~same) & (here >= 0) & (self.group[at] >= 0))] = np.inf
                shared = self.keys.met(keys.take(pa.array(rows[s : s + step])))[:, at] if self.rule.shared else None
                yield from self._kept(away, at, rows[s : s + step], ids, shared)

    def _kept(self, away: np.ndarray, at: np.ndarray, rows: np.ndarray, ids: pa.Array, shared: np.ndarray | None = None):
        k = self.rule.k
        if k:  # raw numbers first, with room for rounding
            if len(away) > k:
                self.worst[at] = np.minimum(self.worst[at], np.partition(away, k - 1, axis=0)[k - 1])
            most = np.minimum(self.worst[at], self.cut[at]) + ROUNDING
        else:
            most = self.cut[at] + ROUNDING
        r, c = np.nonzero((away <= most) & np.isfinite(away))
        distance = np.round(away[r, c], DIGITS) + 0.0
        if self.rule.below:
            some = distance < self.cut[at[c]]
            r, c, distance = r[some], c[some], distance[some]
        if shared is not None:
            shared = shared[r, c]
            passed = shared | (distance < self.rule.close)
        if self.rule.count:
            for nth, some in enumerate([slice(None)] if shared is None else [slice(None), shared, passed]):
                self.counts[nth] += np.bincount(at[c[some]], minlength=len(self.worst))
        elif k:
            self.held.append(pa.table({"q": pa.array(at[c]), "distance": pa.array(distance), "id": ids.take(pa.array(rows[r]))}))
            self.n_held += len(r)
            if self.n_held > 4 * k * len(self.worst) + PRODUCT:
                self._cut_to_k()
        elif shared is not None:
            if passed.any():
                yield at[c[passed]], distance[passed], ids.take(pa.array(rows[r[passed]])), shared[passed]
        elif len(r):
            yield at[c], distance, ids.take(pa.array(rows[r]))

    def _cut_to_k(self) -> None:
        every = pa.concat_tables(self.held).sort_by([("q", "ascending"), ("distance", "ascending"), ("id", "ascending")])
        q = every.column("q").to_numpy()
        first = np.flatnonzero(np.diff(q, prepend=-1))
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = nth == self.rule.k - 1
        self.worst[q[last]] = np.minimum(self.worst[q[last]], every.column("distance").to_numpy()[last])
        self.held = [every.filter(pa.array(nth < self.rule.k))]
        self.n_held = self.held[0].num_rows

    def rest(self):
        """What was kept to the end."""
        if self.rule.count:
            some = np.flatnonzero(self.counts[0])
            yield some, self.counts[:, some], None
        elif self.held:
            self._cut_to_k()
            for batch in self.held[0].combine_chunks().to_batches():
                yield batch.column("q").to_numpy(), batch.column("distance").to_numpy(), batch.column("id")

    def batch(self, found) -> pa.RecordBatch:
        q, value, ids, *shared = found
        query = self.queries.column("id").combine_chunks().take(pa.array(q))
        if ids is None:
            return pa.RecordBatch.from_arrays([query, *(pa.array(x, pa.int64()) for x in value)], names=["query_id", *COUNTS[: len(value)]])
        columns = [query, ids, pa.array(value, pa.float64()), *(pa.array(x, pa.bool_()) for x in shared)]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "distance", "shared"][: len(columns)])

    def nothing(self, ids: pa.Array) -> pa.RecordBatch:
        none, n = np.zeros(0, np.int64), len(self.counts)
        if self.rule.count:
            return self.batch((none, np.zeros((n, 0)), None))
        return self.batch((none, np.zeros(0), ids.slice(0, 0), *([np.zeros(0, bool)] if self.rule.shared else [])))


def _scanned(queries: pa.Table, rule: Rule):
    def run(batches):
        work = Comparison(queries, rule)
        for batch in batches:
            groups = batch.column("group") if rule.agree or rule.differ else None
            keys = batch.column("keys") if rule.shared else None
            for found in work.meet(batch.column("id"), batch.column("v"), groups, keys=keys):
                yield work.batch(found)
        for found in work.rest():
            yield work.batch(found)

    return run


def _tiled(rule: Rule):
    def run(rows: pa.Table) -> pa.Table:
        mine = pc.equal(rows.column("side"), 0)
        work = Comparison(rows.filter(mine).drop_columns(["i", "j", "side"]), rule)
        found = [pa.Table.from_batches([work.nothing(rows.column("id").combine_chunks())])]
        for batch in rows.filter(pc.invert(mine)).combine_chunks().to_batches():
            groups = batch.column("group") if rule.agree or rule.differ else None
            keys = batch.column("keys") if rule.shared else None
            found += [pa.Table.from_batches([work.batch(x)]) for x in work.meet(batch.column("id"), batch.column("v"), groups, keys=keys)]
        return pa.concat_tables([*found, *(pa.Table.from_batches([work.batch(x)]) for x in work.rest())])

    return run


def compared(
    vectors: DataFrame, queries: DataFrame, id_column: str, vector: str, k: int | None = None, below: float | str | None = None, agree: str | None = None, differ: str | None = None, others: bool = False, count: bool = False, most_numbers: int = MOST_NUMBERS,
    shared: str | None = None, close: float = np.inf,
) -> DataFrame:
    """query_id, id, distance of the pairs of a query and a vector; or query_id, n with `count`.

    k: the k nearest of each query. below: only distances under this number, or under the queries' column of this name.
    agree, differ: a column of both that must be equal, or must not be (null: neither). others: not the query's own id.
    Without k and below every pair is a row. With count, queries without any pair have no row.
    shared: a column of both with an array of keys; adds a boolean, shared, whether any key is in both (not with k).
    Of pairs that share none, those under `close` are rows. With count all pairs count in n, and n_shared are those that
    share one, n_passed those that do or are under `close`.
    """
    if shared and k:
        raise ValueError("the k nearest don't ask for shared keys")
    rule = Rule(k=None if count else k, below=below is not None, agree=agree is not None, differ=differ is not None, others=others, count=count, shared=shared is not None, close=close)
    kind = vectors.schema[id_column].dataType
    cut = (F.col(below).cast("double") if isinstance(below, str) else F.lit(below).cast("double")).alias("cut")
    group = (F.col(agree or differ) if agree or differ else F.lit(0)).alias("group")
    keys = [F.col(shared).alias("keys")] if shared else []
    asked = queries.select(F.col(id_column).cast(kind).alias("id"), F.col(vector).alias("v"), cut, group, *keys)
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v"), group, *keys)
    ids = [StructField("query_id", kind), StructField("id", kind), StructField("distance", DoubleType()), *([StructField("shared", BooleanType())] if shared else [])]
    schema = StructType([ids[0], *(StructField(n, LongType()) for n in COUNTS[: 3 if shared else 1])] if count else ids)
    small_batches(vectors.sparkSession)
    held = F.coalesce(F.sum(F.greatest(F.size("keys"), F.lit(0))), F.lit(0)) if shared else F.lit(0)
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims"), held.alias("keys")).first()
    if size.n * max(1, size.dims) <= most_numbers and size["keys"] <= MOST_KEYS * most_numbers:
        found = rows.mapInArrow(_scanned(asked.toArrow(), rule), schema)
    else:
        i, j = max(1, -(-size.n // TILE_QUERIES)), max(1, -(-rows.count() // TILE_VECTORS))
        nth = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        a = asked.withColumn("side", F.lit(0)).withColumn("i", nth(i).cast("int")).withColumn("j", every(j))
        b = rows.withColumn("cut", F.lit(None).cast("double")).withColumn("side", F.lit(1)).withColumn("j", nth(j).cast("int")).withColumn("i", every(i))
        columns = ["i", "j", "side", "id", "v", "cut", "group", *(["keys"] if shared else [])]
        found = a.select(columns).unionByName(b.select(columns)).groupBy("i", "j").applyInArrow(_tiled(rule), schema)
    if count:
        return found.groupBy("query_id").agg(*(F.sum(n).alias(n) for n in found.columns[1:]))
    if k:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", F.asc_nulls_last("id")))
        found = found.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")
    return found
