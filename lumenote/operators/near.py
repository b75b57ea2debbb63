"""Comparisons of vectors by cosine distance in blocks: one row per vector and pair of blocks, never one per pair.

Vectors are dealt to cells by their nearest pivot, a bounded sample of them. A vector visits every cell that may hold
another one within the distance asked for: by the triangle inequality on angles those whose pivot is at most twice the
angle farther than its own. So no near pair is lost, whatever the pivots. Where a table is compared with itself, vectors
visit their own and later cells only, and a pair counts for both of its rows. A crowded cell is cut into blocks by a hash,
and every visiting block meets every block of the cell; a block pair is a bounded group of one task, which compares it
in tiles: single precision tells which pairs may be near, double precision which are.

Vectors that are null, hold nulls or are all zeros have no distance and are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches

#: Vectors of a block that is not cut for the sake of more tasks, blocks that are wanted, numbers of a block and cells at most.
BLOCK, BLOCKS, BLOCK_NUMBERS, MOST_CELLS = 4096, 8, 1 << 21, 1024
#: Pairs of a tile, its columns at most, and numbers that are multiplied pair by pair at once.
TILE, TILE_COLUMNS, AT_ONCE = 1 << 21, 4096, 1 << 21


def usable(vectors: DataFrame, id_column: str, vector: str, *more: str) -> DataFrame:
    """id, v, and more columns, of the vectors that have a direction."""
    v = F.col(vector).cast("array<double>")
    every = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"), *more).filter("id IS NOT NULL AND v IS NOT NULL")
    return every.filter("NOT exists(v, x -> x IS NULL) AND exists(v, x -> x <> 0)")


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) and rows else column.flatten() if rows else pa.array([], pa.float64())
    m = flat.to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 1))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _celled(pivots: np.ndarray, angle: float, own: bool, later: bool = False):
    """(id, v) to (cell, id, v): the own cell, or every cell (not before the own, if `later`) that may hold a vector within the angle."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            away = np.arccos(np.clip(_matrix(batch.column(1), batch.num_rows) @ pivots.T, -1, 1))
            home = away.argmin(axis=1)
            # a little more than the bound, so that rounding loses nothing
            near = away <= away.min(axis=1, keepdims=True) + 2 * angle + 1e-6
            if later:
                near &= np.arange(len(pivots)) >= home[:, None]
            row, cell = (np.arange(batch.num_rows), home) if own else np.nonzero(near)
            for s in range(0, len(row), BLOCK):
                part = batch.take(pa.array(row[s : s + BLOCK]))
                yield pa.RecordBatch.from_arrays([pa.array(cell[s : s + BLOCK].astype(np.int32)), part.column(0), part.column(1)], names=["cell", "id", "v"])

    return run


def block_pairs(left: DataFrame, right: DataFrame, most: float) -> DataFrame:
    """cell, i, j, side (0 left, 1 right), id, v: both sides of every pair of blocks that may hold a distance below `most`.

    Where left is right, two different vectors meet at least once, on either sides.
    """
    small_batches(right.sparkSession)
    size = right.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dims")).first()
    block = max(1, min(BLOCK_NUMBERS // size.dims, max(BLOCK, size.n // BLOCKS)))
    cells = max(1, min(MOST_CELLS, size.n // block))
    sample = right.orderBy(F.xxhash64("id"), "id").limit(cells).select("v").toArrow()  # at most MOST_CELLS rows
    pivots = _matrix(sample.column("v"), sample.num_rows) if sample.num_rows else np.ones((1, 1))
    angle = math.acos(max(-1.0, 1 - most))
    schema = "cell int, id long, v array<double>"
    sides = [left.mapInArrow(_celled(pivots, angle, False, left is right), schema), right.mapInArrow(_celled(pivots, angle, True), schema)]
    sizes = [s.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(k)) for s, k in zip(sides, ("m", "n"), strict=True)]
    sizes = F.broadcast(sizes[0].join(sizes[1], "cell"))  # a row for each of at most MOST_CELLS cells
    nth = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    a = sides[0].join(sizes, "cell").withColumn("i", nth("m")).withColumn("j", every("n")).withColumn("side", F.lit(0))
    b = sides[1].join(sizes, "cell").withColumn("j", nth("n")).withColumn("i", every("m")).withColumn("side", F.lit(1))
    columns = ["cell", "i", "j", "side", "id", "v"]
    return a.select(columns).unionByName(b.select(columns))


def near_pairs(x: np.ndarray, y: np.ndarray, most: float):
    """Rows of x, rows of y and the distance of the pairs of unit vectors nearer than `most`, tile by tile."""
    x32, y32, dims = x.astype(np.float32), y.astype(np.float32), max(1, x.shape[1])
    least = np.float32(1 - most - (dims + 8) * 1.2e-7)  # single precision errs by less
    height = TILE // TILE_COLUMNS
    for s in range(0, len(x), height):
        for t in range(0, len(y), TILE_COLUMNS):
            a, b = x[s : s + height], y[t : t + TILE_COLUMNS]
            found = np.flatnonzero(x32[s : s + height] @ y32[t : t + TILE_COLUMNS].T > least)
            if not len(found):
                continue
            r, c = np.divmod(found, len(b))
            if len(found) * 8 > len(a) * len(b):
                away = (1 - a @ b.T)[r, c]
            else:
                step = max(1, AT_ONCE // dims)
                away = np.concatenate([1 - np.einsum("ij,ij->i", a[r[k : k + step]], b[c[k : k + step]]) for k in range(0, len(r), step)])
            away = np.round(away, 12)  # equal vectors tie whatever the shape of the products
            some = away < most
            if some.any():
                yield r[some] + s, c[some] + t, away[some]


def _compared(most: float, what, schema: pa.Schema):
    def run(rows: pa.Table) -> pa.Table:
        side, ids = rows.column("side").to_numpy(), rows.column("id").to_numpy()
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(l) or not len(r):
            return schema.empty_table()
        v = _matrix(rows.column("v").combine_chunks(), len(ids))
        found = what(near_pairs(v[l], v[r], most), ids[l], ids[r])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema, strict=True)], schema=schema)

    return run


def _by_block(left: DataFrame, right: DataFrame, most: float, what, ddl: str, schema: pa.Schema) -> DataFrame:
    return block_pairs(left, right, most).groupBy("cell", "i", "j").applyInArrow(_compared(most, what, schema), ddl)


def earliest_near(left: DataFrame, right: DataFrame, most: float) -> DataFrame:
    """id, least: for rows of left (id, v) with a nearer one than `most` of a smaller id in right, the smallest such id."""
    none, itself = np.iinfo(np.int64).max, left is right

    def what(pairs, a, b):
        least, least_b = np.full(len(a), none), np.full(len(b), none)
        for x, y, _ in pairs:
            before = b[y] < a[x]
            np.minimum.at(least, x[before], b[y[before]])
            if itself:
                after = a[x] < b[y]
                np.minimum.at(least_b, y[after], a[x[after]])
        some, some_b = least < none, least_b < none
        return np.concatenate([a[some], b[some_b]]), np.concatenate([least[some], least_b[some_b]])

    found = _by_block(left, right, most, what, "id long, least long", pa.schema([("id", pa.int64()), ("least", pa.int64())]))
    return found.groupBy("id").agg(F.min("least").alias("least"))


def nearest_within(left: DataFrame, right: DataFrame, most: float) -> DataFrame:
    """id, near, distance: the nearest other row below `most` (ties: smaller id) of those rows of left that have one."""
    itself = left is right

    def best_of(best, own, row, ids, away):
        """Take what is better in a tile into the best distances and ids so far."""
        some = ids != own[row]
        row, ids, away = row[some], ids[some], away[some]
        order = np.lexsort((ids, away, row))
        row, ids, away = row[order], ids[order], away[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        row, ids, away = row[first], ids[first], away[first]
        better = (away < best[0][row]) | ((away == best[0][row]) & (ids < best[1][row]))
        for held, new in zip(best, (away, ids), strict=True):
            held[row[better]] = new[better]

    def what(pairs, a, b):
        new = lambda n: (np.full(n, np.inf), np.zeros(n, np.int64))
        of_a, of_b = new(len(a)), new(len(b))
        for x, y, away in pairs:
            best_of(of_a, a, x, b[y], away)
            if itself:
                best_of(of_b, b, y, a[x], away)
        some, some_b = np.isfinite(of_a[0]), np.isfinite(of_b[0])
        return np.concatenate([a[some], b[some_b]]), np.concatenate([of_a[1][some], of_b[1][some_b]]), np.concatenate([of_a[0][some], of_b[0][some_b]])

    schema = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("distance", pa.float64())])
    found = _by_block(left, right, most, what, "id long, near long, distance double", schema)
    best = F.min_by(F.struct("near", "distance"), F.struct("distance", "near"))
    return found.groupBy("id").agg(best.alias("b")).select("id", "b.near", "b.distance")


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (each the smallest place of its group) after the groups of the places x and y are joined."""
    while True:
        a, b = label[x], label[y]
        some = a != b
        if not some.any():
            return label
        x, y, a, b = x[some], y[some], a[some], b[some]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label = up


def links(rows: DataFrame, most: float) -> DataFrame:
    """a, b: links with the same connected components as all pairs nearer than `most`; one row per vector and block pair."""

    def what(pairs, a, b):
        ids = np.unique(np.concatenate([a, b]))
        x, y = np.searchsorted(ids, a), np.searchsorted(ids, b)
        label, some = np.arange(len(ids)), np.zeros(len(ids), bool)
        for r, c, _ in pairs:
            other = x[r] != y[c]
            p, q = x[r[other]], y[c[other]]
            some[p] = some[q] = True
            label = _joined(label, p, q)
        return ids[some], ids[label[some]]

    return _by_block(rows, rows, most, what, "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())])).filter("a <> b").distinct()
