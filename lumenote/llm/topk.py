"""Exact top-k search over binary codes by incremental multi-index hashing.

Vectors become sign bits (1 where above 0). A code is cut into segments of about log2(number of codes) bits; a segment
table maps each segment value to its codes. In round r every query looks up the values at Hamming distance r of each of
its segments. After round r every code within m * (r + 1) - 1 of the query has been seen, so a query stops as soon as
its kth best verified distance is within that bound; only the others go on.

Spark keeps a segment table in groups by segment and leading key bits; a query goes only to the groups its ball of
radius r can touch, and within a group the remaining bits are looked up by array. A group returns at most k + 1 codes a
query. Equal codes are one entry with its k + 1 smallest ids, enough for exact ties; crowded groups are split by a hash.

Results are ordered by (distance, id) and leave the query itself out. Null vectors, vectors with null elements and
vectors of another length than most (the longest, on a tie) are neither found nor answered; a vector without k others
gets as many as there are. Ids must be unique.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored

#: Codes of a group, about; more than this in one are split.
GROUP = 1 << 13


def sign_codes(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, int]:
    """(id, code) with the code's bits packed in bytes, and the number of bits."""
    whole = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    most = whole.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("n")).first()
    bits = most.n if most else 0

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.packbits(values > 0, axis=1)], pa.binary())], names=["id", "code"])

    return whole.filter(F.size("v") == bits).select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(pack, "id long, code binary"), bits


def segment_bounds(bits: int, count: int) -> list[int]:
    """Ends of m nearly equal segments of about log2(count) bits, at most 24 bits each."""
    m = max(1, -(-bits // 24), round(bits / max(1.0, math.log2(max(count, 2)))))
    return [bits * i // m for i in range(min(m, bits) + 1)] if bits else [0]


def _keys(codes: np.ndarray, a: int, b: int) -> np.ndarray:
    """Bits a to b of unpacked codes as integers."""
    return codes[:, a:b] @ (1 << np.arange(b - a - 1, -1, -1, dtype=np.int64))


def _unpacked(column: pa.Array | pa.ChunkedArray, bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(raw, axis=1)[:, :bits].astype(np.int64)


def _rings(bits: int, radius: int) -> np.ndarray:
    """All masks of `bits` bits with `radius` ones."""
    return np.array([sum(1 << i for i in ones) for ones in itertools.combinations(range(bits), radius)], np.int64)


def _segmented(bounds: list[int], bits: int, top: list[int], radius: int | None):
    """Codes to (segment, lead, code): their own group, or all groups that a ball of the radius touches."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _unpacked(batch.column(0), bits)
            for s, (a, b) in enumerate(itertools.pairwise(bounds)):
                lead = _keys(codes, a, b) >> (b - a - top[s])
                masks = [np.zeros(1, np.int64)] if radius is None else [_rings(top[s], r) for r in range(min(radius, top[s]) + 1)]
                for mask in np.concatenate(masks).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lead), s, np.int32)), pa.array(lead ^ mask), batch.column(0)], names=["segment", "lead", "code"])

    return run


def _searched(bounds: list[int], bits: int, top: list[int], radius: int, keep: int):
    """One group: its codes at distance exactly `radius` in the segment, verified; the best `keep` of each query."""
    schema = pa.schema([("query", pa.binary()), ("code", pa.binary()), ("distance", pa.int32()), ("least", pa.int64()), ("n", pa.int32())])

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        if not queries.num_rows or not index.num_rows:
            return schema.empty_table()
        s, lead = queries.column("segment")[0].as_py(), queries.column("lead")[0].as_py()
        a, b = bounds[s], bounds[s + 1]
        low_bits = b - a - top[s]
        codes = _unpacked(index.column("code"), bits)
        order = np.argsort(_keys(codes, a + top[s], b), kind="stable")
        low = _keys(codes, a + top[s], b)[order]
        raw = np.frombuffer(b"".join(index.column("code").to_pylist()), np.uint8).reshape(len(codes), -1)[order]
        least, n = index.column("least").to_numpy()[order], index.column("n").to_numpy()[order]
        asked = _unpacked(queries.column("code"), bits)
        own, own_low = _keys(asked, a, a + top[s]), _keys(asked, a + top[s], b)
        rings: dict[int, np.ndarray] = {}
        out = []
        for q, code in enumerate(queries.column("code").to_pylist()):
            rest = radius - int(own[q] ^ lead).bit_count()
            if rest < 0 or rest > low_bits:
                continue
            if rest not in rings:
                rings[rest] = _rings(low_bits, rest)
            keys = own_low[q] ^ rings[rest]
            x, y = np.searchsorted(low, keys), np.searchsorted(low, keys, side="right")
            size = y - x
            if not size.sum():
                continue
            at = np.repeat(x - np.cumsum(size) + size, size) + np.arange(size.sum())
            d = np.bitwise_count(raw[at] ^ np.frombuffer(code, np.uint8)).sum(axis=1).astype(np.int32)
            best = np.lexsort((least[at], d))[:keep]
            out += [(code, raw[i].tobytes(), int(e), int(least[i]), int(n[i])) for i, e in zip(at[best].tolist(), d[best].tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else schema.empty_table()

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), neighbour_id, distance: the k nearest other vectors of each query by Hamming distance."""
    keep = k + 1
    coded, bits = sign_codes(vectors, id_column, vector_column)
    coded = stored(coded, "codes")
    asked = stored(coded.join(queries.select(F.col(id_column).cast("long").alias("id")).distinct(), "id", "left_semi"), "queries")
    # equal codes: count, and the smallest ids by a ranking that Spark prunes before the shuffle
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    first = coded.withColumn("nth", nth).filter(F.col("nth") <= keep)
    distinct = stored(first.groupBy("code").agg(F.min("id").alias("least"), F.count("*").cast("int").alias("n")), "distinct")
    count = distinct.count()
    bounds = segment_bounds(bits, count)
    top = [max(0, min(b - a, math.ceil(math.log2(max(count, 1) / GROUP)) if count > GROUP else 0)) for a, b in itertools.pairwise(bounds)]
    index = distinct.select("code").mapInArrow(_segmented(bounds, bits, top, None), "segment int, lead long, code binary").join(distinct, "code")
    salts = index.groupBy("segment", "lead").agg(F.ceil(F.count("*") / (4 * GROUP)).cast("int").alias("salts"))
    salts = stored(salts, "salts")
    index = stored(index.join(salts, ["segment", "lead"]).withColumn("salt", F.pmod(F.xxhash64("code"), F.col("salts")).cast("int")), "index")
    active = asked.select("code").distinct()
    done, best = None, None
    group = ["segment", "lead", "salt"]
    schema = "query binary, code binary, distance int, least long, n int"
    for radius in range(max((b - a for a, b in itertools.pairwise(bounds)), default=-1) + 1):
        sent = active.mapInArrow(_segmented(bounds, bits, top, radius), "segment int, lead long, code binary").join(salts, ["segment", "lead"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        found = sent.groupBy(*group).cogroup(index.groupBy(*group)).applyInArrow(_searched(bounds, bits, top, radius, keep), schema)
        every = found if best is None else found.unionByName(best)
        by = Window.partitionBy("query").orderBy("distance", "least")
        best = stored(every.distinct().withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= keep).drop("nth"), "best")
        seen = (len(bounds) - 1) * (radius + 1) - 1
        enough = best.filter(F.col("distance") <= seen).groupBy("query").agg(F.sum("n").alias("n")).filter(F.col("n") >= keep)
        ended = best.join(enough.select("query"), "query", "left_semi")
        done = ended if done is None else done.unionByName(ended)
        active = stored(active.join(enough.select(F.col("query").alias("code")), "code", "left_anti"), "active")
        best = best.join(active.select(F.col("code").alias("query")), "query", "left_semi")
        if not active.limit(1).count():
            break
    if done is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, neighbour_id long, distance int")
    done = done.unionByName(best)
    near = done.select("query", "code", "distance").join(first.select("code", F.col("id").alias("neighbour_id")), "code")
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour_id"))).filter(F.col("nth") <= keep)
    pairs = asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(near, "query").filter("query_id != neighbour_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance")


TOP_K_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id,
             CAST(list_sum(list_transform(range(1, len(a.s) + 1), lambda i: CAST(a.s[i] <> b.s[i] AS INT))) AS INT) AS distance
      FROM c a JOIN c b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INT) AS rank FROM p)
SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= 10
"""
