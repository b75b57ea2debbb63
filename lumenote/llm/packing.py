"""Best-fit packing of token sequences, planned on the histogram of piece lengths.

Documents longer than the limit are cut; whole pieces fill a sequence alone. The plan is made on counts by length, at
most `limit` of them: lengths go in descending order, each to the open sequences with the least room that still fits,
many equal sequences at a time. It yields slot ranges (length, ranks, sequences, offset). Pieces take the planned slots
by joining on their rank within their length, so neither planning nor placing sees more than counts at one place.

Null and empty texts have only the end id. Ranks follow (doc_id, piece); rows with a null doc_id are packed like others,
first. A repeated row is packed once more, each time in a place of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import binary_parts, bounded_runs, input_bytes, stored
from .tokens import encoder, tokenizer_path

BATCH = 4 << 20
#: Pieces of a part, about: those of one length are numbered part by part, so that a frequent length isn't one task.
PART = 50_000
#: Ranks of a bucket: pieces meet only the slot ranges that touch their rank's bucket.
BUCKET = 4096
#: Slot ranges (of about 100 bytes each) that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 100_000


def plan(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts. Rows (length, first rank, end rank, first sequence, per sequence, offset):

    ranks first..end of that length go to consecutive sequences, `per sequence` of them to each, from `offset` on.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # open rooms in ascending order
    groups: dict[int, list[tuple[int, int]]] = {}  # room: runs (first sequence, count)
    fresh = 0

    def keep(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, count))

    for length in sorted((n for n in histogram if n), reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, count = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            else:
                room, first, count = limit, fresh, -(-left // (limit // length))
                fresh += count
            each = room // length
            full = min(count, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, limit - room))
                keep(room - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            if left and full < count:  # the rest fills one sequence in part
                slots.append((length, rank, rank + left, first + full, left, limit - room))
                keep(room - left * length, first + full, 1)
                keep(room, first + full + 1, count - full - 1)
                left = 0
            else:
                keep(room, first + full, count - full)
    return slots


def _pieces(path: str, cut: str, end_id: int, limit: int, added: bool):
    def run(batches):
        for batch in batches:
            _, offsets = binary_parts(batch.column(1))
            for s, e in bounded_runs(np.diff(offsets), BATCH):
                ids, sizes = encoder(path, cut, added).encode_column(batch.column(1).slice(s, e - s))
                raw = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4")
                ends = np.cumsum(sizes + 1)
                rows = [(d, k, x - a, min(limit, b - x), zlib.crc32(raw[x : min(x + limit, b)].tobytes())) for d, a, b in zip(range(s, e), (ends - sizes - 1).tolist(), ends.tolist(), strict=True) for k, x in enumerate(range(a, b, limit))]
                row, *columns = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, limit: int = 4096, path: str | None = None, cut: str = "word", end_id: int = 1, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each whole text's ids with end_id appended, cut at `limit`.

    added: the tokenizer's added tokens in a text get their ids.
    """
    return input_bytes(docs).mapInArrow(_pieces(path or tokenizer_path("word_bpe_49k.json"), cut, end_id, limit, added), "doc_id long, piece long, start long, length long, ids_crc32 long").withColumn("piece", F.col("piece").cast("int"))


def packed(pieces: DataFrame, limit: int = 4096) -> DataFrame:
    """The pieces with sequence_id and offset: gapless from 0 in each sequence, at most `limit` long."""
    spark = pieces.sparkSession
    pieces = stored(pieces, "pieces")
    parts = max(64, pieces.count() // PART)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counts = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    planned = plan(histogram, limit)
    slots = spark.createDataFrame(planned, "length long, first_rank long, end_rank long, first_sequence long, each long, place long")
    slots = slots.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first_rank") / BUCKET), F.floor((F.col("end_rank") - 1) / BUCKET))))
    if len(planned) + sum(histogram.values()) // BUCKET <= MOST_BROADCAST:
        slots = F.broadcast(slots)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).select("length", "part", "before")
    ranked = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))).join(before, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth") - 1).withColumn("bucket", F.floor(F.col("rank") / BUCKET))
    placed = ranked.join(slots, ["length", "bucket"]).filter((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    within = F.col("rank") - F.col("first_rank")
    sequence = F.col("first_sequence") + F.floor(within / F.col("each"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.cast("long").alias("sequence_id"), (F.col("place") + within % F.col("each") * F.col("length")).alias("offset"))


def best_fit_packing(docs: DataFrame, limit: int = 4096, path: str | None = None, cut: str = "word", end_id: int = 1, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return packed(token_pieces(docs, limit, path, cut, end_id, added), limit)
