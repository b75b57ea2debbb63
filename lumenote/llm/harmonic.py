"""Harmonic packing of token sequences, without padding.

Piece lengths fall in classes by reciprocal capacity: a sequence of `limit` tokens holds k pieces of class k. As documents
may be cut anywhere, a document becomes pieces that fill their class exactly: whole sequences (class 1), and of the rest
one piece for every power of two in it (classes 2, 4, 8, ...). A class fills its sequences with k pieces each and knows
nothing of the others.

Tasks cut and number their own pieces per class while they encode, so pieces are neither shuffled nor sorted; what tasks
share is how many pieces of each class the tasks before them had. What a class has left in the end, less than a sequence,
shares sequences with the other classes' rests, in descending order of length: a piece then always starts at a multiple
of its length and none straddles a border. The very last sequence is split at powers of two, which need no padding.

`limit` is a power of two. Null and empty texts have only the end id. A row with a null doc_id is packed like any other.
A repeated row is packed once more, in a place of its own. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import binary_parts, bounded_runs, input_bytes, released, stored
from .tokens import encoder, tokenizer_path

BATCH = 4 << 20
#: Counts (of about 40 bytes each: one a task and class) that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long"


def classes(limit: int) -> np.ndarray:
    """The lengths of the classes, in descending order: limit, limit / 2, ... 1."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError(f"limit must be a power of two, not {limit}")
    return limit >> np.arange(limit.bit_length())


def cuts(tokens: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the pieces of documents with so many tokens, document after document, and each piece's document."""
    length = classes(limit)
    times = (tokens[:, None] // length) & 1
    times[:, 0] = tokens // limit
    per_row = np.tile(length, len(tokens))
    return np.repeat(per_row, times.ravel()), np.repeat(np.arange(len(tokens)), times.sum(axis=1))


def _cut_and_numbered(path: str, cut: str, end_id: int, limit: int, added: bool):
    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(limit.bit_length(), np.int64)
        for batch in batches:
            _, offsets = binary_parts(batch.column(1))
            for s, e in bounded_runs(np.diff(offsets), BATCH):
                ids, sizes = encoder(path, cut, added).encode_column(batch.column(1).slice(s, e - s))
                raw = memoryview(np.insert(ids, np.cumsum(sizes), end_id).astype("<u4").tobytes())
                tokens = sizes + 1
                length, row = cuts(tokens, limit)
                end = np.cumsum(length)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((end - length).tolist(), end.tolist(), strict=True)]
                kind = limit.bit_length() - np.frexp(length)[1]
                nth = np.empty(len(length), np.int64)
                for k in np.unique(kind):
                    at = np.flatnonzero(kind == k)
                    nth[at] = seen[k] + np.arange(len(at))
                    seen[k] += len(at)
                start = end - length - (np.cumsum(tokens) - tokens)[row]
                doc = batch.column(0).slice(s, e - s).take(pa.array(row))
                columns = [start, length, np.array(crc, np.int64), tokens[row], np.full(len(length), part), nth]
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return run


def cut_documents(docs: DataFrame, limit: int = 2048, path: str | None = None, cut: str = "word", end_id: int = 1, added: bool = False) -> DataFrame:
    """Stored pieces of every whole text's ids with end_id appended: doc_id, start, length, ids_crc32, doc_tokens, and
    their task (part) and number (nth, from 0) among that task's pieces of the length.

    added: the tokenizer's added tokens in a text get their ids.
    """
    classes(limit)
    encoded = _cut_and_numbered(path or tokenizer_path("word_bpe_49k.json"), cut, end_id, limit, added)
    return stored(input_bytes(docs).mapInArrow(released(encoded), PIECES), "pieces")


def last_sequence(rest: int) -> list[tuple[int, int]]:
    """(start, length) of the sequences that the last `rest` tokens are split into: its powers of two, descending."""
    lengths = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return [(sum(lengths[:i]), n) for i, n in enumerate(lengths)]


def _chosen(by: Column, value: dict[int, int]) -> Column:
    """The value of a key, of few keys."""
    picked = F.lit(0).cast("long")
    for key, x in value.items():
        picked = F.when(by == key, F.lit(x).cast("long")).otherwise(picked)
    return picked


def harmonic_places(pieces: DataFrame, limit: int = 2048) -> DataFrame:
    """The pieces of cut_documents with sequence_id and offset: gapless from 0 in each sequence."""
    counts = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per class
    # sequences filled by one class each come first, then what is left of the classes as one line
    first, filled, line, full, left = {}, {}, {}, 0, 0
    for n in classes(limit).tolist():
        each = limit // n
        first[n], filled[n], line[n] = full, totals.get(n, 0) // each * each, left
        full += filled[n] // each
        left += (totals.get(n, 0) - filled[n]) * n
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).select("length", "part", "before")
    if counts.count() <= MOST_BROADCAST:
        before = F.broadcast(before)
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    for name, value in (("first", first), ("filled", filled), ("line", line)):
        ranked = ranked.withColumn(name, _chosen(F.col("length"), value))
    alone = F.col("rank") < F.col("filled")
    place = F.when(alone, F.col("rank") * F.col("length")).otherwise(F.col("line") + (F.col("rank") - F.col("filled")) * F.col("length"))
    sequence = F.when(alone, F.col("first")).otherwise(full) + F.floor(F.col("place") / limit)
    ranked = ranked.withColumn("place", place).withColumn("sequence_id", sequence.cast("long")).withColumn("offset", F.col("place") % limit)
    last, number, begin = full + left // limit, F.col("sequence_id"), F.lit(0).cast("long")
    for i, (start, _) in enumerate(last_sequence(left % limit)):
        here = (F.col("sequence_id") == last) & (F.col("offset") >= start)
        number, begin = F.when(here, F.lit(last + i).cast("long")).otherwise(number), F.when(here, F.lit(start).cast("long")).otherwise(begin)
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), (F.col("offset") - begin).alias("offset"))


def harmonic_packing(docs: DataFrame, limit: int = 2048, path: str | None = None, cut: str = "word", end_id: int = 1, added: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document."""
    return harmonic_places(cut_documents(docs, limit, path, cut, end_id, added), limit)
