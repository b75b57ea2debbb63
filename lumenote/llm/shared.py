"""Small helpers that several operators share: stored tables, batch slicing, byte hashing."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import dropped, keep_only, shared_dir, small_batches, stored, stored_count

__all__ = ["dropped", "keep_only", "shared_dir", "small_batches", "stored", "stored_count"]

#: Odd multipliers of the two independent rolling hashes (fixed values).
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
U64 = np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def released(run):
    """A mapInArrow function that gives freed memory back to the system at its end: Spark keeps Python workers for later
    stages, and what they hold idle would count against those."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


#: A null doc_id is worked on as a number from this one on, of its text's hash; doc_ids from here to 3 * 2^61 are taken for such.
STAND_IN, STAND_INS = 1 << 62, 1 << 61


def own_id():
    """The row's doc_id as a number that is never null: a row without one goes by its text, so equal ones are copies."""
    stand_in = F.lit(STAND_IN) + F.pmod(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), F.lit(STAND_INS))
    return F.coalesce(F.col("doc_id").cast("long"), stand_in)


def named(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", own_id())


def unnamed(df: DataFrame, *columns: str) -> DataFrame:
    """The stand-ins of named() become null again."""
    return df.withColumns({c: F.when(~F.col(c).between(STAND_IN, STAND_IN + STAND_INS - 1), F.col(c)) for c in columns})


def input_bytes(df: DataFrame) -> DataFrame:
    """doc_id and the text as UTF-8 bytes (null: empty), whatever other columns there are."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"))


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data bytes and the offsets of a binary column, without copying."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def bounded_runs(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with at most `most` bytes each; a longer row stands alone."""
    a, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n (cached, doubled when short)."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _powers[base] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return _powers[base]


class PrefixHash:
    """Hashes of any byte ranges of one buffer in constant time each, equal for equal bytes at any place."""

    def __init__(self, data: np.ndarray, base: int = BASE_A):
        up, self.down = powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def sliding(self, size: int) -> np.ndarray:
        """Hash of the `size` bytes from each place that has as many."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)


def word_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without space or control bytes 9 to 13) of adjacent rows in one buffer: start, end, row."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~gap
    first = solid[1:-1] & ~solid[:-2]
    edge = starts[(starts < ends)]
    first[edge] |= solid[1:-1][edge]
    last = solid[1:-1] & ~solid[2:]
    last[ends[starts < ends] - 1] |= solid[1:-1][ends[starts < ends] - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return a, b, np.searchsorted(ends, a, side="right")


#: Words longer than this are hashed one by one.
LONG_WORD = 256


def word_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at a..b, equal for equal words: eight bytes at a time are mixed in, long words by BLAKE2."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place
    size = b - a
    out = mix(size.astype(U64))
    which = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(which):
        left = size[which] - done
        chunk = eight[a[which] + done] & (~U64(0) >> (U64(64) - U64(8) * np.minimum(left, 8).astype(U64)))
        out[which] = mix(out[which] ^ chunk)
        done += 8
        which = which[left > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[a[i] : b[i]].tobytes(), digest_size=8).digest(), "little")
    return out
