"""Token ids in a binary form: frequency-ranked ids, byte-aligned variable-length codes, control bytes kept apart.

Ids are replaced by their rank in the corpus' frequency order (ties: smaller id first), so frequent ids take one byte.
A code has 1 to 4 bytes; four codes share a control byte of four 2-bit lengths, which are stored apart from the data.
Decoding looks each control byte up in a table of four lengths and gathers the data bytes by position: no loop over ids.

A written corpus is a folder with two tables in the shared store: `vocabulary` (rank, id) and `shards`, whose rows are
blocks of consecutive documents in ascending doc_id order: shard, block, doc_ids, sizes, control, data. Blocks hold
about BLOCK_IDS ids, a longer document has a block of its own. Task retries rewrite whole rows, so a lost executor
leaves nothing half-written.

Null and empty texts have only the end id. A repeated row is written once more, next to the first; rows with a null
doc_id come before all others. An empty table gives an empty corpus.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import binary_parts, bounded_runs, input_bytes, shared_dir, stored
from .tokens import encoder, tokenizer_path

BATCH = 4 << 20
BLOCK_IDS = 1 << 18
#: How raw ids are held before ranking, by whether 2 bytes are too few.
ID_TYPE = {False: "<u2", True: "<u4"}
#: Lengths (1 to 4) of the four codes of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.ones(-(-len(v) // 4) * 4, np.int64)
    padded[: len(v)] = size
    control = ((padded.reshape(-1, 4) - 1) << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8)
    raw = v.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The `count` values of packed bytes."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    start = np.cumsum(size) - size
    body = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = np.zeros(count, np.uint32)
    for k in range(4):
        out |= np.where(size > k, body[start + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def _encoded(path: str, cut: str, end_id: int, added: bool):
    """(doc_id, body) to doc_id and the ids with the end id, as little-endian integers of 2 or 4 bytes.

    A task's last row has no doc_id (`counts` is true) and holds how often the task met each id, as 8-byte integers.
    """

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            _, offsets = binary_parts(batch.column(1))
            for s, e in bounded_runs(np.diff(offsets), BATCH):
                tool = encoder(path, cut, added)
                ids, sizes = tool.encode_column(batch.column(1).slice(s, e - s))
                raw = np.insert(ids, np.cumsum(sizes), end_id).astype(ID_TYPE[tool.wide or end_id > 0xFFFF])
                at = np.append(0, np.cumsum(sizes + 1)).astype(np.int32) * raw.itemsize
                column = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer(at), pa.py_buffer(raw)])
                met = np.bincount(raw, minlength=len(total))
                total = met + np.append(total, np.zeros(len(met) - len(total), np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(np.full(e - s, raw.itemsize == 4)), pa.array(np.zeros(e - s, bool)), column], names=["doc_id", "wide", "counts", "ids"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([False]), pa.array([True]), pa.array([total.astype("<i8").tobytes()])], names=["doc_id", "wide", "counts", "ids"])

    return run


def _raw_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch, and the bounds of its documents in them."""
    data, offsets = binary_parts(batch.column("ids"))
    kind = ID_TYPE[bool(batch.num_rows and batch.column("wide")[0].as_py())]
    width = np.dtype(kind).itemsize
    return data[offsets[0] : offsets[-1]].view(kind), (offsets - offsets[0]) // width


def _counted(batches):
    """Rows of counts to (id, n) of the ids in use."""
    for batch in batches:
        for raw in batch.column("ids"):
            total = np.frombuffer(raw.as_py(), "<i8")
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])


def _blocked(ranks: np.ndarray):
    """Documents of one sorted partition to blocks with ranked ids."""

    def run(batches):
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        total = 0

        def row():
            nonlocal held, total, block
            docs = pa.concat_arrays([x for x, _, _ in held])
            sizes, ids = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
            control, data = pack(ranks[ids])
            at = pa.array([0, len(docs)], pa.int32())
            columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.ListArray.from_arrays(at, docs), pa.ListArray.from_arrays(at, pa.array(sizes.astype(np.int32))), pa.array([control]), pa.array([data])]
            held, total, block = [], 0, block + 1
            return pa.RecordBatch.from_arrays(columns, schema=SHARDS)

        for batch in batches:
            ids, bounds = _raw_ids(batch)
            docs, sizes = batch.column("doc_id"), np.diff(bounds)
            a = 0
            while a < len(docs):  # as many documents as still fit, or one
                e = int(np.searchsorted(bounds, bounds[a] + BLOCK_IDS - total, side="right")) - 1
                if e <= a and held:
                    yield row()
                    continue
                e = max(e, a + 1)
                held.append((docs.slice(a, e - a), sizes[a:e], ids[bounds[a] : bounds[e]]))
                total += int(bounds[e] - bounds[a])
                a = e
        if held:
            yield row()

    return run


SHARDS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("control", pa.binary()), ("data", pa.binary())])


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, cut: str = "space", end_id: int = 2, shards: int | None = None, added: bool = False) -> None:
    """Encode whole texts, append end_id to each, and write them to `folder` in ascending doc_id order.

    added: the tokenizer's added tokens in a text get their ids.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path("byte_bpe_50k.json")
    every = stored(input_bytes(docs).mapInArrow(_encoded(path, cut, end_id, added), "doc_id long, wide boolean, counts boolean, ids binary"), "encoded")
    encoded = every.filter("NOT counts").select("doc_id", "wide", "ids")
    counts = every.filter("counts").select("ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # one row per id in use: bounded by the vocabulary, whatever the corpus
    by_count = sorted(((r.id, r.n) for r in counts.collect()), key=lambda x: (-x[1], x[0]))
    spark.createDataFrame([(k, i) for k, (i, _) in enumerate(by_count)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/vocabulary")
    ranks = np.zeros(max([i for i, _ in by_count], default=0) + 1, np.uint32)
    ranks[[i for i, _ in by_count]] = np.arange(len(by_count))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_blocked(ranks), "shard int, block int, doc_ids array<long>, sizes array<int>, control binary, data binary").write.option("compression", "lz4").parquet(f"{folder}/shards")


def _read(ids: np.ndarray, digest_only: bool):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard, block, docs, sizes, control, data = (batch.column(c)[k] for c in ("shard", "block", "doc_ids", "sizes", "control", "data"))
                sizes = sizes.values.to_numpy().astype(np.int64)
                n, ends = len(sizes), np.cumsum(sizes)
                values = ids[unpack(control.as_buffer(), data.as_buffer(), int(ends[-1]))].astype("<u4")
                raw, at = memoryview(values).cast("B"), np.append(0, ends).tolist()
                crc = [zlib.crc32(raw[4 * at[i] : 4 * at[i + 1]]) for i in range(n)]
                lists = pa.nulls(n, pa.list_(pa.int64())) if digest_only else pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard.as_py(), np.int32)), pa.array(np.full(n, block.as_py(), np.int32)), docs.values, pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64()), lists],
                    names=["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32", "ids"],
                )

    return run


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (null without with_ids)."""
    vocabulary = spark.read.parquet(f"{folder}/vocabulary").orderBy("rank").collect()  # bounded by the vocabulary
    ids = np.array([r.id for r in vocabulary] or [0], np.uint32)
    blocks = spark.read.parquet(f"{folder}/shards")
    docs = blocks.mapInArrow(_read(ids, not with_ids), "shard int, block int, doc_id long, within long, n_tokens long, ids_crc32 long, ids array<long>")
    # one row per block of many documents; totals per shard first, so that no task sees all blocks
    sizes = blocks.select("shard", "block", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    blocks_at = sizes.join(shards, "shard").select("shard", "block", (F.col("before") + F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    return docs.join(blocks_at, ["shard", "block"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
