"""WARC archives as a Python data source.

Writing: every task writes archives of gzip members, one per record, and begins another one when `archive_bytes` are
full. A member's extra field `SL` holds its compressed length, so a reader can pass over a record without inflating it;
other tools ignore that field. Equal payloads are stored once: the smallest page_id is the response, later ones are
revisits that refer to it. Every write leaves a manifest of its own with the files of its successful task attempts, so
a retried task leaves no double records and an append keeps what was there; mode overwrite deletes the older manifests
and their files.

Reading: the split points of all manifests become partitions. Archives of other writers in the folder (`*.warc.gz`,
`*.warc`), or one such file named as the path, are read too, one partition each. Equality and IN predicates on
record_type and the header columns are pushed down. Of each record the headers are parsed first; the payload is inflated
only if it is wanted. Records are read one at a time, whatever the size of a file.

Null html is an empty payload; null urls have no target; a null page_id gets the record id `null` and reads back as
null, and is never referred to. Control characters in urls are percent-encoded. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

#: Compressed bytes of a read partition, about.
SPLIT = 16 << 20
#: Compressed bytes after which a task begins another archive, and bytes read from a file at once.
ARCHIVE, CHUNK = 1 << 30, 1 << 20
#: Our files begin so. Those that no manifest names are of failed attempts.
OURS = "lumenote-"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, http_length long, payload binary"
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload binary"
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, record_type: str, uri: str | None, refers_to: str | None, payload: bytes, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One uncompressed record. A revisit keeps the HTTP header only, with the length of the whole payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in uri))
    if record_type == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(body: bytes, level: int = 6) -> bytes:
    """A gzip member with its own length in the extra field SL."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    deflated = squeeze.compress(body) + squeeze.flush()
    extra = b"SL" + struct.pack("<HII", 8, 24 + len(deflated) + 8, len(body))
    return b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", len(extra)) + extra + deflated + struct.pack("<II", zlib.crc32(body), len(body) & 0xFFFFFFFF)


class Feed:
    """A file read in order, with bytes that were read too far given back."""

    def __init__(self, source, limit: int | None = None):
        self.source, self.left, self.back = source, limit, b""

    def read(self, n: int) -> bytes:
        out, self.back = self.back[:n], self.back[n:]
        if len(out) < n:
            more = n - len(out) if self.left is None else min(n - len(out), self.left)
            got = self.source.read(more) if more else b""
            self.left = None if self.left is None else self.left - len(got)
            out = bytes(got) if not out else out + got
        return out

    def give_back(self, data: bytes) -> None:
        self.back = data + self.back


def members(source) -> Iterator[tuple[bytes, bytes, object]]:
    """For each gzip member its headers, the bytes after them so far, and a function that inflates the rest of the record.

    That function must be called before the next member is asked for. source: bytes or a file.
    """
    feed = source if isinstance(source, Feed) else Feed(io.BytesIO(source) if isinstance(source, bytes) else source)
    while start := feed.read(24):
        size = struct.unpack("<I", start[16:20])[0] if len(start) == 24 and start[3] & 4 and start[12:14] == b"SL" else 0
        inflate = zlib.decompressobj(31)
        if size:
            todo = start + feed.read(size - 24)
            more = lambda: b""
        else:  # another writer's member: only inflating finds its end
            todo = start
            more = lambda: feed.read(CHUNK)
        head = b""
        while True:
            head += inflate.decompress(todo, 2048)
            todo = inflate.unconsumed_tail or (b"" if inflate.eof else more())
            if b"\r\n\r\n" in head or not todo:
                break
        header, _, rest = head.partition(b"\r\n\r\n")
        state = {"todo": todo, "done": False}

        def whole(rest=rest, inflate=inflate, state=state, more=more, keep=True):
            parts, todo, state["done"] = [rest], state["todo"], True
            while todo and not inflate.eof:
                got = inflate.decompress(todo, CHUNK)
                if keep:
                    parts.append(got)
                todo = inflate.unconsumed_tail or (b"" if inflate.eof else more())
            return b"".join(parts)

        yield header, rest, whole
        if not size:
            if not state["done"]:
                whole(keep=False)
            feed.give_back(inflate.unused_data)


def plain_records(source) -> Iterator[tuple[bytes, bytes, object]]:
    """As members(), of an archive that isn't compressed."""
    feed = Feed(source)
    while True:
        head = b""
        while b"\r\n\r\n" not in head and (got := feed.read(2048)):
            head += got
        if not head.strip():
            return
        header, _, rest = head.lstrip(b"\r\n").partition(b"\r\n\r\n")
        feed.give_back(rest)
        left = [int(parse(header).get("content-length", 0))]

        def whole(left=left):
            body, left[0] = feed.read(left[0]), 0
            return body

        yield header, b"", whole
        while left[0] and (got := feed.read(min(left[0], CHUNK))):
            left[0] -= len(got)


def parse(header: bytes) -> dict[str, str]:
    """Header names in lower case to values."""
    found = {}
    for line in header.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class Part(InputPartition):
    name: str
    start: int
    end: int | None


def manifests(store, folder: str) -> dict[str, list[dict]]:
    """The files that each manifest of a folder names, with their split points and sizes."""
    found = {}
    for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if x.base_name.startswith("manifest") and x.base_name.endswith(".json"):
            with store.open_input_stream(x.path) as f:
                found[x.base_name] = json.loads(f.read())
    return found


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, archive_bytes: int):
        self.path, self.overwrite, self.archive_bytes = path, overwrite, archive_bytes

    def write(self, iterator) -> Written:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        files, out = [], None
        try:
            for r in iterator:
                if out is None or files[-1]["size"] >= self.archive_bytes:
                    if out is not None:
                        out.close()
                    files.append({"name": f"{OURS}{uuid.uuid4().hex}.warc.gz", "splits": [0], "size": 0})
                    out = store.open_output_stream(f"{folder}/{files[-1]['name']}", compression=None)
                now = files[-1]
                if now["size"] - now["splits"][-1] >= SPLIT:
                    now["splits"].append(now["size"])
                body = member(record(r.record_id, r.record_type, r.target_uri, r.refers_to, bytes(r.payload or b"")))
                out.write(body)
                now["size"] += len(body)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        older = manifests(store, folder) if self.overwrite else {}
        files = [x for m in messages if m is not None for x in m.files]
        with store.open_output_stream(f"{folder}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())
        for name, gone in older.items():
            store.delete_file(f"{folder}/{name}")
            for x in gone:
                store.delete_file(f"{folder}/{x['name']}")

    def abort(self, messages) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for x in m.files if m is not None else []:
                store.delete_file(f"{folder}/{x['name']}")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads, self.wanted = path, payloads, {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self):
        store, folder = fs.FileSystem.from_uri(self.path)
        if self.path.endswith((".warc.gz", ".warc")):
            return [Part("", 0, None)]
        files = [x for named in manifests(store, folder).values() for x in named]
        parts = [Part(x["name"], a, b) for x in files for a, b in zip(x["splits"], [*x["splits"][1:], x["size"]], strict=True) if b > a]
        others = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(folder)) if x.base_name.endswith((".warc.gz", ".warc")) and not x.base_name.startswith(OURS))
        return parts + [Part(name, 0, None) for name in others]

    def read(self, partition):
        if partition is None:  # an archive without records has no partitions
            return
        store, folder = fs.FileSystem.from_uri(self.path)
        name = f"{folder}/{partition.name}" if partition.name else folder
        with store.open_input_file(name) as f:
            f.seek(partition.start)
            limit = None if partition.end is None else partition.end - partition.start
            buffered = pa.BufferedInputStream(f, CHUNK)
            yield from self._rows(plain_records(buffered) if name.endswith(".warc") else members(Feed(buffered, limit)))

    def _rows(self, records):
        rows, held = [], 0
        for header, rest, whole in records:
            h = parse(header)
            r = {k: h.get(name) for k, name in HEADERS.items()}
            for k in ("record_id", "refers_to"):
                r[k] = r[k].strip("<>") if r[k] is not None else None
            r["payload_digest"] = (r["payload_digest"] or "").removeprefix("sha1:") or None
            if any(r[k] not in values for k, values in self.wanted.items()):
                continue
            want = self.payloads and r["record_type"] == "response"
            block = (whole() if want or b"\r\n\r\n" not in rest else rest)[: int(h.get("content-length", 0))]
            http, _, payload = block.partition(b"\r\n\r\n")
            r["http_length"] = int(parse(http).get("content-length", 0))
            r["payload"] = payload if want else None
            rows.append(r)
            held += len(payload)
            if held > SPLIT or len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in READ_SCHEMA.split(", ")])


class WarcSource(DataSource):
    """spark.read.format("warc").load(path); option payloads=false reads headers only. Registered by register()."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payloads", "true").lower() != "false")

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("archive_bytes", ARCHIVE)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records of pages. Equal payloads of at least `least_bytes` are stored once, by the smallest page_id."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"))
    keys = pages.filter((F.length("payload") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", F.unhex(F.sha1("payload")).alias("sha"))
    first = keys.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = keys.join(first, "sha").filter("page_id > first").select("page_id", "first")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    joined = pages.join(later.hint("shuffle_hash"), "page_id", "left")  # ids only on the hashed side
    kind = F.when(F.col("first").isNull(), "response").otherwise("revisit")
    return joined.select(name(F.col("page_id")).alias("record_id"), kind.alias("record_type"), F.col("url").cast("string").alias("target_uri"), F.when(F.col("first").isNotNull(), name(F.col("first"))).alias("refers_to"), "payload")


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE) -> None:
    """Append the pages' records to the folder, in one archive or more for each partition."""
    register(pages.sparkSession)
    page_records(pages, least_bytes).write.format("warc").mode("append").option("archive_bytes", archive_bytes).save(path)


def _checked(batches):
    """Length and digest of the payloads that were read."""
    for batch in batches:
        bodies = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in bodies], pa.int64()), pa.array([digest(b) for b in bodies])], names=["record_id", "payload_bytes", "payload_digest"])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; responses' are of the payloads read."""
    register(spark)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    full = spark.read.format("warc").load(path).filter("record_type = 'response'").select("record_id", "payload")
    full = full.mapInArrow(_checked, "record_id string, payload_bytes long, payload_digest string").withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("string"))
    again = spark.read.format("warc").option("payloads", "false").load(path).filter("record_type = 'revisit'").select("record_id", F.col("http_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    every = full.unionByName(again)
    return every.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))
