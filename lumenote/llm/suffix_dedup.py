"""Removal of byte strings that occur more than once in the corpus (suffix-array dedup).

Method: threshold-bounded interval expansion. Within a partition of text the suffixes are sorted, the Burrows-Wheeler
transform is taken, and a breadth-first backward extension of its intervals yields common-prefix lengths by increasing
value; it stops at the minimum length, so what has no value yet is a repeat of at least that length.

How the corpus becomes partitions: every window of `min_len` bytes picks an anchor, the rightmost of its smallest
hashed ANCHOR-byte strings. Equal windows pick equal anchors, so windows that share an anchor occurrence form one
region, and regions of equal anchors meet in one task. An anchor that occurs once needs no further work. Regions that
are equal as a whole are counted, not compared. Only regions that occur once but share their anchor go through the
transform. Anchors with very many different regions are compared window by window instead, which spreads them over
all tasks. Whole texts are used; matches never cross documents; a document may repeat itself.

Nulls and empty texts: zero bytes, nothing removed. A repeated row is a copy: each of the two loses what has 200 bytes.
Different texts must have different doc_ids, but for null: rows without one take part by their texts and keep the null.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import BASE_A, BASE_B, U64, PrefixHash, binary_parts, bounded_runs, dropped, input_bytes, named, own_id, released, small_batches, stored, unnamed

ANCHOR = 64
#: Bytes hashed or sorted at once in a task; long texts are cut into overlapping pieces.
PIECE, CHUNK = 1 << 19, 1 << 20
#: An anchor with more different regions than this is compared by windows, not in one task.
HOT_REGIONS = 4096
#: Bytes that go through one transform, about: what fits a core's cache.
COMPARED = 1 << 18
#: A larger interval is extended by searching for each byte, others by going through their places.
MANY = 2048
#: Starts of a hot anchor's windows that are merged at once before they are gathered by document.
MERGED = 1024
SEP = 0xFF  # never a byte of UTF-8


def _anchored(ids: np.ndarray, bases: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_len: int) -> pa.RecordBatch:
    """Regions of adjacent pieces in one buffer."""
    n, w = len(data), min_len - ANCHOR + 1
    valid = np.zeros(n + 1, np.int32)
    ok = ends - starts >= min_len
    np.add.at(valid, starts[ok], 1)
    np.add.at(valid, ends[ok] - min_len + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:n]))
    if not len(at):
        return pa.RecordBatch.from_pylist([], schema=ANCHORED)
    rolling = PrefixHash(data, BASE_A)
    grams = rolling.sliding(ANCHOR)
    m = len(grams)
    low = U64((1 << 24) - 1)
    least = (grams & ~low) | (low - np.arange(m, dtype=U64))
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if w > span:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    least = least[at]
    row = np.searchsorted(ends, at, side="right")
    cut = np.ones(len(at), bool)
    cut[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(cut)
    count = np.diff(np.append(first, len(at)))
    start, row = at[first], row[first]
    anchor = grams[(low - (least[first] & low)).astype(np.int64)]
    region = PrefixHash(data, BASE_B).of(start, start + count + min_len - 1)
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor.view(np.int64)), pa.array(region.view(np.int64)), pa.array(ids[row]), pa.array(bases[row] + start - starts[row]), pa.array(count.astype(np.int32))], schema=ANCHORED
    )


ANCHORED = pa.schema([("anchor", pa.int64()), ("region", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("windows", pa.int32())])


def anchored_regions(min_len: int):
    """Batches of (doc_id, body) to batches of regions."""

    def pieces(batch: pa.RecordBatch):
        data, offsets = binary_parts(batch.column(1))
        ids = batch.column(0).to_numpy()
        held, total = [], 0
        for i in range(len(ids)):
            a, b = int(offsets[i]), int(offsets[i + 1])
            for s in range(a, max(b - min_len + 1, a), PIECE):
                e = min(s + PIECE + min_len - 1, b)
                held.append((ids[i], s - a, s, e))
                total += e - s
                if total >= PIECE:
                    yield data, held
                    held, total = [], 0
        if held:
            yield data, held

    def run(batches):
        for batch in batches:
            for data, held in pieces(batch):
                ids, bases, a, b = (np.array(x, np.int64) for x in zip(*held, strict=True))
                size = b - a
                ends = np.cumsum(size)
                joined = np.concatenate([data[s:e] for s, e in zip(a.tolist(), b.tolist(), strict=True)])
                yield _anchored(ids, bases, joined, ends - size, ends, min_len)

    return run


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by at least their first `depth` bytes (prefix doubling), and the packed first 8 bytes in that order."""
    n = len(text)
    padded = np.concatenate([text, np.full(8, SEP, np.uint8)])
    key = np.zeros(n, U64)
    for j in range(8):
        key |= padded[j : j + n].astype(U64) << U64(56 - 8 * j)
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    rank = np.zeros(n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    k = 8
    while k < depth:
        alone = fresh & np.append(fresh[1:], True)
        slot = np.flatnonzero(~alone)
        if not len(slot):
            break
        sub = sa[slot]
        own, nxt = rank[sub], rank[np.minimum(sub + k, n)]
        by = (own << 32) | nxt
        order = np.argsort(by)
        sub, by = sub[order], by[order]
        sa[slot] = sub
        differs = np.ones(len(slot), bool)
        differs[1:] = by[1:] != by[:-1]
        fresh[slot[differs]] = True
        rank[sub] = slot[np.maximum.accumulate(np.where(differs, np.arange(len(slot)), 0))]
        k *= 2
    return sa, key


def repeated_starts(text: np.ndarray, min_len: int) -> np.ndarray:
    """Whether the `min_len` bytes from each place of `text` occur twice; places with a separator in them don't count.

    `text` is a run of strings that each end in SEP. Levels of the expansion: an interval of the transform stands for
    one string; extending it to the left by each byte gives the intervals one byte longer. The place behind such an
    interval, if it has no value yet, gets the level as its common-prefix length, and only then is the interval kept.
    """
    n = len(text)
    sa, key = suffix_order(text, min_len)
    bwt = text[sa - 1]
    order = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[order] = np.arange(n)
    first_byte = bwt[order]
    by_byte = first_byte.astype(np.int64) * n + order  # sorted: rank queries are binary searches
    alphabet = [c for c in np.unique(bwt).tolist() if c != SEP]
    # the first eight levels follow from the packed bytes
    lcp = np.full(n + 1, -1, np.int16)
    lcp[0] = lcp[n] = 0
    differ = key[1:] ^ key[:-1]
    at = np.flatnonzero(differ)
    same = np.zeros(len(at), np.int16)
    for j in range(1, 8):
        same += (differ[at] >> U64(64 - 8 * j)) == 0
    lcp[at + 1] = same
    begins = np.append(0, at + 1)
    behind = np.append(at + 1, n)
    keep = (lcp[behind] == 7) & (behind < n)
    lb, rb = begins[keep], behind[keep] - 1
    for level in range(8, min_len):
        if not len(lb):
            break
        size = rb - lb + 1
        large = size > MANY
        new_lb, new_rb = [], []
        if large.any():
            for c in alphabet:
                a = np.searchsorted(by_byte, c * n + lb[large])
                b = np.searchsorted(by_byte, c * n + rb[large], side="right") - 1
                some = (b >= a) & (lcp[b + 1] < 0)
                new_lb.append(a[some])
                new_rb.append(b[some])
        small = ~large
        s = size[small]
        if len(s):
            each = np.repeat(np.arange(len(s)), s)
            place = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + lb[small][each]
            to = lf[place]
            c = bwt[place]
            follow = np.minimum(to + 1, n - 1)
            more = (to + 1 < n) & (first_byte[follow] == c) & (order[follow] <= rb[small][each])
            last = np.flatnonzero(~more & (lcp[to + 1] < 0) & (c != SEP))
            new_rb.append(to[last])
            new_lb.append(np.searchsorted(by_byte, c[last].astype(np.int64) * n + lb[small][each[last]]))
        lb, rb = np.concatenate(new_lb), np.concatenate(new_rb)
        lcp[rb + 1] = level
    twin = lcp < 0
    found = np.zeros(n, bool)
    found[sa] = twin[:n] | twin[1:]
    ends = np.flatnonzero(text == SEP)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    return found & (left >= min_len)


def _compared(min_len: int):
    """Regions sorted by anchor to the byte ranges of their repeated windows; a few anchors at a time."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        data, offsets = binary_parts(rows.column("body").combine_chunks())
        size = np.diff(offsets)
        ends = np.cumsum(size + 1)
        text = np.full(int(ends[-1]), SEP, np.uint8)
        starts = ends - size - 1
        for s, a, b in zip(starts.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            text[s : s + b - a] = data[a:b]
        hit = np.flatnonzero(repeated_starts(text, min_len))
        row = np.searchsorted(ends, hit, side="right")
        cut = np.ones(len(hit), bool)
        cut[1:] = (np.diff(hit) > 1) | (row[1:] != row[:-1])
        a = np.flatnonzero(cut)
        b = np.append(a[1:], len(hit)) - 1 if len(hit) else a
        row = row[a]
        base = rows.column("start").to_numpy()[row] - starts[row]
        out = pa.RecordBatch.from_arrays([pa.array(rows.column("doc_id").to_numpy()[row]), pa.array(base + hit[a]), pa.array(base + hit[b] + min_len)], names=["doc_id", "a", "b"])
        return out.filter(pa.array(rows.column("once").to_numpy(zero_copy_only=False)[row]))

    def run(batches):
        held, total = [], 0
        for batch in batches:
            anchors = batch.column(0).to_numpy()
            step, begin = np.cumsum(np.diff(binary_parts(batch.column(4))[1])), 0
            edges = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            if held and len(anchors) and held[-1].column(0)[-1].as_py() != anchors[0]:
                edges = np.append(0, edges)
            for e in edges.tolist():
                size = int(step[e - 1]) - (int(step[begin - 1]) if begin else 0) if e else 0
                if total + size >= COMPARED:
                    if e > begin:
                        held.append(batch.slice(begin, e - begin))
                    yield solve(pa.Table.from_batches(held))
                    held, total, begin = [], 0, e
            if begin < len(anchors):
                held.append(batch.slice(begin))
                total += int(step[-1]) - (int(step[begin - 1]) if begin else 0)
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _cut_out(batches):
    """(doc_id, start, windows, ..., body with the text) to the regions' own bytes."""
    for batch in batches:
        data, offsets = binary_parts(batch.column("body"))
        regions = batch.column("regions")
        row = np.repeat(np.arange(batch.num_rows), np.diff(regions.offsets.to_numpy()))
        regions = regions.flatten()
        docs, size = batch.column("doc_id").to_numpy()[row], regions.field("size").to_numpy().astype(np.int64)
        begin = offsets[row] + regions.field("start").to_numpy()
        for s, e in bounded_runs(size, CHUNK):
            ends = np.cumsum(size[s:e])
            body = data[np.arange(ends[-1]) + np.repeat(begin[s:e] - ends + size[s:e], size[s:e])]
            column = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(body)])
            anchor, start, windows, once, hot = (regions.field(k).slice(s, e - s) for k in ("anchor", "start", "windows", "once", "hot"))
            yield pa.RecordBatch.from_arrays([anchor, pa.array(docs[s:e]), start, windows, once, hot, column], names=["anchor", "doc_id", "start", "windows", "once", "hot", "body"])


def _windows(min_len: int):
    """The windows of a hot anchor's regions, each as a 128-bit hash."""

    def run(batches):
        for batch in batches:
            data, offsets = binary_parts(batch.column("body"))
            docs, starts, once = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "start", "once"))
            size = np.diff(offsets)
            for s, e in bounded_runs(size, CHUNK >> 2):
                body = data[offsets[s] : offsets[e]]
                n = size[s:e] - (min_len - 1)
                row = np.repeat(np.arange(s, e), n)
                within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = offsets[row] - offsets[s] + within
                a, b = (PrefixHash(body, base).sliding(min_len)[at].view(np.int64) for base in (BASE_A, BASE_B))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(docs[row]), pa.array(starts[row] + within), pa.array(once[row])], names=["ha", "hb", "doc_id", "start", "once"])

    return run


def repeated_ranges(docs: DataFrame, min_len: int = 200) -> DataFrame:
    """doc_id, a, b: byte ranges made of windows that occur elsewhere too, stored. Ranges of a document may overlap.

    Rows without a doc_id have the number of shared.own_id.
    """
    small_batches(docs.sparkSession)
    bodies = input_bytes(named(docs))
    regions = stored(bodies.mapInArrow(released(anchored_regions(min_len)), "anchor long, region long, doc_id long, start long, windows int"), "regions")
    # Counts are aggregated before they are shuffled, and stored before they are joined: so the join with a frequent anchor
    # or region has two plain shuffles, whose skewed partitions Spark splits. A region meets what is known of it and of its
    # anchor in one join with a row a region, so no row becomes two.
    place = F.xxhash64("doc_id", "start")
    kinds = stored(regions.groupBy("anchor", "region").agg(F.count("*").alias("same"), F.min(place).alias("pick")), "kinds")
    anchors = stored(kinds.groupBy("anchor").agg(F.sum("same").alias("n"), F.count("*").alias("kinds")).filter("n > 1").select("anchor", "kinds"), "anchors")
    # one row per anchor, then per region, on the hashed side, whatever the skew
    known = stored(kinds.join(anchors.hint("shuffle_hash"), "anchor").select("anchor", "region", "same", "pick", (F.col("kinds") > 1).alias("mixed"), (F.col("kinds") > HOT_REGIONS).alias("hot")), "known")
    dropped(kinds, anchors)
    shared = regions.join(known.hint("shuffle_hash"), ["anchor", "region"])
    shared = stored(shared.select("anchor", "doc_id", "start", "windows", "mixed", "hot", "same", (place == F.col("pick")).alias("first")), "shared")
    dropped(regions, known)
    end = F.col("start") + F.col("windows") + (min_len - 1)
    whole = shared.filter("same > 1").select("doc_id", F.col("start").alias("a"), end.alias("b"))
    unlike = shared.filter("mixed AND first")
    region = F.struct("anchor", "start", "windows", (F.col("same") == 1).alias("once"), "hot", (F.col("windows") + (min_len - 1)).alias("size"))
    cut = unlike.groupBy("doc_id").agg(F.collect_list(region).alias("regions")).join(bodies, "doc_id").select("doc_id", "regions", "body")
    cut = stored(cut.mapInArrow(released(_cut_out), "anchor long, doc_id long, start long, windows int, once boolean, hot boolean, body binary"), "unlike")
    found = cut.filter("not hot").select("anchor", "doc_id", "start", "once", "body").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(released(_compared(min_len)), "doc_id long, a long, b long")
    windows = cut.filter("hot").mapInArrow(released(_windows(min_len)), "ha long, hb long, doc_id long, start long, once boolean")
    twice = stored(windows.groupBy("ha", "hb").agg(F.count("*").alias("n")).filter("n > 1").select("ha", "hb"), "twice")
    again = windows.filter("once").join(twice, ["ha", "hb"], "left_semi").groupBy("doc_id", F.floor(F.col("start") / MERGED).alias("stretch"))
    again = again.agg(F.min("start").alias("low"), F.max("start").alias("high"), F.collect_list("start").alias("starts"))  # at most MERGED starts
    span = lambda a, b: F.struct(a.alias("a"), (b + min_len).alias("b"))
    whole_stretch = F.size("starts") == F.col("high") - F.col("low") + 1
    spans = F.when(whole_stretch, F.array(span(F.col("low"), F.col("high")))).otherwise(F.transform("starts", lambda x: span(x, x)))
    merged = again.select("doc_id", F.explode(spans).alias("r")).select("doc_id", "r.a", "r.b")
    ranges = stored(whole.unionByName(found).unionByName(merged), "ranges")
    dropped(shared, cut, twice)
    return ranges


def _kept(text_too: bool, rows_too: bool = False):
    """(doc_id, body, ranges) to what suffix_dedup returns. rows_too: the text as bytes, and a column `row` handed on."""

    def text(body: np.ndarray, left: bytes):
        if rows_too:
            return left if len(left) == len(body) else left.decode("utf-8", "ignore").encode()
        return left.decode("utf-8", "ignore") if text_too else None

    def run(batches):
        for batch in batches:
            data, offsets = binary_parts(batch.column("body"))
            ranges = batch.column("ranges")
            bound = np.cumsum(np.append(0, pc.fill_null(pc.list_value_length(ranges), 0).to_numpy(zero_copy_only=False)))
            a, b = (ranges.flatten().field(k).to_numpy() for k in ("a", "b"))
            rows = []
            for i in range(batch.num_rows):
                body, own = data[offsets[i] : offsets[i + 1]], slice(int(bound[i]), int(bound[i + 1]))
                if own.start == own.stop:
                    gone = np.zeros(len(body), bool)
                else:
                    mark = np.zeros(len(body) + 1, np.int32)
                    np.add.at(mark, a[own], 1)
                    np.add.at(mark, b[own], -1)
                    gone = np.cumsum(mark[:-1]) > 0
                left = body[~gone].tobytes()
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(body), int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), text(body, left)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary() if rows_too else pa.string()]
            row = {"row": batch.column("row")} if rows_too else {}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True)), *row.values()], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *row])

    return run


#: Columns of a document's result.
COUNTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _by_document(docs: DataFrame, min_len: int) -> DataFrame:
    if min_len < ANCHOR + 8:
        raise ValueError(f"min_len must be at least {ANCHOR + 8}")
    return repeated_ranges(docs, min_len).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def suffix_dedup(docs: DataFrame, min_len: int = 200, with_text: bool = False, stand_ins: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining text where with_text is set, else null).

    Every byte of a `min_len`-byte string that also starts elsewhere goes, judged on the input. A character cut in two
    by a removed range loses its remaining bytes in `kept`, but not in kept_sha256. stand_ins: rows without a doc_id have
    the number of shared.own_id.
    """
    joined = input_bytes(named(docs)).join(_by_document(docs, min_len), "doc_id", "left").select("doc_id", "body", "ranges")
    found = joined.mapInArrow(released(_kept(with_text)), f"{COUNTS}, kept string")
    return found if stand_ins else unnamed(found, "doc_id")


def texts_left(docs: DataFrame, min_len: int = 200) -> DataFrame:
    """row, text, n_bytes, n_removed for each row: its other columns as a struct, what suffix_dedup leaves of its text.

    A row meets its ranges once and needs no join with the result.
    """
    others = F.struct(*[c for c in docs.columns if c != "text"])
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(own_id().alias("doc_id"), body.alias("body"), F.struct(others.alias("row"), F.col("text").isNull().alias("none")).alias("row"))
    joined = rows.join(_by_document(docs, min_len), "doc_id", "left").select("doc_id", "body", "ranges", "row")
    schema = StructType.fromDDL(f"{COUNTS}, kept binary").add(joined.schema["row"])
    found = joined.mapInArrow(released(_kept(True, rows_too=True)), schema)
    return found.select("row.row", F.when(~F.col("row.none"), F.col("kept").cast("string")).alias("text"), "n_bytes", "n_removed")
