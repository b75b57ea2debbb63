"""Exact self-join of documents on the Jaccard similarity of their word n-gram sets, by vertical partitioning.

The n-grams' 64-bit hashes are their global order. The order is cut into as many fragments as two linked sets of a size
class can differ in n-grams, and some more; so two linked sets agree in a whole fragment, and sets that agree in one
become candidates of each other. Candidates are then compared together: within each fragment of the order the partial
overlaps of all their pairs are counted as a matrix product, and the counts are summed per pair.

* Equal sets are folded first; copies are never compared, and a task sends a set's keys once however many copies it has.
* No pair is ever a row. A fragment's sets are tied to the first of them; connected candidates meet in blocks of at most
  BLOCK sets and BLOCK_GRAMS n-grams (a longer set has one of its own). A large cluster is dealt by set size, and only
  blocks whose sizes allow a link meet. A pair of blocks returns one row per set: one set it is linked with (or itself)
  and how many documents it is linked with there.
* Blocks get sorted n-gram hashes, not texts. A cluster that does not fit one block meets by sketches first, in which two
  linked sets cannot differ by more than in n-grams; only sets that are near by those get n-grams, in clusters of their own.
* What is compared grows with the square of a cluster of candidates only, that is of sets which share whole fragments;
  sketches are copied for it, an eighth to a sixteenth of the n-grams, and n-grams for the clusters of near sets.

Texts without words (null, empty, blank) have the empty set and no links. Ties cannot occur: a class takes its smallest
doc_id. A repeated row is a copy: it is returned once more and counts as a link. Different texts must have different
doc_ids, but for null: rows without a doc_id take part by their texts, and a class of such rows only has a null
component_id. Other columns are ignored; an empty table gives an empty result. Words are hashed by mixing their bytes in
eight at a time (long ones by BLAKE2).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import U64, binary_parts, bounded_runs, dropped, input_bytes, mix, named, released, small_batches, stored, unnamed, word_hashes, word_spans

BATCH = 1 << 18
BLOCK, BLOCK_GRAMS = 1024, 1 << 19
#: The same for blocks of sketches.
SKETCHES, SKETCH_GRAMS = 8192, 1 << 22
#: Sets up to this number travel with the tasks that read their texts; texts are shuffled to more.
MOST_SENT = 1 << 19
#: Sets of a large cluster whose sizes differ by less than this factor share blocks.
SIZE_STEP = 1.1
#: The side of the rows of a block that meets itself; otherwise 0 and 1.
BOTH = 2
#: Columns of one matrix product.
FRAGMENT = 2048
#: Rounds in which sets that share too few fragments are left out before candidates are compared.
PEEL = 2
SPREAD = [0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's word n-grams. Rows are adjacent in data; A-Z count as a-z."""
    begin, end = int(offsets[0]), int(offsets[-1])
    body = data[begin:end].copy()
    upper = (body >= 65) & (body <= 90)
    body[upper] += 32
    starts, ends = offsets[:-1] - begin, offsets[1:] - begin
    a, b, row = word_spans(body, starts, ends)
    if not len(a):
        return [np.zeros(0, U64)] * len(starts)
    word = word_hashes(body, a, b)
    gram = np.zeros(len(word), U64)
    for j in range(min(words, len(word))):
        gram[: len(word) - j] += mix(word[j:] ^ U64(SPREAD[j % 5] + j))
    gram = mix(gram)
    bounds = np.searchsorted(row, np.arange(len(starts) + 1))
    out = []
    for i in range(len(starts)):
        s, e = int(bounds[i]), int(bounds[i + 1])
        if e - s >= words:
            out.append(np.unique(gram[s : e - words + 1]))
        elif e > s:  # fewer words: the whole sequence is the one n-gram
            x = U64(e - s)
            for w in word[s:e]:
                x = mix(np.array([x ^ w], U64))[0]
            out.append(np.array([x], U64))
        else:
            out.append(np.zeros(0, U64))
    return out


def most_different(total: int, percent: int) -> int:
    """The most n-grams in which two sets of together `total` can differ if linked: 100 I >= percent U, I + U = total."""
    return (100 - percent) * total // (100 + percent)


def size_class(n: int, percent: int) -> tuple[int, int]:
    """Number and largest size of the class of a set size. A linked pair's sizes fall in one class or in two adjacent ones."""
    low, k = 1, 0
    while True:
        high = 100 * low // percent
        if n <= high:
            return k, high
        low, k = high + 1, k + 1


def fragments(high: int, percent: int) -> tuple[int, int, int]:
    """Fragments for a class; how many may be empty in a set before its empty ones count too; how many that count two
    linked sets agree in at least."""
    differ = most_different(2 * high, percent)
    if not differ:
        return 0, 0, 0
    empty, more = 2 + differ // 16, 1 + differ // 6
    return differ + empty + more, empty, more


def key_classes(n: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Class number and fragments() of the class of a set size, and of the next larger class."""
    k, high = size_class(n, percent)
    return [(k, *fragments(high, percent)), (k + 1, *fragments(100 * (high + 1) // percent, percent))]


def fragment_keys(grams: np.ndarray, percent: int, known: dict) -> np.ndarray:
    """A key for each fragment of the set, for its class and the next larger one, equal for equal fragments only; its
    lowest bit is the class number's."""
    n = len(grams)
    if n not in known:
        known[n] = key_classes(n, percent)
    keys = []
    inner = mix(grams ^ U64(SPREAD[1]))
    for k, count, spare, _ in known[n]:
        if not count:
            continue
        part = ((grams >> U64(32)) * U64(count) >> U64(32)).astype(np.int64)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        total = np.add.reduceat(inner, first)
        own = [mix(total ^ mix(part[first].astype(U64) * U64(SPREAD[0]) + U64(k)))]
        if count - len(first) > spare:
            empty = np.setdiff1d(np.arange(count), part[first]).astype(U64)
            own.append(mix(U64(SPREAD[2]) ^ mix(empty * U64(SPREAD[0]) + U64(k))))
        keys += [x & ~U64(1) | U64(k & 1) for x in own]
    return np.concatenate(keys) if keys else np.zeros(0, U64)


def identity(grams: np.ndarray) -> int:
    """64-bit hash of a set, equal for equal sets."""
    return int(mix(np.array([mix(grams).sum(dtype=U64) ^ U64(len(grams))], U64)).view(np.int64)[0])


def sketch(grams: np.ndarray) -> bytes:
    """How many of the set's n-grams lie in each of 2^k equal parts of the order, 255 at most; a quarter to half as many
    parts as n-grams, 16 at least."""
    bits = max(4, (len(grams) - 1).bit_length() - 2)
    counts = np.bincount((grams >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() if len(grams) else b""


def folded(sketches: list[np.ndarray]) -> np.ndarray:
    """The sketches with the parts of the coarsest, as bits: a part has as many as n-grams, eight at most."""
    parts = min(map(len, sketches))
    counts = np.array([np.minimum(x.reshape(parts, -1).sum(axis=1), 8) for x in sketches])
    return ((1 << counts) - 1).astype(np.uint8).view(U64)


def _described(words: int):
    """(doc_id, body) to doc_id, set size, set identity, sketch."""

    def run(batches):
        for batch in batches:
            data, offsets = binary_parts(batch.column(1))
            for s, e in bounded_runs(np.diff(offsets), BATCH):
                sets = shingle_sets(data, offsets[s : e + 1], words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array([len(g) for g in sets], pa.int64()), pa.array([identity(g) for g in sets], pa.int64()), pa.array([sketch(g) for g in sets], pa.binary())], names=["doc_id", "n_shingles", "own", "sketch"])

    return run


def _keyed(words: int, percent: int):
    """(body) to (fragment key, set identity); a task gives a set's keys once."""

    def run(batches):
        known: dict = {}
        sent: set[int] = set()
        for batch in batches:
            data, offsets = binary_parts(batch.column(0))
            for s, e in bounded_runs(np.diff(offsets), BATCH):
                keys, owns = [], []
                for g in shingle_sets(data, offsets[s : e + 1], words):
                    own = identity(g)
                    if len(g) and own not in sent:
                        sent.add(own)
                        keys.append(fragment_keys(g, percent, known))
                        owns.append(np.full(len(keys[-1]), own))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owns))], names=["key", "own"])

    return run


def _needs(percent: int):
    """(own, n_shingles) to own and, for either lowest bit of its keys, how many of them a linked set shares at least."""

    def run(batches):
        for batch in batches:
            both = [[0, 0] for _ in range(batch.num_rows)]
            for need, n in zip(both, batch.column(1).to_pylist(), strict=True):
                for k, _, _, more in key_classes(n, percent):
                    need[k & 1] = more
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[bit] for x in both], pa.int32()) for bit in (0, 1))], names=["own", "need_0", "need_1"])

    return run


def _shared(batches):
    """Of rows (key, own) sorted by both, the distinct ones whose key several sets have; runs may span batches."""
    held = None  # the first set of the current run, not given yet
    key0 = last0 = None
    for batch in batches:
        key, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        new = np.append(key0 is None or key[0] != key0, key[1:] != key[:-1])
        before = np.append(last0 if last0 is not None else 0, own[:-1])
        fresh = new | (own != before)  # not a copy of the row before
        later = np.flatnonzero(fresh & ~new)
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))[later]
        heads = np.unique(head[head >= 0])
        out_key, out_own = np.concatenate([key[heads], key[later]]), np.concatenate([own[heads], own[later]])
        if held is not None and (head < 0).any():
            out_key, out_own = np.append(out_key, key0), np.append(out_own, held)
            held = None
        if new.any():
            start = int(np.flatnonzero(new)[-1])
            held = None if start in heads else own[start]
        key0, last0 = key[-1], own[-1]
        if len(out_key):
            yield pa.RecordBatch.from_arrays([pa.array(out_key), pa.array(out_own)], names=["key", "own"])


def _tied(batches):
    """Rows (key, own) sorted by both to (own, first own of its key) for keys of several sets; runs may span batches."""
    key0 = first0 = last0 = None
    for batch in batches:
        key, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        new = np.append(key0 is None or key[0] != key0, key[1:] != key[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(head >= 0, own[np.maximum(head, 0)], first0 if first0 is not None else 0)
        before = np.append(last0 if last0 is not None else 0, own[:-1])
        tie = ~new & (own != before) & (own != first)
        key0, first0, last0 = key[-1], first[-1], own[-1]
        if tie.any():
            yield pa.RecordBatch.from_arrays([pa.array(own[tie]), pa.array(first[tie])], names=["a", "b"])


def _columns(sets: list[np.ndarray], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column and row of each n-gram of the sets that is among the columns, by ascending column."""
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(g) for g in sets])
    at = np.searchsorted(columns, every)
    hit = np.flatnonzero(columns[np.minimum(at, len(columns) - 1)] == every)
    hit = hit[np.argsort(at[hit], kind="stable")]
    return at[hit], row[hit]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of each left with each right set: partial counts by fragments of the n-gram order, summed."""
    same = left is right
    if same:
        every, counts = np.unique(np.concatenate(left), return_counts=True)
        columns = every[counts > 1]
    else:
        columns = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    total = np.zeros((len(left), len(right)), np.float32)
    if not len(columns):
        return total.astype(np.int64)
    sides = [(len(sets), *_columns(sets, columns)) for sets in ([left] if same else [left, right])]
    for c in range(0, len(columns), FRAGMENT):
        width = min(FRAGMENT, len(columns) - c)
        parts = []
        for n, column, row in sides:
            a, b = np.searchsorted(column, [c, c + width])
            m = np.zeros((n, width), np.float32)
            m[row[a:b], column[a:b] - c] = 1
            parts.append(m)
        total += parts[0] @ parts[-1].T
    return total.astype(np.int64)


def _grams(words: int):
    """(..., body) to the same columns with the body's sorted n-gram hashes in its place."""

    def run(batches):
        for batch in batches:
            data, offsets = binary_parts(batch.column(batch.num_columns - 1))
            for s, e in bounded_runs(np.diff(offsets), BATCH):
                sets = shingle_sets(data, offsets[s : e + 1], words)
                rest = [batch.column(k).slice(s, e - s) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([g.tobytes() for g in sets], pa.binary())], names=[*batch.schema.names[:-1], "grams"])

    return run


def _met(solve):
    """Rows (pair, side, own, a number, bytes) sorted by block pair, side and own to solve() of those columns for each pair."""

    def solved(held):
        side, own, number, body = zip(*held, strict=True)
        return solve(np.array(own), np.array(side), np.array(number), body)

    def run(batches):
        held, now = [], None
        for batch in batches:
            pair, side, own, number = (batch.column(k).to_numpy() for k in range(4))
            data, offsets = binary_parts(batch.column(4))
            for k in range(len(own)):
                if pair[k] != now and held:
                    if (out := solved(held)) is not None:
                        yield out
                    held = []
                now = pair[k]
                if held and held[-1][:2] == (side[k], own[k]):
                    continue  # a repeated row of the document that stands for the set
                held.append((side[k], own[k], number[k], data[offsets[k] : offsets[k + 1]].tobytes()))
        if held and (out := solved(held)) is not None:
            yield out

    return run


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of either side. Rows of side BOTH are compared among themselves."""
    return (np.arange(len(side)),) * 2 if side[0] == BOTH else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))


def _near(percent: int):
    """Sets (their sizes, their sketches) of a pair of blocks to (own, a set it is tied with): sets are tied whose sizes and
    sketches do not rule out a link."""

    def solve(own, side, size, sketches):
        l, r = _sides(side)
        if not len(l) or not len(r):
            return None
        bits, size = folded([np.frombuffer(x, np.uint8) for x in sketches]), size.astype(np.int64)
        right, sizes = bits[r], size[r]
        label = np.arange(len(own))
        for k, i in enumerate(l.tolist()):
            first = k + 1 if l is r else 0
            apart = np.bitwise_count(bits[i] ^ right[first:]).sum(axis=1)
            near = apart <= (100 - percent) * (size[i] + sizes[first:]) // (100 + percent)
            near &= 100 * np.minimum(size[i], sizes[first:]) >= percent * np.maximum(size[i], sizes[first:])
            if near.any():
                tied = np.unique(np.append(label[r[first:][near]], label[i]))
                if len(tied) > 1:
                    label[np.isin(label, tied)] = tied[0]
        some = label != np.arange(len(own))
        return pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(own[label[some]])], names=["a", "b"]) if some.any() else None

    return _met(solve)


def _linked(percent: int):
    """Sets (their copies, their n-grams) of a pair of blocks to one row each: own, a set it is tied with, linked documents."""

    def solve(own, side, copies, grams):
        l, r = _sides(side)
        if not len(l) or not len(r):
            return None
        sets = [np.frombuffer(x, U64) for x in grams]
        square = l is r
        left = [sets[i] for i in l]
        both = overlaps(left, left if square else [sets[i] for i in r])
        size = np.array([len(g) for g in sets], np.int64)
        link = 100 * both >= percent * (size[l][:, None] + size[r][None, :] - both)
        if square:
            np.fill_diagonal(link, False)
        degree = np.zeros(len(own), np.int64)
        np.add.at(degree, l, link @ copies[r])
        if not square:
            np.add.at(degree, r, link.T @ copies[l])
        label = np.arange(len(own))
        while True:  # smallest place reachable within the pair of blocks
            was = label.copy()
            most = len(own)
            np.minimum.at(label, l, np.where(link, label[r][None, :], most).min(axis=1))
            np.minimum.at(label, r, np.where(link, label[l][:, None], most).min(axis=0))
            if (was == label).all():
                break
        some = degree > 0
        return pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(own[label[some]]), pa.array(degree[some])], names=["a", "b", "n_links"])

    return _met(solve)


def _single():
    """Whether a cluster of candidates fits one block of n-grams."""
    return (F.count("*") <= BLOCK) & (F.sum("n_shingles") <= BLOCK_GRAMS)


def block_pairs(members: DataFrame, percent: int, most: int, most_grams: int, single=_single) -> tuple[DataFrame, DataFrame]:
    """members (own, n_shingles, label, ...) with their `block`, and the pairs (label, i, j) of blocks to compare.

    A block is a struct (step, nth): a cluster that is `single` is one; others are dealt by set size in steps of
    SIZE_STEP, and by hash within a step. Two blocks meet if a set of one can be linked with one of the other by size.
    """
    clusters = members.groupBy("label").agg(single().alias("single"))
    step = F.when(F.col("single"), F.lit(0)).otherwise(F.floor(F.log(SIZE_STEP, "n_shingles")).cast("int"))
    members = stored(members.join(clusters, "label").withColumn("step", step).drop("single"), "members")
    steps = members.groupBy("label", "step").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("grams"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    steps = stored(steps.select("label", "step", "low", "high", F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("grams") / most_grams)).cast("int").alias("parts")), "steps")
    nth = F.pmod(F.xxhash64("own", F.lit(7)), F.col("parts")).cast("int")
    placed = members.join(steps.select("label", "step", "parts"), ["label", "step"]).withColumn("block", F.struct("step", nth.alias("nth"))).drop("step", "parts")
    one = steps.select("label", "high", "step", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("nth")).select("label", "high", F.struct("step", "nth").alias("i"))
    two = steps.select("label", "low", "step", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("nth")).select("label", "low", F.struct("step", "nth").alias("j"))
    pairs = one.join(two, "label").filter((F.col("i") <= F.col("j")) & (100 * F.col("high") >= percent * F.col("low")))
    return placed, stored(pairs.select("label", "i", "j", F.xxhash64("label", "i", "j").alias("pair")), "pairs")


def met(blocks: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    """pair, side, own and the columns of the sets of each pair of blocks, in tasks by pair."""
    same = F.col("i") == F.col("j")
    one = pairs.select("label", F.col("i").alias("block"), "pair", F.when(same, BOTH).otherwise(0).alias("side"))
    two = pairs.filter(~same).select("label", F.col("j").alias("block"), "pair", F.lit(1).alias("side"))
    return blocks.join(one.unionByName(two), ["label", "block"]).select("pair", "side", "own", *columns).repartition("pair").sortWithinPartitions("pair", "side", "own")


def narrowed(members: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """members (own, doc_id, n_shingles, label, ...) in smaller clusters: those that do not fit one block meet by sketches,
    and sets that are near no other one go."""
    members = stored(members.join(members.groupBy("label").agg(_single().alias("fits")), "label"), "candidates")
    small, large = members.filter("fits").drop("fits"), members.filter("NOT fits").drop("fits")
    if large.isEmpty():
        return small
    placed, pairs = block_pairs(large, percent, SKETCHES, SKETCH_GRAMS, lambda: F.lit(False))
    sketches = placed.join(described.select("doc_id", "own", "sketch"), ["doc_id", "own"])
    near = met(sketches, pairs, "n_shingles", "sketch").mapInArrow(released(_near(percent)), "a long, b long")
    ties = stored(near.distinct(), "ties")
    clusters = components(ties).withColumnRenamed("node", "own")
    dropped(ties, pairs)
    return small.unionByName(large.drop("label").join(clusters, "own"))


def _first_of_copies(bodies: DataFrame, described: DataFrame, sets: DataFrame) -> DataFrame:
    """The bodies without those of documents that another one stands for, where that takes less than their keys do."""
    copies = described.join(sets.select("own", F.col("doc_id").alias("first")), "own").filter("doc_id != first").select("doc_id").distinct()
    copies = stored(copies, "copies")
    n = copies.count()
    if n <= MOST_SENT:
        return bodies.join(F.broadcast(copies), "doc_id", "left_anti")
    # a text in a shuffle takes half of what its keys take
    return bodies.join(copies.hint("shuffle_hash"), "doc_id", "left_anti") if n > sets.count() else bodies


def ngram_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links. Two documents link when 100 * intersection >= percent * union.

    component_id is the smallest doc_id reachable by links, the document's own included; n_links counts the documents
    linked with it directly, copies included.
    """
    small_batches(docs.sparkSession)
    bodies = input_bytes(named(docs))
    described = stored(bodies.mapInArrow(released(_described(words)), "doc_id long, n_shingles long, own long, sketch binary"), "described")
    sets = stored(described.filter("n_shingles > 0").groupBy("own").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("copies")), "folded")
    keyed = _first_of_copies(bodies, described, sets).select("body").mapInArrow(released(_keyed(words, percent)), "key long, own long")
    needed = sets.select("own", "n_shingles").mapInArrow(_needs(percent), "own long, need_0 int, need_1 int")
    by_key = lambda df: df.repartition("key").sortWithinPartitions("key", "own")
    shared = stored(by_key(keyed).mapInArrow(_shared, "key long, own long"), "shared")
    for _ in range(PEEL):
        bit = F.col("key").bitwiseAND(F.lit(1))
        counts = shared.groupBy("own").agg(F.count_if(bit == 0).alias("n_0"), F.count_if(bit == 1).alias("n_1")).join(needed, "own")
        enough = counts.select("own", ((F.col("n_0") >= F.col("need_0")) & (F.col("need_0") > 0)).alias("ok_0"), ((F.col("n_1") >= F.col("need_1")) & (F.col("need_1") > 0)).alias("ok_1")).filter("ok_0 OR ok_1")
        left = shared.join(enough, "own").filter(F.when(bit == 0, F.col("ok_0")).otherwise(F.col("ok_1"))).select("key", "own")
        before, shared = shared, stored(by_key(left).mapInArrow(_shared, "key long, own long"), "shared")
        dropped(before)
    ties = stored(by_key(shared).mapInArrow(_tied, "a long, b long").distinct(), "ties")
    dropped(shared)
    clusters = components(ties)
    dropped(ties)
    members = narrowed(sets.join(clusters.withColumnRenamed("node", "own"), "own"), described, percent)
    members, pairs = block_pairs(members, percent, BLOCK, BLOCK_GRAMS)
    members = members.select("doc_id", "label", "block", "own", "copies")
    # the hashed side has no texts, so texts are shuffled but not sorted
    members = F.broadcast(members) if members.count() <= MOST_SENT else members.hint("shuffle_hash")
    texts = bodies.join(members, "doc_id").select("label", "block", "own", "copies", "body")
    grams = stored(texts.mapInArrow(released(_grams(words)), "label long, block struct<step:int,nth:int>, own long, copies long, grams binary"), "grams")
    linked = met(grams, pairs, "copies", "grams").mapInArrow(released(_linked(percent)), "a long, b long, n_links long")
    linked = stored(linked, "links")
    dropped(grams, pairs)
    classes = components(linked.select("a", "b").filter("a != b")).withColumnRenamed("node", "own")
    degree = linked.groupBy(F.col("a").alias("own")).agg(F.sum("n_links").alias("n_links"))
    sets = sets.join(classes, "own", "left").join(degree, "own", "left").withColumn("label", F.coalesce("label", "own"))
    least = sets.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    sets = sets.join(least, "label").select("own", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    some = described.filter("n_shingles > 0").select("doc_id", "n_shingles", "own").join(sets, "own").select("doc_id", "n_shingles", "component_id", "n_links")
    none = described.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return unnamed(some.unionByName(none), "doc_id", "component_id")
