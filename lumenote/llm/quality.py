"""Document quality by supervised subword embeddings.

Hashed word, word-pair and character n-gram (2 to 4 bytes) vectors are learned by stochastic gradient descent in numpy:
a document is the mean of its features' vectors, a softmax layer on it gives the two classes. Whole texts are used,
for training and for scoring.

Training takes at most `per_class` labelled documents of each class, the first by a hash of doc_id, and of these the
first that together hold at most `most_bytes` of text (texts of over a LONG_SHARE of it last, so that one of any length
never displaces the others); a document with several labels takes the largest, null labels are
ignored. Scoring is linear in the features, so each bucket's vector is
folded into one number that tasks look up; the table's size is fixed by `BUCKETS`, whatever the corpus.

Empty and null texts have the score of no features at all (the layer's bias). Without labels of both classes every
score is 0.5 (or the one class's value). Repeated rows are scored each, as are rows with a null doc_id (which
have no label and are not held out); other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import U64, PrefixHash, binary_parts, bounded_runs, input_bytes, mix, released, word_spans

#: Buckets of character n-grams and of words; powers of two.
CHARS, WORDS = 1 << 16, 1 << 16
BUCKETS = CHARS + WORDS
BATCH = 1 << 18
GRAMS = (2, 3, 4)
#: A training text over this part of its class's bytes waits until the others have their place.
LONG_SHARE = 64


def feature_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Yields (bucket of each place, document of each place) for every kind of feature of adjacent documents."""
    code = np.zeros(len(data), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        code = code[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :].astype(np.uint32) + np.uint32(1) if len(data) >= n else code[:0]
        if n in GRAMS and len(code):
            bucket = (code * np.uint32(2654435761)) >> np.uint32(16)
            at = np.arange(len(code))
            doc = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[doc]
            yield bucket[inside].astype(np.int64), doc[inside]
    a, b, doc = word_spans(data, starts, ends)
    if len(a):
        word = PrefixHash(data).of(a, b)
        yield (CHARS + (word & U64(WORDS - 1))).astype(np.int64), doc
        pair = mix(word[:-1] * U64(3) ^ word[1:])
        pair[word[:-1] == word[1:]] = U64(1)  # the same word twice: one feature whatever the word
        same = doc[1:] == doc[:-1]
        yield (CHARS + (pair[same] & U64(WORDS - 1))).astype(np.int64), doc[1:][same]


def _features(batches):
    """(doc_id, label, body) to the document's distinct buckets, as differences, and counts, both compressed."""
    for batch in batches:
        data, offsets = binary_parts(batch.column("body"))
        idx, cnt = [], []
        for i in range(batch.num_rows):
            body = data[offsets[i] : offsets[i + 1]]
            found = [b for b, _ in feature_buckets(body, np.array([0]), np.array([len(body)]))] if len(body) else []
            u, c = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            idx.append(zlib.compress(np.diff(u, prepend=0).astype("<u4").tobytes()))
            cnt.append(zlib.compress(c.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(idx, pa.binary()), pa.array(cnt, pa.binary())], names=["doc_id", "label", "idx", "cnt"])


class Model:
    """Averaged embeddings with a softmax layer over two classes."""

    def __init__(self, dim: int = 8, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
        self.layer = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def train(self, docs: list[tuple[int, np.ndarray, np.ndarray]], updates: int = 20_000, rate: float = 0.5, seed: int = 0) -> "Model":
        """Stochastic gradient descent over (label, buckets, weights summing to 1), each class equally often."""
        by_class = [[d for d in docs if d[0] == c] for c in (0, 1)]
        if not all(by_class):
            self.bias[:] = [-20 * bool(by_class[1]), -20 * bool(by_class[0])] if docs else 0
            self.layer[:] = 0
            return self
        rng = np.random.default_rng(seed)
        for step in range(updates):
            label, idx, weight = by_class[step & 1][rng.integers(len(by_class[step & 1]))]
            lr = rate * (1 - step / updates)
            hidden = weight @ self.vectors[idx]
            z = hidden @ self.layer + self.bias
            z = np.exp(z - z.max())
            error = z / z.sum()
            error[label] -= 1
            back = self.layer @ error
            self.layer -= lr * np.outer(hidden, error)
            self.bias -= lr * 0.1 * error
            self.vectors[idx] -= (lr * len(idx) ** 0.5 * 4) * weight[:, None] * back
        return self

    def folded(self) -> tuple[np.ndarray, float]:
        """Each bucket's share of the log odds of class 1, and the bias."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def _scores(table: np.ndarray, bias: float, bodies: pa.Array):
    """Runs of rows of a binary column: start, end, their scores."""
    data, offsets = binary_parts(bodies)
    for s, e in bounded_runs(np.diff(offsets), BATCH):
        body = data[offsets[s] : offsets[e]]
        starts, ends = offsets[s:e] - offsets[s], offsets[s + 1 : e + 1] - offsets[s]
        total, count = np.zeros(e - s), np.zeros(e - s)
        for bucket, doc in feature_buckets(body, starts, ends):
            total += np.bincount(doc, table[bucket], e - s)
            count += np.bincount(doc, minlength=e - s)
        yield s, e, 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -30, 30)))


def _scored(table: np.ndarray, bias: float):
    def run(batches):
        for batch in batches:
            for s, e, score in _scores(table, bias, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(score)], names=["doc_id", "score"])

    return run


def _filtered(table: np.ndarray, bias: float, place: int, threshold: float):
    """Whole rows whose text (the column at `place`; null: empty) scores at least the threshold."""

    def run(batches):
        for batch in batches:
            text = pc.fill_null(batch.column(place), "").cast(pa.binary())
            for s, e, score in _scores(table, bias, text):
                yield batch.slice(s, e - s).filter(pa.array(score >= threshold))

    return run


def fold(doc_id, parts: int):
    """crc32 of the doc_id as text, modulo the number of parts; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def labelled_sample(labels: DataFrame, column: str, learn, per_class: int) -> DataFrame:
    """doc_id, label of at most per_class documents of each class among those for which `learn` holds."""
    one = labels.filter(F.col(column).isNotNull() & learn).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(column) > 0).cast("int").alias("label"))
    parts = [one.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def labelled_bodies(docs: DataFrame, sample: DataFrame, most_bytes: int) -> DataFrame:
    """doc_id, label, body of the sample; of each class the first, by a hash of doc_id, that hold half of most_bytes.

    Texts that alone take over a LONG_SHARE of that half come last, the shortest first: a very long one is left out and
    takes no other with it. A class keeps one text at least.
    """
    # the sample is bounded, so are its broadcast and the window
    chosen = input_bytes(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "label", F.length("body").alias("n"))
    half = most_bytes // 2
    late = F.when(F.col("n") > half // LONG_SHARE, F.col("n")).otherwise(0)
    order = Window.partitionBy("label").orderBy(late, F.xxhash64("doc_id"), "doc_id")
    placed = chosen.withColumn("so_far", F.sum("n").over(order)).withColumn("nth", F.row_number().over(order))
    few = placed.filter((F.col("so_far") <= half) | (F.col("nth") == 1)).select("doc_id", "label").distinct()
    return input_bytes(docs).join(F.broadcast(few), "doc_id").select("doc_id", "label", "body")


def train_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = 3000, most_bytes: int = 64 << 20) -> Model:
    sample = labelled_sample(labels, "quality", fold(F.col("doc_id"), folds) != held_out, per_class)
    chosen = labelled_bodies(docs, sample, most_bytes)
    rows = chosen.mapInArrow(released(_features), "doc_id long, label int, idx binary, cnt binary").toArrow().sort_by("doc_id")
    data = []
    for label, idx, cnt in zip(*(rows.column(k) for k in ("label", "idx", "cnt")), strict=True):
        c = np.frombuffer(zlib.decompress(cnt.as_py()), "<u4")
        if len(c):
            i = np.cumsum(np.frombuffer(zlib.decompress(idx.as_py()), "<u4")).astype(np.int32)
            data.append((label.as_py(), i, (c / c.sum()).astype(np.float32)))
    return Model().train(data)


def quality_scores(docs: DataFrame, model: Model, folds: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    scored = input_bytes(docs).mapInArrow(released(_scored(*model.folded())), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents that score at least the threshold, with all their columns; rows are passed through, not joined."""
    return docs.mapInArrow(released(_filtered(*model.folded(), docs.columns.index("text"), threshold)), docs.schema)
