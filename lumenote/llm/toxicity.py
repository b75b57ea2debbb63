"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more.

Text is lower-cased (A-Z) and reduced to letters and single spaces, then cut into overlapping windows. Both dictionaries
are trained by zstandard, each on training text of its own class. Most of a toxic text is ordinary, and two dictionaries
of whole texts differ mostly by chance; so both stand on one base trained on ordinary text, and the toxic one is trained
on those words of the toxic texts whose beginnings ordinary ones lack (inflected words share a beginning). A window's
difference is its length under the ordinary dictionary less that under the toxic one: ordinary matches cancel out, toxic
ones shorten. A document's largest differences, their mean and its number of windows are put on a scale from 0 to 1 by thresholds calibrated on the
training documents (logistic regression, both classes weighted as they occur).

Training takes at most `per_class` labelled documents of each class, the first by a hash of doc_id, and of these the
first that together hold at most `most_bytes` of text. Whole texts are used in training and scoring. Empty and null texts
have one empty window. Without labels of both classes every score is 0 or, with toxic labels only, 1. Repeated rows are
scored each, as are rows with a null doc_id (which have no label and are not held out); other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import fold, labelled_bodies, labelled_sample
from .shared import input_bytes

WINDOW, OVERLAP = 64, 12
#: Bytes of the common base and of either dictionary before it; bytes of the pieces of text they are trained on.
BASE, FRONT, PIECE = 16_000, 1536, 256
#: Bytes of the runs that the toxic dictionary is put together from, and of the shortest beginning of a word.
SEGMENT, LEAST_BEGINNING = 48, 4
LEVEL, LEAST_MATCH = 6, 4
#: Words enter the toxic dictionary if the G2 statistic of one of their beginnings is at least this share of the largest, and this much.
SHARE, LEAST_G2 = 0.06, 15
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(body: bytes) -> bytes:
    """Words in lower case, one space around each."""
    words = body.translate(LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def likelihood_ratio(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> np.ndarray:
    """G2 of a word that occurs in a of na and in b of nb documents."""
    share = (a + b) / (na + nb)

    def part(k, n, p):
        return np.where(k > 0, k * np.log(np.maximum(k, 1) / n / np.maximum(p, 1e-12)), 0)

    return 2 * (part(a, na, share) + part(b, nb, share) + part(na - a, na, 1 - share) + part(nb - b, nb, 1 - share))


def beginnings(word: bytes) -> list[bytes]:
    """The beginnings of a word, with the space before it, and the word with both its spaces."""
    spaced = b" " + word + b" "
    return [spaced[:n] for n in range(LEAST_BEGINNING + 1, len(spaced) + 1)]


def typical_beginnings(own: list[bytes], other: list[bytes]) -> set[bytes]:
    """The beginnings of words that set the first texts apart, by the number of texts that hold them."""
    mine, theirs = (Counter(x for t in texts for x in {x for w in set(t.split()) for x in beginnings(w)}) for texts in (own, other))
    found = sorted(x for x, k in mine.items() if k >= 3 and k / len(own) > theirs[x] / len(other))
    if not found:
        return set()
    g = likelihood_ratio(np.array([mine[x] for x in found]), len(own), np.array([theirs[x] for x in found]), len(other))
    return {x for x, v in zip(found, g, strict=True) if v >= max(SHARE * g.max(), LEAST_G2)}


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a zstandard dictionary of the samples, the most useful last; too few of them: their own bytes."""
    import zstandard as z

    try:
        return z.train_dictionary(size + 2000, samples, k=segment, d=6).as_bytes()[-size:]
    except z.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))
    _pair: tuple | None = None

    def __getstate__(self):
        return self.toxic, self.ordinary, self.weights

    def __setstate__(self, state):
        self.toxic, self.ordinary, self.weights = state
        self._pair = None

    def compressors(self):
        if self._pair is None:
            import zstandard as z

            made = []
            for content in (self.toxic, self.ordinary):
                how = z.ZstdCompressionParameters.from_level(LEVEL, min_match=LEAST_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False, source_size=WINDOW + OVERLAP, dict_size=len(content))
                made.append(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how).compress)
            self._pair = tuple(made)
        return self._pair

    def statistics(self, body: bytes) -> np.ndarray:
        """1, the three largest differences, their mean over all windows, log of the number of windows."""
        text = letters(body)
        toxic, ordinary = self.compressors()
        d = np.array([len(ordinary(w)) - len(toxic(w)) for w in (text[i : i + WINDOW + OVERLAP] for i in range(0, max(1, len(text) - OVERLAP), WINDOW))], float)
        top = np.sort(np.concatenate([d, np.zeros(3)]))[::-1][:3]
        return np.array([1, *top, d.mean(), np.log(len(d))])

    def score(self, body: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.statistics(body) @ self.weights, -30, 30))))


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w * (np.arange(len(w)) > 0)
        hess = (x.T * (weight * p * (1 - p))) @ x + (ridge + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[tuple[int, bytes]], shares: tuple[float, float] | None = None) -> Model:
    """Train both dictionaries and the thresholds on (label, text)."""
    ordinary, toxic = ([letters(b) for label, b in texts if label == c] for c in (0, 1))
    if not ordinary or not toxic:
        return Model(b"  ", b"  ", np.array([30.0 if toxic else -30.0, 0, 0, 0, 0, 0]))
    pieces = [t[i : i + PIECE] for t in ordinary for i in range(0, len(t), PIECE)]
    pieces = [pieces[i] for i in np.random.default_rng(0).permutation(len(pieces))]
    half = (len(pieces) + 1) // 2
    base = trained(pieces, BASE, 32)
    telling = typical_beginnings(toxic, ordinary)
    marked = [b" " + b" ".join(w for w in dict.fromkeys(t.split()) if not telling.isdisjoint(beginnings(w))) + b" " for t in toxic]
    front = b" " + trained([t for t in marked if len(t) > 2], FRONT, SEGMENT) + b" "
    plain = trained(pieces[half:] or pieces, len(front), 16).rjust(len(front))
    model = Model(front + base, plain + base)
    x = np.array([model.statistics(b) for _, b in texts])
    y = np.array([label for label, _ in texts])
    shares = shares or (1 - y.mean(), y.mean())
    model.weights = calibrated(x, y, np.where(y == 1, shares[1] / y.mean(), shares[0] / (1 - y.mean())))
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, per_class: int = 1500, most_bytes: int = 32 << 20) -> Model:
    learn = fold(F.col("doc_id"), folds) != held_out
    sample = labelled_sample(labels, "toxic", learn, per_class)
    rows = labelled_bodies(docs, sample, most_bytes).collect()
    count = labels.filter(learn & F.col("toxic").isNotNull()).agg(F.avg((F.col("toxic") > 0).cast("int"))).first()[0]
    return fit([(r.label, bytes(r.body)) for r in sorted(rows, key=lambda r: (r.doc_id, r.body))], (1 - count, count) if count else None)


def _scored(model: Model):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(b.as_py()) for b in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, model: Model, folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    scored = input_bytes(docs).mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
