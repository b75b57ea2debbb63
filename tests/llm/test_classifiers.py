"""Both classifiers on texts made for them, with held-out accuracy and edge cases; the pipeline end to end."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from lumenote.llm import quality, toxicity

RNG = random.Random(0)
SYLLABLES = "ta re mi no lu ver sta con pel dor in es am ol".split()


def word():
    return "".join(RNG.choice(SYLLABLES) for _ in range(RNG.randint(1, 3)))


def prose(n):
    return " ".join(word() for _ in range(n)).capitalize() + "."


def junk(n):
    kind = RNG.randrange(3)
    if kind == 0:
        return " ".join(word().upper() + "!!" for _ in range(n))
    if kind == 1:
        return " | ".join(word() for _ in range(n))
    return " ".join(w for w in (word() for _ in range(n // 7)) for _ in range(7))


def rude(n):
    words = prose(n).split()
    for w in RNG.sample(["zounds", "blockhead", "knave", "scoundrel"], 3):
        words.insert(RNG.randrange(len(words)), w)
    return " ".join(words)


def make(spark, good, bad, column):
    texts = [(i, (bad if i % 4 == 0 else good)(RNG.randint(30, 150)), int(i % 4 == 0)) for i in range(400)]
    extra = [(1000, None), (1001, ""), (1002, "   "), (1003, "é"), (1004, prose(20_000))]
    docs = spark.createDataFrame([(i, t, 0.5, 1, "x") for i, t in [(i, t) for i, t, _ in texts] + extra], "doc_id long, text string, score double, label int, body string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(1000, None), (5000, 1)], f"doc_id long, {column} int")
    return docs, labels, {i: y for i, _, y in texts}


def check(rows, truth, parts, held):
    rows = {r.doc_id: r for r in rows}
    assert len(rows) == len(truth) + 5
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % parts == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    return float(np.mean([rows[d].predicted == y for d, y in truth.items() if rows[d].held_out]))


def test_quality(spark):
    docs, labels, truth = make(spark, prose, junk, "quality")
    rows = quality.quality_scores(docs, quality.train_quality(docs, labels)).collect()
    assert check(rows, truth, 5, 0) > 0.95


def test_toxicity(spark):
    docs, labels, truth = make(spark, prose, rude, "toxic")
    rows = toxicity.toxicity_scores(docs, toxicity.train_toxicity(docs, labels)).collect()
    assert check(rows, truth, 4, 2) > 0.9


@pytest.mark.parametrize("present", [None, 0, 1])
def test_without_both_classes(spark, present):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (6, "more")], "doc_id long, text string")
    labels = spark.createDataFrame([] if present is None else [(i, present, present) for i in (1, 2, 6)], "doc_id long, quality int, toxic int")
    good = quality.quality_scores(docs, quality.train_quality(docs, labels)).collect()
    bad = toxicity.toxicity_scores(docs, toxicity.train_toxicity(docs, labels)).collect()
    assert len(good) == len(bad) == 3
    if present is not None:
        assert {r.predicted for r in good} == {present} and {r.predicted for r in bad} == {present}


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = make(spark, prose, junk, "quality")
    from pyspark.sql import functions as F

    other = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train_quality(docs, x).folded() for x in (labels, other))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_toxicity_by_a_plain_loop(spark):
    """Scores of a few texts from both dictionaries' windows, one at a time."""
    import zstandard as z

    texts = [(i % 3 == 0, (rude if i % 3 == 0 else prose)(60).encode()) for i in range(60)]
    model = toxicity.fit([(int(y), t) for y, t in texts])
    assert model.toxic != model.ordinary and len(model.toxic) == len(model.ordinary)
    for body in (b"", b"one Zounds, BLOCKHEAD!", *(t for _, t in texts[:4]), prose(3000).encode()):
        text = b" ".join(bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in body).split())
        text = b" " + text + b" " if text else b""
        windows = [text[i : i + 76] for i in range(0, max(1, len(text) - 12), 64)]
        lengths = []
        for content in (model.toxic, model.ordinary):
            how = z.ZstdCompressionParameters.from_level(6, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False, source_size=76, dict_size=len(content))
            tool = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how)
            lengths.append([len(tool.compress(w)) for w in windows])
        d = [o - t for t, o in zip(*lengths, strict=True)]
        top = sorted([*d, 0, 0, 0], reverse=True)[:3]
        zed = sum(w * x for w, x in zip(model.weights, [1, *top, sum(d) / len(d), math.log(len(d))], strict=True))
        assert abs(model.score(body) - 1 / (1 + math.exp(-zed))) < 1e-9


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(docs, quality.train_quality(docs, labels)).collect() == []
    assert toxicity.toxicity_scores(docs, toxicity.train_toxicity(docs, labels)).collect() == []
