"""Rows without a doc_id, very long training texts, and words that a rolling hash can't tell apart."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lumenote.llm import decontam, ngram_join, packing, quality, shared, suffix_dedup, token_counts, token_output, toxicity

LONG = " ".join(f"palavra{i}" for i in range(100))
ROWS = [(None, LONG), (None, LONG + " fim"), (3, "abc"), (None, "y"), (None, "y"), (7, LONG), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


def test_suffix_dedup(docs):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    n = len(LONG)
    want = [(None, n, n, sha("")), (None, n + 4, n, sha(" fim")), (3, 3, 0, sha("abc")), (None, 1, 0, sha("y")), (None, 1, 0, sha("y")), (7, n, n, sha("")), (None, 0, 0, sha(""))]
    assert got == Counter(want)


def test_ngram_join(docs):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs, 3, 90).collect())
    assert got == Counter([(None, 98, 7), (None, 99, 7), (7, 98, 7), (3, 1, 3), (None, 1, None), (None, 1, None), (None, 0, None)])


def test_packing_and_counts(docs, spark):
    pieces = packing.best_fit_packing(docs, limit=64).collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    assert sum(r.doc_id is None for r in pieces if r.piece == 0) == 5
    assert sum(r.n_docs for r in token_counts.length_histogram(docs).collect()) == 7
    folder = token_output.new_folder(spark)
    token_output.write_tokens(docs, folder)
    read = sorted((r.start, r.n_tokens, r.doc_id) for r in token_output.read_tokens(spark, folder).collect())
    assert [d for *_, d in read] == [None] * 5 + [3, 7] and all(a + n == b for (a, n, _), (b, *_) in zip(read, read[1:], strict=False))


def test_decontamination(docs, spark):
    item = spark.createDataFrame([(1, " ".join(LONG.split()[3:20])), (None, "nada disto")], "item_id long, text string")
    assert Counter((r.doc_id, r.item_id) for r in decontam.leaks(docs, item, 1).collect()) == Counter([(None, 1), (None, 1), (7, 1)])
    assert Counter(map(tuple, decontam.clean(docs, item, 1).collect())) == Counter([(3, "abc"), (None, "y"), (None, "y"), (None, None)])


def test_scores(docs):
    model = quality.Model().train([])
    assert {r.held_out for r in quality.quality_scores(docs, model).collect() if r.doc_id is None} == {False}
    scores = toxicity.toxicity_scores(docs, toxicity.fit([])).collect()
    assert {r.held_out for r in scores if r.doc_id is None} == {False} and len(scores) == 7


def test_pipeline_stages(docs, spark):
    full = docs.selectExpr("doc_id", "text", "'pt' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    near = corpus_pipeline.near_duplicate_stage(spark, full, "")
    assert Counter((r.doc_id, r.text) for r in near.collect()) == Counter([(7, LONG), (3, "abc")])
    kept = corpus_pipeline.repeated_passage_stage(spark, full, "")
    assert Counter((r.doc_id, r.text, r.n_chars) for r in kept.collect()) == Counter([(None, " fim", 4), (3, "abc", 3), (None, "y", 1), (None, "y", 1), (None, None, None)])


def test_one_long_text_takes_no_class_along(spark):
    texts = [(i, ("muito bom texto " if i % 2 else "lixo lixo lixo ") + str(i)) for i in range(50)]
    for longest in range(0, 50):  # whichever comes first by hash
        if longest % 10 not in (0, 1):
            continue
        rows = [(i, t * 400 if i == longest else t) for i, t in texts]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        sample = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, label int")
        kept = quality.labelled_bodies(docs, sample, 4000).collect()
        assert {r.doc_id for r in kept} == {i for i, _ in rows if i != longest}
    only = spark.createDataFrame([(1, "a" * 9000), (2, "b" * 8000), (3, "curto")], "doc_id long, text string")
    kept = quality.labelled_bodies(only, spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, label int"), 4000)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_complementary_words_are_different(spark):
    """Thue-Morse words of 2048 letters: every polynomial hash modulo a power of two takes them for equal."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, other = ("".join("ab"[b ^ x] for b in bits) for x in (0, 1))
    docs = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs, 3, 90).collect()} == {1: 1, 2: 2, 3: 1}


def test_word_hashes():
    rng = np.random.default_rng(2)
    words = [rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in [*range(1, 30), 63, 64, 65, 255, 256, 257, 600] for _ in range(6)]
    data, ends = np.frombuffer(b" ".join(words), np.uint8), np.cumsum([len(w) + 1 for w in words]) - 1
    got = shared.word_hashes(data, ends - [len(w) for w in words], ends)
    assert len(set(got.tolist())) == len(set(words)) and all((got[i] == got[j]) == (a == b) for i, a in enumerate(words) for j, b in enumerate(words))
    assert shared.word_hashes(data, ends[:0], ends[:0]).tolist() == []
