"""Cases of the review of round 4: candidates of the n-gram join that are chained but not near, texts that are shuffled less often."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_dedup import brute_classes, table

import corpus_pipeline
from lumenote.llm import ngram_join, suffix_dedup
from lumenote.llm.shared import own_id


@pytest.fixture(scope="module")
def chained():
    """Texts of three of 60 lines each, few of which are near others; also copies, and texts of very few words."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    lines = [" ".join(word() for _ in range(24)) for _ in range(60)]
    out = [" ".join([*rng.sample(lines, 3), word()]) for _ in range(240)]
    for t in out[:30]:
        copy = t.split()
        copy[rng.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    return out + out[5:15] + [word() for _ in range(20)] + ["", None, "a b", "a b"]


@pytest.mark.parametrize(("words", "percent"), [(3, 80), (1, 80), (2, 50)])
@pytest.mark.parametrize("most", [8192, 5])
def test_chained_candidates_get_no_grams(spark, chained, monkeypatch, words, percent, most):
    """The copies of n-grams that blocks get follow the sets that are near some other one, not the square of a cluster."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SKETCHES", most)
    rows, stored = {}, ngram_join.stored

    def counted(df, name="step"):
        out = stored(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.ngram_join(table(spark, chained), words, percent).collect()}
    wanted = brute_classes(chained, words, percent)
    assert got == wanted
    if percent == 80:
        assert 30 < rows["grams"] < 90 < rows["candidates"]


def test_sketches_rule_out_no_link():
    """Any two sets' sketches, of whatever sizes, differ by no more than the sets."""
    rng = np.random.default_rng(1)
    for n in [1, 2, 15, 16, 17, 64, 65, 300, 5000]:
        one = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        few = np.unique(rng.integers(0, 1 << 50, n, np.uint64))  # all in one part, more than it counts
        for a in (one, few):
            for b in (np.append(a[n // 5 :], rng.integers(0, 1 << 64, n // 7, np.uint64)), rng.integers(0, 1 << 64, 2 * n, np.uint64), few):
                b = np.unique(b)
                if len(b):
                    bits = ngram_join.folded([np.frombuffer(ngram_join.sketch(x), np.uint8) for x in (a, b)])
                    assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))
    unlike = [ngram_join.sketch(np.sort(rng.integers(0, 1 << 64, 500, np.uint64))) for _ in range(2)]
    bits = ngram_join.folded([np.frombuffer(x, np.uint8) for x in unlike])
    assert np.bitwise_count(bits[0] ^ bits[1]).sum() > 2 * ngram_join.most_different(1000, 80)


@pytest.mark.parametrize("most", [1 << 19, 0])
def test_few_and_many_ids(spark, chained, monkeypatch, most):
    """With the ids in the tasks and in shuffles, also where most rows are copies."""
    monkeypatch.setattr(ngram_join, "MOST_SENT", most)
    monkeypatch.setattr(corpus_pipeline, "MOST_SENT", most)
    texts = chained * 3
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.ngram_join(table(spark, texts), 5, 80).collect()}
    wanted = brute_classes(texts, 5, 80)
    assert got == wanted
    left = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, table(spark, texts), "").collect()]
    assert sorted(left) == [d for d, x in sorted(wanted.items()) if x[1] == d]


def test_rows_meet_what_is_left_of_their_texts_once(spark):
    """Other columns, whatever their names, repeated rows, null texts and ids stay as they were; there is one join."""
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("ré mi fa sol la".split()) + str(rng.randrange(1000)) for _ in range(n))
    shared = prose(80)
    texts = [prose(30) + shared + prose(20), shared + prose(60), shared, shared, prose(90), None, "", "a", prose(30) + "é" * 150 + "è", "é" * 150 + "è" + prose(9)]
    rows = [(i if i % 4 else None, t, i, [i], 7) for i, t in enumerate(texts)]
    rows += [rows[1], rows[6], (20, "z" * 400, 20, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars int, `a b` array<int>, row int").repartition(3)
    wanted = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs, 200, with_text=True, stand_ins=True).collect()}
    own = {r.text: r.own for r in docs.select("text", own_id().alias("own")).filter("doc_id IS NULL").collect()}
    expected = []
    for d, t, n, more, row in rows:
        r = wanted[own[t] if d is None else d]
        if r.n_removed < r.n_bytes or not r.n_bytes:
            expected.append((d, r.kept if r.n_removed else t, len(r.kept) if r.n_removed else n, more, row))
    got = corpus_pipeline.repeated_passage_stage(spark, docs, "")
    assert got.dtypes == docs.dtypes and got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got.collect())) == sorted(map(key, expected)) and 3 < len(expected) < len(rows)
