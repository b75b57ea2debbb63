"""Suffix-array dedup and the n-gram join against brute force, edge cases included."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenote.llm import ngram_join, suffix_dedup

SCHEMA = "doc_id long, text string, body string, label string, own long, keys string"


def table(spark, texts):
    """Documents with other columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", 7, "z") for i, t in enumerate(texts)], SCHEMA)


def brute_removed(texts, size):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in bodies for i in range(len(b) - size + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return out


def test_repeated_starts_equal_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        letters = rng.choice([b"ab", b"abcdefghij", b"a"])
        blocks = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(6)]
        strings = [b"".join(rng.choice(blocks) for _ in range(rng.randint(0, 8))) for _ in range(8)]
        size = rng.choice([12, 20, 30])
        text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
        seen = Counter(s[i : i + size] for s in strings for i in range(len(s) - size + 1))
        expected = [i + size <= len(s) and seen[s[i : i + size]] > 1 for s in strings for i in range(len(s) + 1)]
        assert suffix_dedup.repeated_starts(text, size).tolist() == expected


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line = prose(60), prose(14)
    out = [None, "", " ", "a", prose(50), prose(50)]
    out += [prose(20) + shared + prose(20) for _ in range(4)] + [shared, shared, shared.upper()]
    out += [f"{prose(3)} {line} {prose(3)}" for _ in range(30)]
    out += ["ab" * 300, "x" * 199, "x" * 200, "x" * 450]
    base = [word() for _ in range(120)]
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_REGIONS", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE", 512)  # long texts are cut into pieces
    rows = suffix_dedup.suffix_dedup(table(spark, texts), with_text=True).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == dict(enumerate(brute_removed(texts, 200)))
    assert all(r.kept == (texts[r.doc_id] or "") for r in rows if not r.n_removed)


def brute_classes(texts, words, percent):
    sets = {}
    for d, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()
    inverted = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inverted[x].append(d)
    parent, degree = {d: d for d in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for e, both in Counter(y for x in s for y in inverted[x] if y > d).items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                degree[d] += 1
                degree[e] += 1
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d), degree[d]) for d in sets}


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 90, 1024), (5, 80, 3), (1, 50, 4)])
def test_ngram_join(spark, texts, monkeypatch, words, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FRAGMENT", 16)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.ngram_join(table(spark, texts), words, percent).collect()}
    assert got == brute_classes(texts, words, percent)


def test_empty_tables(spark):
    empty = table(spark, [])
    assert suffix_dedup.suffix_dedup(empty).collect() == []
    assert ngram_join.ngram_join(empty).collect() == []


def test_size_classes_of_linked_sets_are_adjacent():
    for percent in (50, 80, 90):
        for n in range(1, 400):
            for m in range(n, 100 * n // percent + 1):
                a, b = ngram_join.size_class(n, percent)[0], ngram_join.size_class(m, percent)[0]
                assert b - a in (0, 1)
