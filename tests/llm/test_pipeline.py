"""The pipeline on planted cases, and each stage's schema."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from test_dedup import brute_classes, brute_removed
from tokenizers import Tokenizer

import corpus_pipeline
from lumenote.llm import quality
from lumenote.llm.shared import PrefixHash, mix
from lumenote.llm.tokens import tokenizer_path

RNG = random.Random(7)
SYLLABLES = "ta re mi no lu ver sta con pel dor in es am ol qui ban".split()


def word():
    return "".join(RNG.choice(SYLLABLES) for _ in range(RNG.randint(1, 4)))


def prose(n):
    return " ".join(word() for _ in range(n))


def junk(n):
    return " ".join(word().upper() + "!!" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    passage, item = prose(60), prose(30)
    texts = {i: prose(120) for i in range(200)}
    texts |= {i: junk(100) for i in range(200, 260)}
    texts |= {300: texts[3], 301: texts[3], 302: " ".join(texts[4].split()[:-2] + ["other", "end"])}
    texts |= {400: prose(40) + " " + passage + " " + prose(40), 401: prose(50) + " " + passage + " " + prose(30)}
    leak = item.split()
    leak[5] = "changed"
    texts |= {500: prose(60) + " " + item, 501: prose(30) + " " + " ".join(leak) + " " + prose(30)}
    rows = [(i, t, "en", "src", len(t)) for i, t in texts.items()] + [(900, None, None, None, None), (901, "", "en", "src", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts, passage


def test_stages(spark, corpus):
    folder, texts, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns or name == "packing"
    clean = set(range(200)) - {3, 4}
    assert clean | {3, 4, 300, 301, 302, 400, 401, 500, 501} <= set(seen["quality"])
    assert not set(range(200, 260)) & set(seen["quality"])
    left = set(seen["near_duplicates"])
    assert clean | {3, 4} <= left and not {300, 301, 302} & left
    trimmed = seen["repeated_passages"]
    assert clean | {3, 4, 400, 401} <= set(trimmed)
    assert not any(passage in (trimmed[i].text or "") for i in (400, 401)) and len(trimmed[400].text) > 100
    assert all(trimmed[i].text == texts[i] and trimmed[i].n_chars == len(texts[i]) for i in clean)
    assert clean | {3, 4, 400, 401} <= set(seen["decontamination"]) and not {500, 501} & set(seen["decontamination"])
    assert set(seen["packing"]) == set(seen["decontamination"])


def test_run_gives_the_last_stage(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus[0]).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) >= 200


def plain_score(body: bytes, model) -> float:
    """The quality score by a loop over the features of one text."""
    table, bias = model.folded()
    found = []
    for n in quality.GRAMS:
        for i in range(len(body) - n + 1):
            code = 0
            for b in body[i : i + n]:
                code = (code * 257 + b + 1) % 2**32
            found.append((code * 2654435761 % 2**32) >> 16)
    words = [np.frombuffer(w, np.uint8) for w in re.split(rb"[ \t-\r]+", body) if w]
    hashes = [PrefixHash(w).of(np.array([0]), np.array([len(w)]))[0] for w in words]
    found += [quality.CHARS + int(h) % quality.WORDS for h in hashes]
    for a, b in zip(hashes, hashes[1:], strict=False):
        pair = 1 if a == b else int(mix(np.array([a * np.uint64(3) ^ b], np.uint64))[0])
        found.append(quality.CHARS + pair % quality.WORDS)
    z = bias + (sum(float(table[k]) for k in found) / len(found) if found else 0)
    return 1 / (1 + math.exp(-z))


def leaked(text: str, item: str) -> bool:
    """Whether some alignment has a window of 13 tokens, 11 of them equal."""
    t, u = (re.findall(r"[^\W_]+", s.lower()) for s in (text, item))
    for shift in range(-len(u) + 1, len(t)):
        equal = [int(0 <= shift + k < len(t) and t[shift + k] == u[k]) for k in range(len(u))]
        inside = [0 <= shift + k < len(t) for k in range(len(u))]
        if any(all(inside[s : s + 13]) and sum(equal[s : s + 13]) >= 11 for s in range(len(u) - 12)):
            return True
    return False


@pytest.mark.filterwarnings("ignore:overflow")
def test_stages_equal_brute_force(spark, corpus):
    """Each stage against a plain version of it on the stage's own input."""
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: corpus_pipeline.stored(stages[name](spark, df, folder), name)

    model = quality.train_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    given, kept = texts(docs), run("quality", docs)
    assert texts(kept) == {d: t for d, t in given.items() if plain_score((t or "").encode(), model) >= 0.3}

    given, alone = texts(kept), run("near_duplicates", kept)
    ids = sorted(given)
    classes = brute_classes([given[d] for d in ids], 5, 80)
    assert texts(alone) == {d: given[d] for i, d in enumerate(ids) if classes[i][1] == i}

    given, trimmed = texts(alone), run("repeated_passages", alone)
    ids = sorted(given)
    removed = dict(zip(ids, brute_removed([given[d] for d in ids], 200), strict=True))
    got = texts(trimmed)
    assert set(got) == {d for d, (n, gone, _, _) in removed.items() if gone < n or not n}
    assert all(hashlib.sha256((t or "").encode()).hexdigest() == removed[d][3] for d, t in got.items())
    assert all(got[d] == given[d] for d in got if not removed[d][1])

    given, clean = texts(trimmed), run("decontamination", trimmed)
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    assert texts(clean) == {d: t for d, t in given.items() if not leaked(t or "", item)}

    given, rows = texts(clean), run("packing", clean).collect()
    tool = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {d: [*tool.encode(t or "", add_special_tokens=False).ids, 1] for d, t in given.items()}
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in rows} == {(d, s, len(x[s : s + 4096]), zlib.crc32(np.array(x[s : s + 4096], "<u4").tobytes())) for d, x in ids.items() for s in range(0, len(x), 4096)}
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 4096
    rooms = []
    for n in sorted((r.length for r in rows), reverse=True):
        fit = [i for i, room in enumerate(rooms) if room >= n]
        best = min(fit, key=lambda i: rooms[i]) if fit else len(rooms)
        if not fit:
            rooms.append(4096)
        rooms[best] -= n
    assert len(sequences) <= len(rooms)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_null_ids_and_clashing_columns(spark, tmp_path):
    """Rows without doc_id go at the near-duplicate stage, which names groups by it; other columns are carried along."""
    rows = [(i, prose(60), "en", "s", 1, "body", "own", 0.5) for i in range(8)] + [(None, prose(60), "en", "s", 1, "b", "o", 0.1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, body string, own string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs.columns, corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == before
        assert {r.doc_id for r in docs.collect()} - {None} == set(range(8))
    assert docs.filter("doc_id IS NULL").count() == 0
