"""Token ids, counts, binary output and packing against the tokenizers library and brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lumenote.llm import packing, queries, token_counts, token_output, tokens

RNG = random.Random(5)
PARTS = ["a", "b", "Ab", " ", "  ", "\n", "\t", "!", "'s", "'", "1", "é", "É", " ", "　", "日", "🎉", "<|endoftext|>", "é", " '", "\r\n", "\x0b", "\x1c", "\x85", "\x01", "İ", "ß", "ﬁ", "²", "½"]
ODD = ["".join(RNG.choice(PARTS) for _ in range(RNG.randint(0, 14))) for _ in range(3000)]
ODD += ["".join(chr(RNG.randrange(256)) for _ in range(RNG.randint(0, 12))) for _ in range(3000)]
FILES = {"space": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}


def library(name):
    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("cut", ["space", "word"])
def test_ids_equal_whole_text_encoding(cut, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_KEPT", 500)  # the memory of pieces turns over
    tool, expected = tokens.Encoder(tokens.tokenizer_path(FILES[cut]), cut), library(FILES[cut])
    for i in range(0, len(ODD), 400):
        texts = ODD[i : i + 400]
        ids, sizes = tool.encode(texts)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [p.tolist() for p in parts] == [e.ids for e in expected.encode_batch(texts, add_special_tokens=False)]


def docs(spark):
    texts = [None, "", *ODD[:40], "word " * 9000, "same", "same", *ODD[:3]]
    ids = list(range(len(texts)))
    RNG.shuffle(ids)
    return dict(zip(ids, texts, strict=True)), spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n long, ids long")


def test_token_output_round_trip(spark, tmp_path):
    texts, df = docs(spark)
    token_output.write_tokens(df, f"file://{tmp_path}/out", shards=3)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, r.ids) for r in token_output.read_tokens(spark, f"file://{tmp_path}/out").collect()}
    tool, start = library(FILES["space"]), 0
    for d in sorted(texts):
        ids = [*tool.encode(texts[d] or "", add_special_tokens=False).ids, 2]
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    assert len(got) == len(texts)


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    for bits in (0, 1, 8, 9, 16, 17, 24, 32):
        for n in (0, 1, 3, 4, 5, 100):
            v = rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
            control, data = token_output.pack(v)
            assert len(control) == -(-n // 4)
            assert (token_output.unpack(control, data, n) == v).all()


def test_token_counts(spark):
    texts, df = docs(spark)
    tool = library(FILES["space"])
    sizes = [len(tool.encode(t or "", add_special_tokens=False).ids) for t in texts.values()]
    sums = token_counts.with_suffix_sums(token_counts.length_histogram(df))
    for r in sums.collect():
        assert r.n_docs == Counter(sizes)[r.n_tokens]
        assert r.docs_over == sum(s > r.n_tokens for s in sizes)
        assert r.tokens_over == sum(s for s in sizes if s > r.n_tokens)
        assert r.tokens_kept == sum(min(s, r.n_tokens) for s in sizes)
    assert {r.context_limit: (r.docs_over, r.tokens_kept) for r in token_counts.totals(sums, [0, 5, 10**6]).collect()} == {c: (sum(s > c for s in sizes), sum(min(s, c) for s in sizes)) for c in (0, 5, 10**6)}
    half = token_counts.quantiles(sums, [0.5]).first().n_tokens
    assert half == sorted(sizes)[-(-len(sizes) // 2) - 1]


def check_packing(rows, limit):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(n for _, n in s) <= limit
    return len(sequences)


def test_packing(spark):
    texts, df = docs(spark)
    rows = packing.best_fit_packing(df, limit=64).collect()
    tool = library(FILES["word"])
    expected = {}
    for d, t in texts.items():
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 64)):
            part = ids[a : a + 64]
            expected[d, k] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    assert check_packing(rows, 64) <= -(-sum(n for _, n, _ in expected.values()) // 64) + 2


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        limit = rng.randint(1, 60)
        counts = {rng.randint(1, limit): rng.randint(1, 30) for _ in range(rng.randint(0, 20))}
        room = []
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            k = min((r for r in room if r >= n), default=None)
            if k is None:
                room.append(limit - n)
            else:
                room.remove(k)
                room.append(k - n)
        slots = packing.plan(counts, limit)
        used = {first + (r - a) // each for _, a, b, first, each, _ in slots for r in range(a, b)}
        assert len(used) == len(room)


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.best_fit_packing(empty).collect() == []
    assert token_counts.with_suffix_sums(token_counts.length_histogram(empty)).collect() == []
    token_output.write_tokens(empty, f"file://{tmp_path}/none")
    assert token_output.read_tokens(spark, f"file://{tmp_path}/none").collect() == []


ADDED = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>"]


@pytest.mark.parametrize("cut", ["space", "word"])
def test_added_tokens_get_the_ids_of_the_library(cut):
    rng = random.Random(6)
    texts = ["hello <|endoftext|> world", *ADDED, *["".join(rng.choice(PARTS + 4 * ADDED) for _ in range(rng.randint(0, 14))) for _ in range(3000)]]
    tool, expected = tokens.Encoder(tokens.tokenizer_path(FILES[cut]), cut, added=True), Tokenizer.from_file(tokens.tokenizer_path(FILES[cut]))
    for i in range(0, len(texts), 400):
        ids, sizes = tool.encode(some := texts[i : i + 400])
        assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in expected.encode_batch(some, add_special_tokens=False)]


def test_added_tokens_that_take_white_space_along(tmp_path):
    from tokenizers import AddedToken

    expected = Tokenizer.from_file(tokens.tokenizer_path(FILES["space"]))
    expected.add_tokens([AddedToken("<x>", lstrip=True, rstrip=True)])
    expected.save(f"{tmp_path}/t.json")
    texts = ["a <x> b", "", "<x>", "c <|endoftext|>"]
    ids, sizes = tokens.Encoder(f"{tmp_path}/t.json", "space", added=True).encode(texts)
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in expected.encode_batch(texts, add_special_tokens=False)]


def test_queries_with_added_tokens(spark, tmp_path):
    texts = {1: "hello <|endoftext|> world", 2: "<|endoftext|><|startoftext|>", 3: "plain", 4: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    ids = {cut: {d: Tokenizer.from_file(tokens.tokenizer_path(FILES[cut])).encode(t or "", add_special_tokens=False).ids for d, t in texts.items()} for cut in FILES}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op6_token_output(spark, str(tmp_path)).collect()}
    start = 0
    for d in sorted(texts):
        own = [*ids["space"][d], 2]
        assert got[d] == (start, len(own), crc(own))
        start += len(own)
    assert {r.n_tokens: r.n_docs for r in queries.op1_token_counts(spark, str(tmp_path)).collect()} == Counter(map(len, ids["space"].values()))
    packed = {d: (len(x) + 1, crc([*x, 1])) for d, x in ids["word"].items()}
    assert {r.doc_id: (r.length, r.ids_crc32) for r in queries.op10_packing(spark, str(tmp_path)).collect()} == packed
    assert {r.doc_id: (r.length, r.ids_crc32) for r in corpus_pipeline.packing_stage(spark, df, str(tmp_path)).collect()} == packed
