"""WARC archives, exact top-k search and decontamination."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import random

import numpy as np
import pytest

from lumenote.llm import decontam, topk, warc


def test_members_of_any_writer():
    rng = random.Random(1)
    records = [warc.record(f"urn:page:{i}", rng.choice(["response", "revisit"]), rng.choice([None, "http://x/\n a"]), "urn:page:0", rng.randbytes(rng.choice([0, 10, 3000, 70000]))) for i in range(30)]
    own = b"".join(map(warc.member, records))
    assert gzip.decompress(own) == b"".join(records)
    for data in (own, b"".join(map(gzip.compress, records))):
        assert [h + b"\r\n\r\n" + rest() for h, _, rest in warc.members(data)] == records


def test_archive_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT", 200)
    pages = [(5, "u", "same"), (2, "u", "same"), (9, None, None), (7, "a b\n", ""), (1, "u", "é" * 500), (3, "u", "é" * 500), (None, "u", "lone")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    warc.write_pages(df, f"file://{tmp_path}/w")
    first = {}
    for p, _, h in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h or "", p)
    expected = set()
    for p, _, h in pages:
        body = (h or "").encode()
        owner = first.get(h or "", p)
        again = p is not None and owner != p
        expected.add((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", owner if again else None))
    assert set(map(tuple, warc.read_pages(spark, f"file://{tmp_path}/w").collect())) == expected
    source = spark.read.format("warc").load(f"file://{tmp_path}/w")
    assert {r.record_id for r in source.filter("record_type = 'revisit'").collect()} == {f"urn:page:{p}" for p, _, _, kind, _ in expected if kind == "revisit"}
    assert source.filter("record_id IN ('urn:page:2', 'urn:page:5')").count() == 2


def test_empty_archive(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_pages(empty, f"file://{tmp_path}/w")
    assert warc.read_pages(spark, f"file://{tmp_path}/w").collect() == []


def test_appends_overwrites_and_other_writers(spark, tmp_path):
    path, schema = f"file://{tmp_path}/w", "page_id long, url string, html string"
    read = lambda: {r.page_id: r.payload_digest for r in warc.read_pages(spark, path).collect()}
    warc.write_pages(spark.createDataFrame([(1, "u", "a"), (2, "u", "b" * 5000)], schema), path, archive_bytes=100)
    warc.write_pages(spark.createDataFrame([(3, "u", "c")], schema), path)
    assert set(read()) == {1, 2, 3}
    (tmp_path / "w" / f"{warc.OURS}failed.warc.gz").write_bytes(b"half a member of a failed attempt")
    big = b"x" * (3 * warc.CHUNK)
    (tmp_path / "w" / "theirs.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(f"urn:page:{i}", "response", "u", None, x)) for i, x in ((4, b"d"), (5, big), (6, b""))))
    (tmp_path / "w" / "plain.warc").write_bytes(b"".join(warc.record(f"urn:page:{i}", "response", "u", None, x) for i, x in ((7, b"e" * 9000), (8, b""))))
    assert read() == {i: warc.digest(x) for i, x in {1: b"a", 2: b"b" * 5000, 3: b"c", 4: b"d", 5: big, 6: b"", 7: b"e" * 9000, 8: b""}.items()}
    one = spark.read.format("warc").load(f"{path}/theirs.warc.gz")
    assert {r.record_id for r in one.filter("record_id <> 'urn:page:5'").collect()} == {"urn:page:4", "urn:page:6"}
    warc.page_records(spark.createDataFrame([(9, "u", "z")], schema)).write.format("warc").mode("overwrite").save(path)
    assert set(read()) == {4, 5, 6, 7, 8, 9}


@pytest.mark.parametrize(("n", "bits", "group"), [(300, 20, 16), (60, 64, 8192), (5, 3, 1)])
def test_top_k(spark, monkeypatch, n, bits, group):
    monkeypatch.setattr(topk, "GROUP", group)
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(n, bits))
    vectors[n // 2 :: 3] = vectors[0]  # many copies
    rows = [(int(i), v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(n, None, "x"), (n + 1, [None] * bits, "x"), (n + 2, [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string")
    got = {(r.query_id, r.rank): (r.neighbour_id, r.distance) for r in topk.exact_top_k(df, df.filter("vec_id % 7 = 0"), 4).collect()}
    signs = vectors > 0
    expected = {}
    for q in range(0, n, 7):
        near = sorted((int((signs[q] != signs[i]).sum()), i) for i in range(n) if i != q)[:4]
        expected |= {(q, k + 1): (i, d) for k, (d, i) in enumerate(near)}
    assert got == expected


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.exact_top_k(df, df).collect() == []


def test_masks_find_any_two_substitutions():
    for x in range(decontam.WINDOW):
        for y in range(x):
            assert any(x - s not in m and y - s not in m for m in decontam.MASKS for s in range(decontam.WINDOW - decontam.SPAN + 1))


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = {i: [word() for _ in range(n)] for i, n in enumerate((30, 13, 9, 5, 60))}

    def changed(words, places):
        return [word() + "z" if i in places else w.upper() for i, w in enumerate(words)]

    prose = lambda n: [word() + "x" for _ in range(n)]
    texts = {
        0: prose(20) + items[0] + prose(5),
        1: prose(3) + changed(items[0], range(0, 30, 6)) + prose(3),
        2: changed(items[1], {4, 9}),
        3: changed(items[1], {2, 4, 9}),
        4: items[2],
        5: items[3],
        6: prose(80),
        7: items[4][20:40] + prose(10),
        8: items[4][50:],
        9: [],
    }
    docs = spark.createDataFrame([(d, ", ".join(t), "x", 1) for d, t in texts.items()] + [(10, None, "x", 1)], "doc_id long, text string, seed string, place int")
    bench = spark.createDataFrame([(i, " ".join(t), "y") for i, t in items.items()] + [(9, None, "y"), (0, " ".join(items[0]), "y")], "item_id long, text string, t string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert found == {(0, 0), (1, 0), (2, 1), (4, 2), (7, 4)}
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [3, 5, 6, 8, 9, 10]
    assert decontam.clean(docs, bench).columns == docs.columns
    assert decontam.leaks(docs, bench.limit(0)).collect() == []
    assert decontam.leaks(docs.limit(0), bench).collect() == []


def test_decontamination_without_broadcast(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (2, "other")], "doc_id long, text string")
    bench = spark.createDataFrame([(3, text)], "item_id long, text string")
    monkeypatch.setattr(decontam, "MOST_BROADCAST", 0)
    assert [(r.doc_id, r.item_id, r.best_window, r.matched) for r in decontam.leaks(docs, bench).collect()] == [(1, 3, 13, 20)]


def allowed(n):
    return n - next(k for k in range(n + 1) if 5 * k >= 4 * n)


def test_masks_of_short_items_find_all_allowed_changes():
    for n in range(1, decontam.WINDOW):
        span = max(x for x in decontam.SHORT if x <= n)
        for places in itertools.combinations(range(n), allowed(n)):
            assert any(not set(places) & set(m) for m in decontam.short_masks(span))


def test_decontamination_equals_all_alignments(spark):
    rng = random.Random(9)
    items = {n: [f"i{n}t{k}" for k in range(n)] for n in (*range(1, 15), 20)}
    items[30], items[31] = ["a", "b"], ["a", "b", "a", "b", "a", "c"]
    texts = {0: [], 1: ["a", "b", "a", "b", "a", "b"], 2: ["x"]}
    for n in range(1, 15):
        for changes in range(allowed(min(n, 13)) + 2):
            for places in rng.sample(some := list(itertools.combinations(range(n), changes)), min(len(some), 12)):
                near = [f"z{k}" if k in places else w for k, w in enumerate(items[n])]
                texts[len(texts)] = ["y"] * rng.randint(0, 3) + near + ["y"] * rng.randint(0, 3)
    expected = {}
    for (d, t), (i, u) in itertools.product(texts.items(), items.items()):
        w, judged = min(13, len(u)), []
        for shift in range(w - len(u), len(t) - w + 1):
            equal = [t[k + shift] == u[k] for k in range(max(0, -shift), min(len(u), len(t) - shift))]
            best = max((sum(equal[s : s + w]) for s in range(len(equal) - w + 1)), default=0)
            if 5 * best >= 4 * w:
                judged.append((shift, best, sum(equal)))
        if judged:
            expected[d, i] = (len(judged), min(j[0] for j in judged), max(j[1] for j in judged), max(j[2] for j in judged))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(u)) for i, u in items.items()] + [(99, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_places, r.first_place, r.best_window, r.matched) for r in decontam.leaks(docs, bench, shortest=1).collect()}
    assert got == expected
