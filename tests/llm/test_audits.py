"""Harmonic packing, source divergence and filter interaction against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from tokenizers import Tokenizer

from lumenote.llm import divergence, filter_audit, harmonic, queries, tokens

RNG = random.Random(11)


def words(n, of=("casa", "rio", "Mar", "ÉPOCA", "x-y", "a1b", "niño", "日本")):
    return " ".join(RNG.choice(of) for _ in range(n))


@pytest.fixture(scope="module")
def packed_docs(spark):
    texts = [None, "", "uma", words(3), words(700), words(5000), words(5000), "<|endoftext|> fim", *[words(RNG.randint(0, 90)) for _ in range(60)]]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(9, texts[9], "x", 1, 2), (None, "sem id", "x", 1, 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, part string, length long, nth long").repartition(5)


def test_harmonic_packing(packed_docs):
    rows, df = packed_docs
    library = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    want = Counter((d, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for d, t, *_ in rows)
    got = harmonic.harmonic_packing(df, limit=256, added=True).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for some in by_sequence.values():
        end = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end == 256 or end & (end - 1) == 0  # no padding at all
    total = sum(len(ids) for _, ids in want.elements())
    assert len(by_sequence) <= total // 256 + 8 and sum(r.length for r in got) == total
    for doc, ids in want:
        copies = want[doc, ids]
        pieces = Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc])
        assert set(pieces.values()) == {copies}
        end = 0
        for start, n, crc, whole in sorted(pieces):
            assert start == end and whole == len(ids) and crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
            end += n
        assert end == len(ids)


@pytest.mark.parametrize("rest", range(0, 64))
def test_harmonic_places_for_any_rest(rest):
    pieces = harmonic.last_sequence(rest)
    assert sum(n for _, n in pieces) == rest and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False))
    length, row = harmonic.cuts(np.array([rest + 1, 64, 64 + rest + 1]), 64)
    assert np.bincount(row, length).tolist() == [rest + 1, 64, 65 + rest] and set(length.tolist()) <= set(harmonic.classes(64).tolist())


def test_harmonic_limits(spark):
    with pytest.raises(ValueError):
        harmonic.classes(100)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert harmonic.harmonic_packing(empty).collect() == []


def plain_divergence(rows, least_docs, top):
    docs = [(lang or "", source or "", [m.translate({c: c + 32 for c in range(65, 91)}) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        found = Counter(t for la, _, ts in docs if la == lang for t in set(ts))
        kept = {t for t, n in found.items() if n >= least_docs}
        groups = {s: Counter(t for la, g, ts in docs if (la, g) == (lang, s) for t in ts if t in kept) for la, s, _ in docs if la == lang}
        whole = sum(groups.values(), Counter())

        def share(counts, t, v=len(kept)):
            return 1 + 1_000_000_000 * (counts[t] + 5) // (sum(counts.values()) + 5 * v)

        for s, own in groups.items():
            pair = [(sum(abs(share(own, t) - share(other, t)) for t in kept), o) for o, other in groups.items() if o != s]
            term = [(share(own, t) - share(whole, t), t) for t in kept if own[t] and share(own, t) > share(whole, t)]
            for part, found_here, most in (("pair", pair, None), ("term", term, top)):
                for k, (value, item) in enumerate(sorted(found_here, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.append((lang, s, part, item, value, k + 1))
    return Counter(out)


def divergence_rows():
    vocabulary = ["Casa", "rio", "mar", "ÁGUA", "água", "é", "日本", "a", "zz", "İ", "�", "🎉"]
    rows = []
    for i in range(300):
        lang, source = RNG.choice(["pt", "pt", "pt", "ja", None, "xx"]), RNG.choice(["s1", "s2", "S2", "é", None, ""])
        text = RNG.choice([" ", "1", "_", "\n"]).join(RNG.choice(vocabulary) + str(RNG.choice(["", "q", "r"])) for _ in range(RNG.randint(0, 30)))
        rows.append((i, None if i % 17 == 0 else "un" if lang == "xx" and i % 2 else text if lang != "xx" else "", lang, source))
    rows += [(None, "casa casa", "pt", "s1"), rows[5], rows[5]]
    rows += [(i, "só um", "solo", "única") for i in range(400, 404)]
    return rows


def test_divergence(spark, monkeypatch):
    rows = divergence_rows()
    df = spark.createDataFrame([(*r, 0, "y") for r in rows], "doc_id long, text string, lang string, source string, n long, term string").repartition(4)
    want = plain_divergence(rows, 4, 7)
    assert {p for _, _, p, *_ in want} == {"pair", "term"} and any(v == 0 for _, _, p, _, v, _ in want if p == "pair")
    for cells in (1 << 20, 12):  # one block a language, then many
        monkeypatch.setattr(divergence, "CELLS", cells)
        got = divergence.source_divergence(df, least_docs=4, top=7).collect()
        assert Counter(tuple(r) for r in got) == want
    assert divergence.source_divergence(df.limit(0)).collect() == []


def test_divergence_is_exact():
    counts = np.array([[0, 5, 10**14, 3], [1, 2, 3, 4 * 10**15]])
    totals = np.array([[10**14 + 7], [4 * 10**15 + 9]])
    assert divergence.shares(counts, totals).tolist() == [[1 + 10**9 * int(c) // int(t[0]) for c in row] for row, t in zip(counts, totals, strict=True)]
    p = np.random.default_rng(0).integers(0, 10**9, (7, 5))
    sums = {(i, int(j)): int(x) for i, others, values in divergence.pair_sums(p) for j, x in zip(others, values, strict=True)}
    assert sums == {(i, j): int(np.abs(p[i] - p[j]).sum()) for i in range(7) for j in range(i + 1, 7)}


def test_divergence_counts_are_handed_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    batches = [pa.RecordBatch.from_pydict({"lang": ["a", "b"], "source": ["s", "s"], "body": [b"um dois um", b"tres"]})] * 5
    total = Counter()
    for batch in divergence._counted(iter(batches)):
        for r in batch.to_pylist():
            total[r["lang"], r["term"], "n"] += r["n"]
            total[r["lang"], r["term"], "docs"] += r["docs"]
    assert total["a", "um", "n"] == 10 and total["a", "um", "docs"] == 5 and total["b", "tres", "n"] == 5


def audit_rows():
    pool = ["", " ", None, "WORD " * 120, words(150, [f"w{i}" for i in range(400)]), " ".join(f"p{i}" for i in range(100)), " ".join(f"p{i}" for i in range(99)), " ".join(f"Q{i}" for i in range(130))]
    pool += [pool[5] + " #", pool[5] + " x", pool[4] + " a a a", "é" * 50 + "AB", words(300) + "|", "É " * 200, " ".join(["x"] * 20 + [f"p{i}" for i in range(80)]), "a\x1cb\x0bc\x85d"]
    docs = [(i, RNG.choice(pool), RNG.choice(["pt", "en", "", None])) for i in RNG.sample(range(10_000), 220)]
    docs += [docs[3], docs[3], (None, docs[4][1], "pt"), (None, docs[4][1], "pt")]
    labels = [(d, RNG.choice([0, 1, None]), RNG.choice([0, 1, None])) for d, _, _ in docs[:150]] + [(docs[0][0], 1, 0), (docs[0][0], 0, 1), (None, 1, 1), (-5, 1, 1)]
    return docs, labels


def plain_audit(docs, labels):
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    texts = defaultdict(list)
    for d, t, _ in docs:
        if d is not None:
            texts[t or ""].append(d)
    by_part = defaultdict(list)
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t), d is not None and any(x < d for x in texts[t])), strict=True) if x}
        by_part[lang or ""].append((d, fails))
    out = {}
    for part, rows in by_part.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(removed)
                failing = [r for r in rows if f in r[1]]
                out[part, "".join(order), step + 1] = [len(left), len(removed), len(failing) - len(removed), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in removed), sum(r[0] in toxic for r in removed)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                out[part, "".join(order), step + 1].append(shapley[f])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark):
    docs, labels = audit_rows()
    df = spark.createDataFrame([(*r, 1, "z", "z") for r in docs], "doc_id long, text string, lang string, n long, part string, fails string").repartition(3)
    marks = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, lang string")
    got = filter_audit.filter_audit(df, marks).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == plain_audit(docs, labels) and len(got) == 600 * 3
    assert filter_audit.filter_audit(df.limit(0), marks).collect() == []
    assert sum(r.good_lost + r.toxic_lost for r in filter_audit.filter_audit(df, marks.limit(0)).collect()) == 0


def test_registered_parameters(spark):
    rows = queries.QUERIES["op11_harmonic_packing"](spark, "/root/testdata/sf0.001").collect()
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    short = sorted(n for n in used.values() if n != 2048)
    assert all(n & (n - 1) == 0 for n in short) and len(short) <= 11
