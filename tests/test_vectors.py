"""Cosine comparison and the vector index against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from lumenote.operators import cosine, ranking, vector_index

DATA = "/root/testdata"


def rows(kind):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 5)).round(1)
    v[40:50], v[50] = v[3], 0
    v[60] = 2 * v[3]
    out = [(i, x.tolist(), [None, "a", "b", "c"][i % 4], float(i % 3) / 2 if i % 5 else None) for i, x in enumerate(v)]
    out += [(90, None, "a", 0.5), (91, [1.0, None, 0.0, 0.0, 1.0], "a", 0.5), (92, [1.0, 2.0], "b", 0.5), (93, [2.0, 4.5], "b", 0.5), (94, [float("nan")] * 5, "b", 0.5), (95, [], "a", 0.5)]
    return [(f"n{i:03d}" if kind == "string" else i, *x) for i, *x in out]


def plain(every, asked, k=None, below=None, agree=False, differ=False, others=False):
    found = []
    for qi, q, qg, qc in asked:
        mine = []
        for i, v, g, _ in every:
            if q is None or v is None or len(q) != len(v) or None in q or None in v or not np.isfinite(q + v).all() or not np.any(q) or not np.any(v) or (others and i == qi):
                continue
            if (agree or differ) and (g is None or qg is None or (g == qg) != agree):
                continue
            away = round(float(1 - np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)), 9) + 0.0
            cut = qc if below == "cut" else below
            if below is not None and (cut is None or not away < cut):
                continue
            mine.append((away, i, qi))
        found += sorted(mine)[:k]
    return sorted((q, i, d) for d, i, q in found)


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("numbers", [1 << 20, 1])
def test_compared(spark, monkeypatch, kind, numbers):
    monkeypatch.setattr(cosine, "TILE_QUERIES", 7)
    monkeypatch.setattr(cosine, "TILE_VECTORS", 11)
    every = rows(kind)
    asked = [r for i, r in enumerate(every) if i % 4 != 1 or i > 89]  # no query has the group a but the odd ones
    schema = f"n {kind}, e array<double>, g string, cut double"
    frame, queries = spark.createDataFrame(every, schema).repartition(3), spark.createDataFrame(asked, schema)
    for rule in ({"k": 3}, {"k": 4, "others": True}, {"below": 0.3}, {"below": "cut", "others": True}, {"k": 2, "agree": "g", "others": True}, {"k": 2, "differ": "g"}, {"below": 0.7, "differ": "g", "k": 50}, {"agree": "g"}):
        got = cosine.compared(frame, queries, "n", "e", most_numbers=numbers, **rule).collect()
        want = plain(every, asked, **{k: v if k not in ("agree", "differ") else True for k, v in rule.items()})
        assert sorted((r.query_id, r.id, round(r.distance, 9) + 0.0) for r in got) == want, rule
        if "k" not in rule:
            counts = {r.query_id: r.n for r in cosine.compared(frame, queries, "n", "e", most_numbers=numbers, count=True, **rule).collect()}
            assert counts == {q: sum(x[0] == q for x in want) for q in {x[0] for x in want}}


def test_same_answer_at_every_size(spark):
    """Parallel vectors tie; ids decide, whichever way the comparison runs."""
    base = np.random.default_rng(1).normal(size=8)
    frame = spark.createDataFrame([(i, (base * (1 + i % 7) / 3).tolist()) for i in range(200)], "n long, e array<double>").repartition(5)
    answers = [[tuple(r) for r in ranking.nearest(frame, frame.filter("n % 10 = 0"), "n", "e", 3, most_numbers=m).orderBy("query_id", "place").collect()] for m in (1 << 20, 1)]
    assert answers[0] == answers[1] and {a[1] for a in answers[0]} == {0, 1, 2}


def clustered(n, dims=24, seed=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(60, dims))
    return (centre[rng.integers(60, size=n)] + 0.7 * rng.normal(size=(n, dims))).round(4)


def test_index_recall_and_filter(spark):
    v = clustered(6000)
    frame = spark.createDataFrame([(i, x.tolist(), i % 9, "pt" if i % 100 else "rare") for i, x in enumerate(v)], "n long, e array<double>, g long, lang string")
    # the sample is a sixth of the rows, so searches go through chosen lists
    index = vector_index.build_index(frame, "n", "e", ["g", "lang"], sample_numbers=1000 * 24)
    assert index.sample_rows == 1000 and index.probes < len(index.centroids) and index.lists.count() == 6000
    asked = frame.filter("n % 50 = 0")
    for where in (None, "g < 6", "lang = 'rare'", "lang = 'none'"):
        some = frame if where in (None, "lang = 'none'") else frame.filter(where)
        exact = ranking.nearest(some, asked, "n", "e", 10)
        found = index.search(asked, "n", "e", 10, where).cache()
        share = [r.recall for r in vector_index.recall(found, exact).collect()]
        assert len(share) == 120 and np.mean(share) >= (1 if where == "lang = 'rare'" else 0.9), where
        by_list = index.search(asked, "n", "e", 10, where, most_numbers=1)
        assert {tuple(r) for r in by_list.collect()} == {tuple(r) for r in found.collect()}
    plan = index.lists.filter("g = 3")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(g), EqualTo(g,3)]" in plan


def test_index_of_odd_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.1]), (5, [1.0, 2.0, 3.0]), (6, [None, 1.0])], "n long, e array<double>")
    index = vector_index.build_index(frame, "n", "e")
    assert sorted((r.query_id, r.id) for r in index.search(frame, "n", "e", 10).collect()) == [(1, 1), (1, 4), (4, 1), (4, 4)]
    empty = vector_index.build_index(frame.limit(0), "n", "e")
    assert empty.search(frame, "n", "e", 10).collect() == []


def test_index_on_the_embeddings(spark):
    table = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    index = vector_index.build_index(table, "vec_id", "embedding", ["label"], sample_numbers=500 * 64)
    asked = table.filter("vec_id % 50 = 0")
    exact = ranking.nearest(table, asked, "vec_id", "embedding", 10)
    share = [r.recall for r in vector_index.recall(index.search(asked, "vec_id", "embedding", 10), exact).collect()]
    print(index.probes, len(index.centroids), np.mean(share))
    assert len(share) == 40 and np.mean(share) >= 0.9


def test_registered_index_search(spark):
    """The registered search finds at least 0.9 of what brute force finds."""
    from lumenote.plans.registry import QUERIES

    table = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    exact = ranking.nearest(table.filter("label < 6"), table.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    share = [r.recall for r in vector_index.recall(QUERIES["h2_index_search"](spark, f"{DATA}/sf0.1"), exact).collect()]
    assert len(share) == 40 and np.mean(share) >= 0.9


def test_consolidation_plan(spark):
    from lumenote.operators import dedup
    from lumenote.plans.registry import QUERIES

    rows = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    first = {}
    for r in rows:
        source = ("Figuras/" if r.vec_id % 5 == 0 else "Atomos/") + f"{r.vec_id // 2}.md"
        if source.startswith("Atomos/"):
            first.setdefault(source, (r.vec_id, np.array(r.embedding, float) / np.linalg.norm(r.embedding)))
    led, of = [], {}
    for source, (i, v) in sorted(first.items(), key=lambda x: x[1][0]):
        leader = next((j for j, w in led if 1 - v @ w < 0.7), None)
        if leader is None:
            led.append((i, v))
            leader = i
        of.setdefault(leader, []).append(source)
    groups = sorted(((-len(s), lead) for lead, s in of.items() if len(s) >= 3))[:50]
    want = sorted((lead, s, -n) for n, lead in groups for s in of[lead])
    got = sorted((r.leader, r.source, r.n) for r in QUERIES["j7_consolidation"](spark, f"{DATA}/sf0.001").collect())
    assert got == want and len(got) > 10
    odd = spark.createDataFrame([(1, "Atomos//a.md", [1.0, 0.0]), (2, "Atomos\\b.md", [1.0, 0.0]), (3, "Atomos/c.md", [1.0, 0.1]), (4, "Atomos/a.md", [0.0, 1.0]), (5, "AtomosX/d.md", [1.0, 0.0]), (6, None, [1.0, 0.0]), (7, "Atomos/e.md", None)], "id long, source string, vector array<double>")
    assert sorted(map(tuple, dedup.consolidation_plan(odd, "Atomos/", 0.1).collect())) == [(1, "Atomos/a.md", 3), (1, "Atomos/b.md", 3), (1, "Atomos/c.md", 3)]
