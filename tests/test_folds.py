"""Folds, masking, geometry, vault reading, clustering and streams against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenote.functions import folds, geometry, pii, text
from lumenote.operators import dedup, near, ordered, ranking, telemetry
from lumenote.plans import fold_queries, ranking_queries
from lumenote.sources import notes
from lumenote.streaming import monitors


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(column(F.col("s")).alias("out")).first().out


def batches(text, budget, separator):
    done, now = [], None
    for block in text.split(separator):
        if len(block) > budget:
            done += [now] * (now is not None) + [block[i : i + budget] for i in range(0, len(block), budget)]
            now = None
        elif now is None:
            now = block
        elif len(now + separator + block) > budget:
            done.append(now)
            now = block
        else:
            now += separator + block
    return [b for b in [*done, *([now] if now is not None else [])] if b.strip()]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab \n", max_size=40), min_size=1, max_size=8), st.integers(1, 20))
def test_batches(spark, parts, budget):
    whole = "|".join(parts)
    assert one(spark, lambda s: folds.batches(s, budget, "\\|"), whole) is not None
    assert one(spark, lambda s: folds.batches(s, budget, "\n"), whole) == batches(whole, budget, "\n")


def test_wikilinks(spark):
    assert one(spark, folds.wikilinks, "[[Solo]] [[solo|x]] [[A  b]] ![[img]] [[]]") == ["Solo", "A b"]


def test_masking(spark):
    s = "a.b@c.com 12.345.678/0001-90 123.456.789-09 4111 1111 1111 1111 e 4111111111111112 (41) 99999-1234 1234 5678"
    masked, kinds = (one(spark, lambda c, k=k: pii.masked(c)[k], s) for k in (0, 1))
    assert kinds == ["cartao", "cnpj", "cpf", "email", "telefone"]
    assert masked == "[email] [cnpj] [cpf] [cartao]e 4111111111111112 [telefone] 1234 5678"


def test_budget_and_near_duplicates(spark):
    items = [(1, 50, False), (2, 30, True), (3, 30, True), (4, 10, False), (5, 60, False), (6, 1, False)]
    assert one(spark, lambda s: folds.budgeted(s, 100, 0.4), items, "array<struct<id:long,size:int,figure:boolean>>") == [1, 2, 4]
    sets = [(1, list("abcdefghij")), (2, list("abcdefghij")), (3, list("abcdefghi")), (4, ["z"]), (5, [])]
    assert one(spark, lambda s: folds.near_duplicate_drop(s, 0.9), sets, "array<struct<id:long,tokens:array<string>>>") == [1, 4, 5]


def test_throttle_integral_breaker(spark):
    assert one(spark, lambda s: folds.throttled(s, 10.0), [0.0, 5.0, 10.0, 19.0, 21.0], "array<double>") == [0.0, 10.0, 21.0]
    readings = [(0.0, 0.0), (5.0, 10_000.0), (20.0, 40_000.0), (30.0, 10.0), (50.0, 20_010.0)]
    assert one(spark, lambda s: folds.integral_means(s, 10.0, 1e6), readings, "array<struct<s:double,mj:double>>") == [None, None, 2.0, None, 1.0]
    outcomes = [(0.0, False), (1.0, False), (2.0, False), (20.0, True), (21.0, False)]
    assert one(spark, lambda s: folds.breaker_opens(s, 2, 10.0), outcomes, "array<struct<s:double,ok:boolean>>") == [False, False, True, False, False]


def test_thinking_and_stems(spark):
    assert one(spark, folds.without_thinking, "<think>a\nb</think> fim") == "fim"
    assert [one(spark, lambda w: text.stem(text.normalised(w)), w) for w in ("flores", "animais", "balões", "homens", "sol", "tricomas")] == ["flor", "animal", "balao", "homem", "sol", "tricoma"]


def test_grounding(spark):
    got = one(spark, geometry.grounding, "x image[[10,20,300,1200]]\ncaption[[5,5,1,1]] Fig. 1")
    assert [(g.tag, tuple(g.box), g.content) for g in got] == [("image", (10, 20, 300, 999), ""), ("caption", (1, 1, 5, 5), "Fig. 1")]


def test_read_vault(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "n.md").write_text("---\norigem: Livro: x\n---\n## T\n[[Solo]]")
    (tmp_path / "b.txt").write_text("no")
    rows = notes.read_vault(spark, str(tmp_path)).select(notes.front_matter(F.col("text"))["origem"].alias("origem"), notes.without_front_matter(F.col("text")).alias("body")).collect()
    assert [(r.origem, r.body) for r in rows] == [("Livro: x", "## T\n[[Solo]]")]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters(spark, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(35)} | {(i, i + 1) for i in range(50, 62)}
    edges = spark.createDataFrame([(*p,) for p in pairs], "a long, b long")
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.label for r in dedup.clusters(edges).collect()} == label


@pytest.mark.parametrize("block", [4096, 7])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rng = np.random.default_rng(block)
    v = rng.normal(size=(60, 4))
    v[50:55], v[55] = v[3], 0
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(60, None), (61, [1.0, None, 0.0, 0.0])], "n long, e array<double>")
    rows = near.usable(frame, "n", "e")
    ids = [i for i in range(60) if i != 55]
    u = v[ids] / np.linalg.norm(v[ids], axis=1, keepdims=True)
    away = 1 - u @ u.T
    close = {(a, b) for x, a in enumerate(ids) for y, b in enumerate(ids) if a < b and away[x, y] < 0.1}
    lead = {}
    for n in ids:
        lead[n] = next((m for m in ids if m < n and lead[m] == m and (m, n) in close), n)
    assert {r.id: r.leader for r in dedup.leaders(rows, 0.1).collect()} == lead
    assert {r.id: r.kept for r in dedup.kept(rows, 0.1).collect()} == {n: lead[n] == n for n in ids}
    label = {n: n for p in close for n in p}
    for _ in label:
        for a, b in close:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.label for r in dedup.clusters(near.links(rows, 0.1)).collect()} == label
    np.fill_diagonal(away, 9)
    best = {r.id: (r.near, r.distance) for r in near.nearest_within(rows, rows, 0.3).collect()}
    assert set(best) == {n for x, n in enumerate(ids) if away[x].min() < 0.3}
    assert all(abs(s - away[ids.index(n)].min()) < 1e-9 for n, (_, s) in best.items())
    assert all(abs(away[ids.index(n), ids.index(m)] - s) < 1e-9 for n, (m, s) in best.items())
    top = {}
    for r in ranking.nearest(frame, frame.filter("n % 10 = 0"), "n", "e", 3, most_queries=2).collect():
        top.setdefault(r.query_id, []).append(round(r.distance, 9))
    np.fill_diagonal(away, 0)
    assert {q: sorted(x) for q, x in top.items()} == {q: sorted(np.abs(away[ids.index(q)]).round(9))[:3] for q in range(0, 60, 10)}


def test_ordered_folds(spark):
    times = spark.createDataFrame([("a", s) for s in (21.0, 0.0, 5.0, 10.0, 19.0)] + [("b", 3.0), (None, 1.0), ("b", None)], "k string, s double")
    assert {tuple(r) for r in ordered.throttled(times, "k", "s", 10.0).collect()} == {("a", 0.0), ("a", 10.0), ("a", 21.0), ("b", 3.0)}
    readings = [(1, i, s, mj) for i, (s, mj) in enumerate([(0.0, 0.0), (5.0, 10_000.0), (20.0, 40_000.0), (30.0, 10.0), (50.0, 20_010.0)])] + [(2, 0, 1.0, None)]
    watts = ordered.integral_means(spark.createDataFrame(readings, "u long, n long, s double, mj double"), "u", "n", "s", "mj", 10.0, 1e6)
    assert [r.watts for r in watts.orderBy("n").collect()] == [None, None, 2.0, None, 1.0]


def test_streak_and_percentile(spark):
    days = spark.createDataFrame([(1, "2024-01-28"), (1, "2024-01-29"), (1, "2024-01-26"), (2, "2024-01-20"), (3, "2024-01-30")], "u int, d string").withColumn("d", F.to_date("d"))
    assert {r.u: r.streak for r in telemetry.streaks(days, "u", "d", "2024-01-30").collect()} == {1: 2, 2: 0, 3: 1}
    ten = spark.createDataFrame([("k", float(i)) for i in range(1, 11)], "k string, v double")
    assert {r.share: r.v for r in telemetry.nearest_rank(ten, "k", "v", [0.5, 0.95]).collect()} == {0.5: 5.0, 0.95: 10.0}


def test_streams(spark, tmp_path):
    rows = [(1, f"2024-01-01 10:0{m}:00") for m in (0, 2, 4)] + [(1, "2024-01-01 12:00:00"), (2, "2024-01-01 10:00:00"), (3, "2024-01-02 12:00:00")]
    spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events")
    schema = spark.read.parquet(f"{tmp_path}/events").schema

    def run(name, make):
        stream = make(monitors.event_stream(spark, f"{tmp_path}/events", "*.parquet", schema))
        return monitors.available_now(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state").collect()

    assert sorted((r.user_id, r.n) for r in run("sessions", lambda e: monitors.sessions(e, "user_id", "30 minutes"))) == [(1, 1), (1, 3), (2, 1)]
    assert sorted((r.user_id, r.n) for r in run("hourly", lambda e: monitors.hourly(e, "user_id"))) == [(1, 1), (1, 3), (2, 1)]
    let = run("throttle", lambda e: monitors.throttle(e, "user_id", 180.0))
    assert sorted(r.user_id for r in let) == [1, 1, 1, 2, 3]


def test_candidates_are_whole_texts_of_any_document(spark, tmp_path):
    head = " ".join(f"palavra{i}" for i in range(50))
    one, two = (head + " " + " ".join(f"{t}{i}" for i in range(60)) for t in ("um", "dois"))
    texts = {i: f"outro texto {i}" for i in range(70)} | {8: one, 9: two, 68: one, 69: two + " fim"}
    spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, head), (1, "texto outro")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    places = sorted((r.item_id, -r.score, r.doc_id) for r in ranking_queries.h11(spark, str(tmp_path)).collect())
    lists = {i: [d for k, _, d in places if k == i] for i in (0, 1)}
    sets = {i: set(t.split()) for i, t in texts.items()}
    kept, chosen = set(), set()
    for item, found in lists.items():
        own = []
        for d in found:
            if all(len(sets[d] & sets[k]) / len(sets[d] | sets[k]) < 0.9 for k in own):
                own.append(d)
        kept |= {(item, d) for d in own}
        left, figures, any_yet = 12_000, 0, False
        for d in found:
            n = len(texts[d])
            if d % 3 == 0 and figures + n > 4800:
                continue
            figures += n * (d % 3 == 0)
            if any_yet and n > left:
                break
            chosen.add((item, d))
            left, any_yet = left - n, True
    assert {d for i, d in kept if i == 0} == {8, 9}
    assert {tuple(r) for r in fold_queries.h6(spark, str(tmp_path)).select("item_id", "doc_id").collect()} == kept
    assert {tuple(r) for r in fold_queries.h8(spark, str(tmp_path)).select("item_id", "doc_id").collect()} == chosen
