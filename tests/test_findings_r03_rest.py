"""Findings of round 3 that were settled later: the whole job at sizes and on texts that the former steps couldn't do."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from lumenote.functions import captions, language, text
from lumenote.llm import suffix_dedup
from lumenote.operators import cosine, near


def test_mentions_are_sought_near_figures_only(spark):
    """F8: what is far from any `fig` is left out of the search, and the mentions found are those of the whole text."""
    rng = random.Random(8)
    bits = ["fig", "Fig. ", "figura ", "FIGURAS", "(", ")", " 3", "3.1", "-2", ".", "\n", "  \n ", "; ", "a", "uma palavra ", "x" * 14, "y" * 90, "z" * 210, " " * 30, "A1", "é", "ſ", "1"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, t string").repartition(4)
    whole = lambda t: F.regexp_extract_all(t, F.lit(captions.MENTION), F.lit(1))
    number = lambda t: F.regexp_extract_all(t, F.lit(captions.MENTION), F.lit(2))
    near = captions._about_figures(F.col("t"))
    got = rows.select(whole(F.col("t")).alias("a"), whole(near).alias("b"), number(F.col("t")).alias("c"), F.transform(whole(near), lambda w: F.regexp_extract(w, captions.MENTION, 2)).alias("d")).collect()
    assert sum(len(r.a) for r in got) > 300 and all(r.a == r.b and r.c == r.d for r in got)
    far = spark.createDataFrame([("palavra " * 200_000 + "veja bem a figura 3",)], "t string").select(F.length(captions._about_figures(F.col("t"))).alias("n")).first().n
    assert far < 300


def test_many_captions(spark):
    page = "\n".join(f"Figura {i % 50}: legenda número {i}" for i in range(500)) + "\ne tudo isto se vê na figura 77 outra vez"
    got = spark.createDataFrame([(page,)], "t string").select(captions.page_captions(F.col("t")).alias("f")).first().f
    want = {n: w for n, w in re.findall(r"(?im)^figura (\d+): (.*)$", page)} | {"77": "e tudo isto se vê na figura 77"}
    assert [tuple(x) for x in got] == list(want.items())


def test_vectors_visit_few_blocks_of_themselves(spark, monkeypatch):
    """F6, F15, F16, F17, F21: a table that meets itself sends each vector to about half of the blocks, in few large ones."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 16))
    v[300:340] = v[7]
    rows = near.usable(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "n long, e array<double>"), "n", "e")
    monkeypatch.setattr(near, "BLOCK", 10)
    sent = near.block_pairs(rows, rows, 0.6).count()  # 8 blocks and more
    assert sent < 400 * 16
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    away = np.round(1 - u @ u.T, 12)
    np.fill_diagonal(away, 9)
    earlier = {a: int(np.flatnonzero(away[a, :a] < 0.6)[0]) for a in range(400) if (away[a, :a] < 0.6).any()}
    assert {r.id: r.least for r in near.earliest_near(rows, rows, 0.6).collect()} == earlier
    best = {a: int(away[a].argmin()) for a in range(400) if away[a].min() < 0.6}
    assert {r.id: r.near for r in near.nearest_within(rows, rows, 0.6).collect()} == best


def test_dense_tiles_agree_with_single_pairs(monkeypatch):
    rng = np.random.default_rng(7)
    x, y = (np.repeat(m, 9, axis=0) / np.linalg.norm(np.repeat(m, 9, axis=0), axis=1, keepdims=True) for m in (rng.normal(size=(20, 3)), rng.normal(size=(30, 3))))
    monkeypatch.setattr(near, "TILE", 1000)
    monkeypatch.setattr(near, "TILE_COLUMNS", 50)
    for most in (0.01, 0.6, 1.9):
        want = {(r, c): d for r, c, d in zip(*np.nonzero(1 - x @ y.T < most), np.round(1 - x @ y.T, 12)[1 - x @ y.T < most], strict=True)}
        got = {(r, c): d for rs, cs, ds in near.near_pairs(x, y, most) for r, c, d in zip(rs, cs, ds, strict=True)}
        assert got == want


def test_regions_meet_once(spark, monkeypatch):
    """pipeline: repeated passages are told with one join on regions, which makes a row of each row."""
    text = "".join(chr(97 + i * i % 23) for i in range(400))
    docs = spark.createDataFrame([(i, f"{i:05d}" * 30 + text + f"{i:07d}" * 30) for i in range(40)], "doc_id long, text string")
    rows, names, kept = {}, [], suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name="step": (names.append(name), rows.setdefault(name, (out := kept(df, name)).count()), out)[-1])
    suffix_dedup.repeated_ranges(docs)
    assert "counted" not in names and rows["shared"] <= rows["regions"] and rows["known"] <= rows["kinds"]


def test_phrases_with_shared_beginnings():
    """the pattern finds the same as one that lists the phrases."""
    rng = random.Random(24)
    for phrases in (language.ACTION, (*language.REAL_TIME, *language.PASSING), language.PERSONAL, ["a.b", "a.", "[x", "-]^"]):
        listed, shared = re.compile("|".join(map(re.escape, phrases))), re.compile(text.begins_shared(phrases))
        for _ in range(400):
            said = "".join(rng.choice([p[: rng.randrange(len(p) + 1)] for p in rng.sample(list(phrases), 3)] + [" ", "x"]) for _ in range(4))
            assert bool(listed.search(said)) == bool(shared.search(said)), said
        assert all(shared.search(p) for p in phrases) and shared.pattern.count("|") < len(phrases) * 2


def test_function_words_are_looked_up(spark):
    """function words are found in a set, not along a list for each word."""
    frame = spark.createDataFrame([("The end of THE de para ç não",), ("",), (None,)], "t string")
    rows = frame.select(language.function_words(F.col("t"), language.ENGLISH).alias("en"), language.english_title(F.col("t")).alias("title"))
    assert [r.en for r in rows.collect()][:2] == [3, 0] and [r.title for r in rows.collect()] == [False, False, None]
    assert " INSET " in rows._jdf.queryExecution().optimizedPlan().toString()


def test_products_stay_small():
    """what a task holds of a search is bounded by k rows a query and one product of 2^20 numbers."""
    assert cosine.PRODUCT <= 1 << 20
