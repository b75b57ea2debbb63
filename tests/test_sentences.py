"""Sentences don't depend on how a reply is cut into pieces."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenote.plans.registry import QUERIES
from lumenote.streaming import quiet
from lumenote.streaming.sentences import Cutting, sentences, spoken

SMALL = Cutting(least=4, most=30, first=12)
TEXT = st.lists(st.sampled_from([*"ab .,!?…\n;3", "Sr.", "etc. ", "(ex.", "fim. ", ", ", "é"]), max_size=60).map("".join)


def whole(cutting, text):
    return cutting.go_on("", text, True, True)[0]


@settings(max_examples=600, deadline=None)
@given(TEXT, st.lists(st.integers(0, 130), max_size=20), st.sampled_from([SMALL, Cutting(4, 30, 0), Cutting(0, 5, 3), Cutting()]))
def test_any_cut_gives_the_same(text, cuts, cutting):
    places = sorted({0, len(text), *(min(c, len(text)) for c in cuts)})
    pieces = [text[a:b] for a, b in zip(places, places[1:], strict=False)] or [""]
    out, rest, opening = [], "", True
    for i, piece in enumerate(pieces):
        found, rest, opening = cutting.go_on(rest, piece, opening, i == len(pieces) - 1)
        out += found
    assert out == whole(cutting, text) and rest == ""
    assert "".join("".join(out).split()) == "".join(text.split())  # nothing is lost but white space
    assert all(len(s) <= cutting.most or not cutting.most for s in out)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Olá, tudo bem? Custa 3,5 reais. Fim", ["Olá,", "tudo bem?", "Custa 3,5 reais.", "Fim"]),
        ("O Sr. Rui, o dr. Sousa etc. vieram já. Sim.", ["O Sr. Rui,", "o dr. Sousa etc. vieram já.", "Sim."]),
        ("Ah! Sim... claro. x", ["Ah! Sim...", "claro.", "x"]),
        ("uma frase sem fim nem sinal que nunca mais acaba", ["uma frase", "sem fim nem sinal que nunca", "mais acaba"]),
        ("abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz", ["abcdefghijkl", "mnopqrstuvwxyzabcdefghijklmnop", "qrstuvwxyz"]),
        ("  ", []), ("", []),
    ],
)
def test_cases(text, want):
    assert whole(SMALL, text) == want


def test_column(spark):
    rows = spark.createDataFrame([(1, "Uma frase inteira, longa. Outra frase, ainda maior que a primeira! Fim"), (2, None)], "n int, t string")
    got = {r.n: r.s for r in rows.select("n", sentences(F.col("t"), SMALL).alias("s")).collect()}
    assert got == {1: whole(SMALL, rows.first().t), 2: []}


def test_stream_of_all_documents(spark):
    got = {}
    for r in QUERIES["c19_spoken_sentences"](spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.doc_id, {})[r.nth] = r.sentence
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect():
        want = whole(Cutting(), r.text or "")
        assert got.get(r.doc_id, {}) == {i: hashlib.md5(s.encode()).hexdigest() for i, s in enumerate(want)}


def test_pieces_twice_and_before_their_turn(spark, tmp_path):
    own = quiet.state_session(spark)
    steps = [[("a", 2, "duas. ", False), ("b", 0, "Só isto", True), ("a", 0, "Esta é a ", False)], [("a", 0, "Esta é a ", False), ("a", 1, "frase um. E ", False), ("b", 1, "nunca", True)], [("a", 3, None, True), ("a", 2, "duas. ", False)]]
    schema = "key string, seq int, piece string, last boolean"
    for rows in steps:
        own.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spoken(own.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), "key", SMALL)
        stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination()
    got = sorted((r.key, r.nth, r.sentence) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [("a", i, s) for i, s in enumerate(whole(SMALL, "Esta é a frase um. E duas. "))] + [("b", 0, "Só isto")]
