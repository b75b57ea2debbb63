"""Cases of the review of round 3: whole results where a step used to grow faster than its input."""

from __future__ import annotations

import random

import duckdb
import pytest

from lumenote.operators import cosine, graph, linking, ranking
from lumenote.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("most_numbers", [1 << 20, 0])
@pytest.mark.parametrize("count", [False, True])
def test_pairs_that_share_a_key(spark, most_numbers, count):
    """In the scan and in tiles, with keys of most queries (bits) and of few (lists), nulls, and queries without keys."""
    rnd = random.Random(5)
    keys = lambda i: None if i % 29 == 0 else ["often"] * (i % 3 > 0) + [f"k{rnd.randrange(300)}" for _ in range(i % 5)] + [None] * (i % 7 == 0)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(3)], keys(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<double>, ks array<string>")
    found = cosine.compared(df, df.filter("id % 3 = 0"), "id", "v", below=0.9, others=True, shared="ks", close=0.3, count=count, most_numbers=most_numbers)
    norm = lambda v: sum(x * x for x in v) ** 0.5
    away = lambda a, b: round(1 - sum(x * y for x, y in zip(a, b, strict=True)) / norm(a) / norm(b), 12)
    pairs = [(a[0], b[0], away(a[1], b[1]) < 0.3, bool({*(a[2] or ())} & {*(b[2] or ())} - {None})) for a in rows if a[0] % 3 == 0 for b in rows if a[0] != b[0] and away(a[1], b[1]) < 0.9]
    if count:
        wanted = {(q, len(mine), sum(x[3] for x in mine), sum(x[2] or x[3] for x in mine)) for q in range(0, 400, 3) if (mine := [x for x in pairs if x[0] == q])}
    else:
        wanted = {(q, b, shared) for q, b, close, shared in pairs if close or shared}
        found = found.drop("distance")
    assert {tuple(r) for r in found.collect()} == wanted


@pytest.mark.parametrize("dense", [8192, 0])
def test_candidates_in_tasks_and_by_joins(spark, monkeypatch, dense):
    """Both ways give the same, also for notes without concepts, concepts of no note, repeated and null notes."""
    monkeypatch.setattr(linking, "MOST_DENSE", dense)
    rnd = random.Random(3)
    words = ["azul", "casa", "porta", "rio", "ponte", "rio rio", "monte", "e", "é", "Ünico"]
    concepts = [f"{a} {b}" for a in words for b in words[:4]]
    edges = [(i if i % 11 else None, rnd.choice(concepts) if rnd.random() < 0.95 else None) for i in range(60) for _ in range(rnd.randrange(5))]
    notes = [(i, " ".join(rnd.choices(words, k=3)) if (i or 1) % 7 else None) for i in [*range(5, 80), 20, 20, None]]
    args = spark.createDataFrame(notes, "note int, text string"), spark.createDataFrame(edges, "note int, concept string")
    one, other = ({(r.note, r.place): (r.concept, round(r.score, 7)) for r in linking.candidate_concepts(*args, most=12, most_numbers=m).collect()} for m in (1 << 20, 0))
    assert one == other and len(one) > 500


def test_candidates_are_not_joined_by_words(spark):
    """What is shuffled for the scores are the notes: no join on words or concepts is left in the plan."""
    notes = spark.createDataFrame([(1, "azul casa")], "note int, text string")
    edges = spark.createDataFrame([(1, "azul"), (1, "casa")], "note int, concept string")
    assert "Join" not in linking.candidate_concepts(notes, edges)._jdf.queryExecution().optimizedPlan().toString()


def test_paper_titles_with_blanks(spark, tmp_path):
    """A blank at either end of a title counts, as in the SQL; so do odd line ends and missing parts."""
    titles = ["Hain, ha heeded (885) 555-1542 the and theaesti, heingha ", " abcdefg", "  Sobre o método das coisas - Revista  ", "[PDF] Foo bar baz e mais algumas coisas - Jornal", "curto", "Um título mesmo comprido e belo\n- Casa\n", ""]
    rows = [(i, u, f"<title>{t}</title>") for i, (t, u) in enumerate((t, u) for t in titles for u in ["http://a.b/c_d.pdf", "http://a.b/", None])] + [(99, "http://a.b/x", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in QUERIES["c40_paper_title"](spark, str(tmp_path)).collect()}
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == set(connection.execute(ORACLE_SQL["c40_paper_title"]).fetchall())


def test_best_documents_of_tasks_and_of_joins(spark, monkeypatch):
    """Ties at the cut, copies, repeated rows of a document, null texts and a null id, in blocks of a few documents."""
    monkeypatch.setattr(ranking, "SCORES", 20)
    rnd = random.Random(9)
    words = ["azul", "casa", "porta", "rio", "ponte", "monte", "de", "que"]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(1, 9))) for _ in range(40)]
    docs = [(i, rnd.choice(texts) if i % 13 else None) for i in range(200)] + [(7, texts[0]), (7, "rio azul azul"), (9, texts[1]), (9, texts[1]), (None, texts[2])]
    asked = [(i, " ".join(rnd.choices(words, k=3))) for i in range(12)] + [(12, "de que"), (13, None), (None, "rio ponte")]
    args = spark.createDataFrame(docs, "d int, text string").repartition(3), spark.createDataFrame(asked, "q int, text string"), "d", "q"
    one, other = (ranking.Retrieval(*args, most_asked=m) for m in (1 << 20, 0))
    for way in ("bm25", "shared"):
        a, b = ({(r.q, r.place): (r.d, round(r.score, 8)) for r in getattr(x, way)(6).collect()} for x in (one, other))
        assert a == b and len(a) > 60
    # no row for each query and document reaches a shuffle: the documents' counts are read and scored where they lie
    assert "Join" not in one.bm25(6)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [64, 3, 0])
def test_neighbours_without_a_row_for_each(spark, most):
    """Atoms that share several concepts, alone, and more than are met by pairs of concepts; nulls and repeated rows."""
    rnd = random.Random(2)
    rows = [(a, rnd.randrange(25)) for a in range(80) for _ in range(a % 7)] * 2 + [(90, 99), (91, None), (None, 3)]
    of = {}
    for a, c in rows:
        if a is not None and c is not None:
            of.setdefault(a, set()).add(c)
    wanted = {(a, n) for a in of if (n := sum(bool(of[a] & of[b]) for b in of if b != a))}
    df = spark.createDataFrame(rows, "atom long, concept long")
    assert {tuple(r) for r in graph.shared_neighbours(df, most).collect()} == wanted


def test_hot_concepts_of_neighbours_form_no_pairs(spark):
    """A concept of all atoms is one number: 20,000 atoms would meet in 400 million rows."""
    df = spark.range(20_000).selectExpr("id AS atom", "explode(array(-1L, id)) AS concept")
    assert graph.shared_neighbours(df).filter("neighbours = 19999").count() == 20_000


def test_tasks_of_cooccurrence_follow_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_PAIRS", 10)
    df = spark.range(40).selectExpr("id % 8 AS atom", "id AS concept")
    assert graph.cooccurrence(df).rdd.getNumPartitions() == 9 and graph.cooccurrence(df).count() == 80
