"""JSON in text against a character loop, upserts against rebuilt tables, figures beside what was found."""

from __future__ import annotations

import json
import random
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenote.functions import jsons
from lumenote.operators import linking
from lumenote.plans.registry import QUERIES
from lumenote.sources import store

RNG = random.Random(4)


def plain_objects(text):
    found, depth, start, quoted, skip = [], 0, 0, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif depth and quoted:
            skip, quoted = c == "\\", c != '"'
        elif depth and c == '"':
            quoted = True
        elif c == "{":
            start, depth = (i, 1) if not depth else (start, depth + 1)
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                found.append(text[start : i + 1])
    return found


def test_json_objects(spark):
    texts = ["".join(RNG.choice(['{', '}', '"', "\\", "a", "é", "\n", " ", "🎉", '{"a":', "}}"]) for _ in range(RNG.randint(0, 40))) for _ in range(3000)]
    texts += ["", "\\", '{"a": "}"}', '\\{"a":1}', '{\\"}"}', '{"\\\\"}x{}', '{"a": {"b": 1}} {c} {', "sem nada"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "n long, t string").select("n", jsons.json_objects(F.col("t")).alias("found"))
    got = {r.n: r.found for r in rows.collect()}
    assert got.pop(-1) is None
    assert got == {i: plain_objects(t) for i, t in enumerate(texts)}


def test_tool_call(spark):
    cases = {
        'vou usar {"tool": "abrir", "args": {"x": "a}b", "n": [1, 2]}} agora': ("abrir", {"x": "a}b", "n": [1, 2]}),
        '{sorriso} {"tool": 5} {"tool": ""} {"tool": "b", "args": 3}': ("b", {}),
        '{"args": {}} {"tool": "c"}{"tool": "d"}': ("c", {}),
        '{"tool": "x"': None, "": None, "nada": None, '[{"tool": "lista"}]': ("lista", {}),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", jsons.tool_call(F.col("t")).alias("call")).collect()
    assert {r.t: r.call and (r.call.tool, json.loads(r.call.args)) for r in rows} == cases


def test_registered_json_query(spark):
    import hashlib

    got = {r.doc_id: (r.n, r.objects, r.tool) for r in QUERIES["c23_json_objects"](spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect():
        t = r.text or ""
        call = json.dumps({"tool": "anotar", "args": {"texto": t, "sinais": '}{"'}}, ensure_ascii=False, separators=(",", ":"))
        found = plain_objects(f'{t} {{sorriso}} "ok {{"x"}} {call} fim {{{t}')
        assert got[r.doc_id][2] == "anotar" and got[r.doc_id][0] == len(found)
        if "\\" not in t:  # JSON texts may be spelled in several ways
            assert got[r.doc_id][1] == hashlib.md5("|".join(found).encode()).hexdigest()


def times(*minutes):
    return [datetime(2026, 2, 1, 10, m) for m in minutes]


@pytest.fixture
def folder(spark, tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def test_there_are_23_tables():
    from pyspark.sql.types import StructType

    assert len(store.TABLES) == 23
    for ddl, keys in store.TABLES.values():
        names = StructType.fromDDL(ddl).fieldNames()
        assert set(keys) <= set(names) and len(set(names)) == len(names)


def test_upserts_equal_a_rebuild(spark, folder):
    keys = [(k, o) for k in ("luz", "água", None) for o in ("ana", "rui", None)]
    rows = [(*RNG.choice(keys), f"t{i}", RNG.choice([1, 2, None]), datetime(2026, 3, 1, 0, i // 60, i % 60), None, i) for i in range(300)]
    RNG.shuffle(rows)
    ddl = "chave string, dono string, termos string, n int, visto_em timestamp, extra string, i int"
    for s in range(0, 300, 100):
        store.upsert(spark.createDataFrame(rows[s : s + 100], ddl), folder, "temas_quentes", how="add", order="visto_em", sums=("n",), parts=4)
    got = {(r.chave, r.dono): (r.termos, r.n, r.visto_em, r.pesquisado_em) for r in store.read_table(spark, folder, "temas_quentes").collect()}
    want = {}
    for k in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == k), key=lambda r: r[4])
        want[k] = (own[-1][2], sum(r[3] or 0 for r in own), own[-1][4], None)
    assert got == want


def test_replace_and_ignore(spark, folder):
    a, b, c = times(1, 2, 3)
    cards = "id long, frente string, estagio long, criado_em timestamp"
    store.upsert(spark.createDataFrame([(1, "um", 0, a), (2, "dois", 0, a), (3, "três", 0, a)], cards), folder, "srs_cards", parts=2)
    again = spark.createDataFrame([(2, None, 1, b), (4, "quatro", 0, b)], cards)
    for _ in range(2):  # a repeated upsert changes nothing
        store.upsert(again, folder, "srs_cards", parts=2)
        rows = {r.id: (r.frente, r.estagio, r.criado_em) for r in store.read_table(spark, folder, "srs_cards").collect()}
        assert rows == {1: ("um", 0, a), 2: (None, 1, b), 3: ("três", 0, a), 4: ("quatro", 0, b)}
    seen = "url string, data_hora timestamp"
    for batch in ([("u1", a), ("u2", b)], [("u2", a), ("u3", c)]):
        store.upsert(spark.createDataFrame(batch, seen), folder, "academico_pdfs", how="ignore")
    assert {r.url: r.data_hora for r in store.read_table(spark, folder, "academico_pdfs").collect()} == {"u1": a, "u2": b, "u3": c}
    assert store.read_table(spark, folder, "rotinas").count() == 0
    store.upsert(spark.createDataFrame([], seen), folder, "academico_pdfs")


def test_only_touched_partitions_are_rewritten(spark, folder, tmp_path):
    ids = spark.range(200).selectExpr("id", "'x' AS acao")
    store.upsert(ids, folder, "auditoria", parts=8)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    store.upsert(spark.createDataFrame([(7, "y")], "id long, acao string"), folder, "auditoria", parts=8)
    after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert len({p.parent for p in set(before.items()) ^ set(after.items()) for p in [p[0]]}) == 1
    assert {r.id: r.acao for r in store.read_table(spark, folder, "auditoria").collect()} == {i: "y" if i == 7 else "x" for i in range(200)}


def test_colocated_figures(spark):
    page = "Livro 'X' (p. {})".format
    ranked = [(1, 1, "Conversa"), (1, 2, page(1)), (1, 3, page(1)), (1, 4, None), (1, 5, " " + page(2) + " "), *((1, 5 + i, page(2 + i)) for i in range(1, 7)), (2, 1, "TemaQuente")]
    v = lambda x: [1.0, x]
    figures = [
        (1, "a", page(1), True, v(0.0)),  # suspect: neither shown nor the measure of the cut
        (2, "b", page(1), False, v(0.30)), (3, "b", page(2), False, v(0.305)), (4, "c", page(2), False, v(0.31)),
        (5, "d", page(6), None, v(0.312)), (6, "e", page(8), False, v(0.1)),  # page 8 is the seventh origin
        (7, "f", page(3), False, v(0.9)), (8, "", page(3), False, v(0.3)), (9, "g", None, False, v(0.3)),
    ]
    r = spark.createDataFrame(ranked, "query_id long, place int, origin string")
    q = spark.createDataFrame([(1, v(0.0)), (2, v(0.0)), (3, None)], "id long, v array<double>")
    f = spark.createDataFrame(figures, "id long, source string, origin string, suspect boolean, v array<double>")
    assert [tuple(x) for x in linking.colocated(r, q, f).orderBy("place").collect()] == [(1, "b", 1), (1, "c", 2)]
    assert linking.colocated(r, q, f.limit(0)).collect() == []


def test_candidates_of_odd_notes(spark):
    notes = spark.createDataFrame([(1, "Solução nutritiva"), (2, None), (3, "")], "note long, text string")
    edges = spark.createDataFrame([(1, "luz"), (2, "luz"), (2, None), (9, "solucao nutritiva"), (9, "nutritiva nutritiva")], "note long, concept string")
    got = {(r.note, r.concept): r.score for r in linking.candidate_concepts(notes, edges).collect()}
    assert got[1, "nutritiva nutritiva"] == got[1, "solucao nutritiva"] + 0.01 and got[1, "solucao nutritiva"] > 3
    assert {c for n, c in got if n == 3} == {"luz", "solucao nutritiva", "nutritiva nutritiva"} and got[3, "luz"] == 0.5
    assert linking.candidate_concepts(notes, edges.limit(0)).collect() == []
