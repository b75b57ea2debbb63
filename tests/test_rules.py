"""Small rules on text against stated cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenote.functions import atoms, language, requests, text
from lumenote.operators import classify


def each(spark, rule, cases):
    rows = spark.createDataFrame([(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)], "i int, a string" + (", b double" if isinstance(next(iter(cases)), tuple) else ""))
    columns = [F.col(c) for c in rows.columns[1:]]
    return [r.x for r in rows.select("i", rule(*columns).alias("x")).orderBy("i").collect()]


def test_slugs(spark):
    cases = {
        "Solução Nutritiva: pH & EC": "solucao_nutritiva_ph_ec", "": "atomo", "!!!": "atomo", "  _x_ ": "x", "a" * 50: "a" * 40,
        "Custo de quarenta balas de MAI AP no mercado": "custo_de_quarenta_balas_de_mai_ap_no", "abc_" + "d" * 60: "abc_" + "d" * 36,
        "palavra " * 8: "palavra_palavra_palavra_palavra_palavra", "x" * 40 + " fim": "x" * 40, "日本": "atomo",
    }
    assert dict(zip(cases, each(spark, text.slug, cases), strict=True)) == cases
    notes = {"---\na: b\n---\n## Título  \ncorpo": "Título", "# Um\nDois": "Um", "sem nada": "sem nada", "  ## Recuado\n## Outro": "Recuado", "### três\n## dois": "dois", "": ""}
    assert dict(zip(notes, (x.strip("# ") for x in each(spark, text.heading, notes)), strict=True)) == notes


def test_requests(spark):
    clean = {
        "camaleão?": "camaleão", "mostra girafa": "girafa", "Procura uma foto de polvo?!": "foto de polvo", "mostra": "mostra", "?": "?", "mostra um": "um", "ver ver": "ver",
        "  “a  b” - ": "a b", "quero o rio, e": "rio, e", "um rio": "um rio", "": "",
    }
    assert dict(zip(clean, each(spark, requests.cleaned_request, clean), strict=True)) == clean
    subject = {"imagem de tricoma": "de tricoma", "tem imagem": "tem imagem", "Procura na Internet fotos  do Ipê": "na do Ipê", "foto?": "foto?", "": "", "  vídeo  ": "  vídeo  "}
    assert dict(zip(subject, each(spark, requests.without_format, subject), strict=True)) == subject


def test_transcripts(spark):
    heard = {("Obrigado.", 0.6): True, ("obrigado", 0.59): False, ("", 0.9): True, ("...", 0.9): True, ("e aí", 0.7): True, ("uma frase inteira", 0.9): False, ("Legendas pela comunidade Amara org", 0.8): True, ("duas palavras", 0.8): True}
    assert dict(zip(heard, each(spark, classify.phantom, heard), strict=True)) == heard
    alone = {("duas palavras", 0.8): False, ("tchau!", 0.8): True}
    assert dict(zip(alone, each(spark, lambda a, b: classify.phantom(a, b, 0), alone), strict=True)) == alone
    sure = {("oração", -1.0): True, ("oração", -0.5): False, ("", -2.0): False, ("uma frase mais longa", -2.0): False, (" duas  palavras ", -1.1): True}
    assert dict(zip(sure, each(spark, lambda a, b: classify.uncertain(a, b, -0.8), sure), strict=True)) == sure


def test_routes(spark):
    cases = {
        "Qual a cotação do dólar?": (True, False, False, True), "O que é RAG?": (False, True, False, False), "o que é meu projeto": (False, False, False, False), "Me lembra de regar daqui a 10 minutos": (False, False, True, False),
        "como será o clima em Lisboa": (False, False, False, True), "que horas são": (False, False, True, True), "explicando a vida": (False, False, False, False), "Explique overfitting": (False, True, False, False),
    }
    rules = (language.asks_real_time, language.asks_definition, language.asks_action, language.passing)
    assert dict(zip(cases, zip(*(each(spark, rule, cases) for rule in rules), strict=True), strict=True)) == cases


def test_links(spark):
    flat = {
        "Figuras/livro_x_p0001_f2.webp": "Figuras/livro_x/livro_x_p0001_f2.webp", " Figuras/a_p1_b_p0020_f10.webp ": "Figuras/a_p1_b/a_p1_b_p0020_f10.webp", "Figuras/livro/x_p0001_f2.webp": None,
        "Figuras/x_p001_f2.webp": None, "Outra/x_p0001_f2.webp": None, "Figuras/x_p0001_f2.png": None, "": None,
    }
    assert dict(zip(flat, each(spark, atoms.corrected_target, flat), strict=True)) == flat
    notes = {"![[a/b.png]] a/b [[a/c|x]] [[z/a/b]]": ("![[n$1/b.png]] a/b [[n$1/c|x]] [[z/a/b]]", 2), "[[[a/b]]": ("[[[a/b]]", 0), "nada": ("nada", 0)}
    assert [tuple(x) for x in each(spark, lambda t: atoms.rewritten_embeds(t, "a/", "n$1/"), notes)] == list(notes.values())
    links = spark.createDataFrame([("./a\\b.png",), ("a/c.png",), ("b.png",), ("/a/b.png",)], "target string")
    moved = spark.createDataFrame([("a/b.png",), ("a/b.png",), ("b.png",)], "path string")
    assert sorted(r.target for r in atoms.broken_links(links, moved).collect()) == ["./a\\b.png", "/a/b.png"]


@pytest.mark.parametrize("flexible", [False, True])
def test_matching(spark, flexible):
    asked = spark.createDataFrame([(1, "foto de tricoma"), (2, "o que é"), (3, None), (4, "tricomas azuis")], "request long, text string")
    pages = spark.createDataFrame([(1, "## Tricomas de perto"), (2, "Formato de vida"), (3, None), (4, "http://x/tricoma-1")], "candidate long, text string")
    got = {(r.request, r.candidate) for r in classify.matching(asked, pages, flexible).collect()}
    every = {(q, c) for q in (2, 3) for c in (1, 2, 3, 4)}
    assert got == every | ({(1, 1), (1, 4), (4, 1), (4, 4)} if flexible else {(1, 4), (4, 1)})


def test_weak_definitions(spark):
    asked = spark.createDataFrame([(1, "O que é luz?"), (2, "O que é rio?"), (3, "o que é meu rio"), (4, "explique mar")], "id long, text string")
    found = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "a")], "id long, source string")
    assert {r.id: r.escalate for r in classify.weak_definitions(asked, found).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_siblings(spark):
    from lumenote.operators.index import siblings

    rows = [(i, "a" if i < 40 else "b", "igual" if i % 4 else f"texto {i}") for i in range(60)] + [(100, "a", None), (101, None, "x"), (7, "a", "igual")]
    df = spark.createDataFrame(rows, "id long, g string, t string").repartition(3)
    seeds = df.filter("id IN (0, 1, 50, 100, 101)")
    got = {}
    for r in siblings(df, seeds, "id", ["g"], "t", 5).collect():
        got.setdefault(r.seed, []).append(r.id)
    want = {s: sorted(i for i, g, t in rows if g == dict((i, g) for i, g, _ in rows)[s] and t and t != own)[:5] for s, own in ((0, "texto 0"), (1, "igual"), (50, "igual"))}
    assert {s: sorted(x) for s, x in got.items()} == want


def test_vocabulary(spark):
    from lumenote.functions import vocabulary

    terms = ["pH", "mofo cinza", "a.b"]
    hits = {"O ph do solo": [], "mofo  cinza e MOFO CINZA": ["mofo cinza"], "a.b, axb": ["a.b"], "mofo cinzas": [], "": []}
    assert dict(zip(hits, each(spark, lambda t: vocabulary.glossary_terms(t, terms), hits), strict=True)) == hits
    bridge = {"mildew": ["oídio", "mofo"], "mold": ["mofo", "bolor"]}
    said = {"mildew": "mildew oídio mofo", "Mildew e mold": "Mildew e mold oídio mofo bolor", "mold com mofo": "mold com mofo bolor", "nada": "nada", "": "", "mildews": "mildews"}
    assert dict(zip(said, each(spark, lambda t: vocabulary.bridged(t, bridge), said), strict=True)) == said
    shown = {"![[a/b.webp]]x![[c.d.png]]": [("b", 0), ("c.d", 14)], "é ![[sem_fim": [], "🎉![[.oculto]] ![[p/q/r]]": [(".oculto", 1), ("r", 14)], "![[a|b]] [[c]]": [("a|b", 0)]}
    assert [[tuple(x) for x in xs] for xs in each(spark, vocabulary.shown_images, shown)] == list(shown.values())
