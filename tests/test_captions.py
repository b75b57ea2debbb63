"""Captions, quoted phrases and themes against plain versions."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lumenote.functions import captions, language
from lumenote.plans.linking_queries import ASKING
from lumenote.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def md5(text):
    return None if text is None else hashlib.md5(text.encode()).hexdigest()


def plain_captions(text):
    found = {}
    for n, words in re.findall(r"^\s*(?:figuras?|fig\.?)\s*([\dA-Z]+(?:[.\-]\d+)?)\s*[—\-–:.]\s*(.{4,300})", text, re.I | re.M):
        found[n] = " ".join(words.split())[:300]
    for words, n in re.findall(r"([^.\n]{15,200}?\(?\s*(?:figuras?|fig\.?)\s*([\dA-Z]+(?:[.\-]\d+)?)\s*\)?)", text, re.I):
        found.setdefault(n, " ".join(words.split())[:300])
    return found


def test_page_captions(spark):
    pages = [
        "Figura 4.1 — Ciclo da  água\nO texto fala disso (Figura 4.1) e de outra coisa bem maior (Fig. 5). Fim", "fig. A1: primeira\nFIGURA 2: segunda\nfig. A1 - de novo", "figuras 3 . x", "", None,
        "como se vê muito bem aqui na figura 7 e depois outra vez se vê na figura 7",
    ]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, t string").select("i", captions.page_captions(F.col("t")).alias("f")).collect()
    assert {r.i: [tuple(x) for x in r.f] for r in rows} == {i: list(plain_captions(p or "").items()) for i, p in enumerate(pages)}
    cases = [([], 0, 0, ""), (["a", "b"], 1, 2, "b"), (["a", "b"], 1, 3, "a | b"), (["x" * 299, "y"], 0, 1, "x" * 299 + " ")]
    got = spark.createDataFrame(cases, "c array<string>, i int, n int, want string").select(captions.caption_of(F.col("c"), F.col("i"), F.col("n")).alias("x"), "want").collect()
    assert all(r.x == r.want for r in got)


def test_captions_of_all_documents(spark):
    got = {r.doc_id: (r.numbers, r.caption) for r in QUERIES["c41_captions"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        t = r.text or ""
        found = plain_captions(f"Figura {r.doc_id % 4}.1 — {t[:70]}\n{t}\nFIG. 2.1: segunda  legenda\nO texto diz muito mais (Figura 3-2). E isto se vê na figura 2.1")
        labels, n = list(found.values()), r.doc_id % 4
        assert got[r.doc_id] == (",".join(found), md5("" if not labels else labels[1] if len(labels) == n else " | ".join(labels)[:300])), r.doc_id


def plain_swap(note, new):
    lines, new = note.split("\n"), (new or "").strip()
    at = next((i for i, x in enumerate(lines) if x.startswith("## ")), None)
    if at is None:
        return "", None
    title = lines[at][3:].strip()
    body = next((i for i in range(at + 1, len(lines)) if lines[i].strip()), None)
    if body is not None and (lines[body].strip().startswith(("![[", "**Malha", "#")) or not lines[body].strip().startswith(title)):
        body = None
    whole = lines[body].strip() if body is not None else title
    if "legenda_original:" in note or not title or not new or whole == new:
        return whole, None
    lines[at] = "## " + new[:120]
    if body is not None:
        lines[body] = new
    text = "\n".join(lines)
    m = re.match(r"(?s)---\r?\n.*?(\r?\n---\r?\n)", text)
    saved = whole.replace('"', "'")
    return whole, m and f"{text[: m.start(1)]}\nlegenda_original: {saved}{text[m.start(1) :]}"


def test_swapped(spark):
    head = "---\norigem: x\n---\n"
    cases = [
        (head + "## Curta\nCurta e completa \"aspas\"\n![[f.webp]]", "Nova"), (head + "## Curta\n\n![[f.webp]]\nCurta", "Nova"), (head + "## Curta\nOutra", "n" * 200), (head + "sem título", "Nova"),
        ("## Sem cabeça\ncorpo", "Nova"), (head + "## Igual", " Igual "), (head + "## T\nlegenda_original: y", "Nova"), (head + "## T", ""), (head + "## T", None), (head + "##  \nx", "Nova"), ("", "Nova"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, n string").select("i", captions.note_caption(F.col("t")).alias("c"), captions.swapped(F.col("t"), F.col("n")).alias("s")).collect()
    assert {r.i: (r.c, r.s) for r in rows} == {i: plain_swap(*c) for i, c in enumerate(cases)}
    again = spark.createDataFrame([(plain_swap(*cases[0])[1],)], "t string").select(captions.swapped(F.col("t"), F.lit("Mais uma")).alias("s")).first()
    assert again.s is None


def test_swapped_in_all_notes(spark):
    from lumenote.plans.vault_queries import notes

    got = {r.doc_id: (r.caption, r.note) for r in QUERIES["c42_swapped_captions"](spark, DATA).collect()}
    for r in notes(spark, DATA).collect():
        line = re.sub(r"[ \t\n\x0b\f\r]+", " ", r.text)
        body = f"\n\n{line}" if r.doc_id % 3 == 0 else "\n![[f.webp]]"
        whole, new = plain_swap(f"---\norigem: {r.origem}\n---\n## {line[:120]}{body}\n**Malha Neural:** [[x]]", f"Nova legenda {r.doc_id}" if r.doc_id % 5 else None)
        assert got[r.doc_id] == (md5(whole), md5(new)), r.doc_id


def plain(word):
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).lower()


def plain_phrase(text):
    words = text.strip().rstrip("?.!").split()
    for i, w in enumerate(words):
        if plain(w) in language.QUOTING:
            rest = words[i + 1 :]
            while rest and plain(rest[0]) in language.BETWEEN:
                rest = rest[1:]
            if len(rest) >= 3:
                return " ".join(rest).strip(" :\"'")
    return ""


@pytest.mark.parametrize(
    "question, phrase, theme",
    [
        ("da onde saiu a expressão pega um prato faz a linha?", "pega um prato faz a linha", None), ("qual sua expressão favorita?", "", None), ("e o ditado que diz água mole em pedra dura", "água mole em pedra dura", None),
        ("a frase é uma frase: \"ser ou não ser\"!", "uma frase: \"ser ou não ser", None), ("O que eu sei sobre o Ártico?", "", "Ártico"), ("tudo sobre", "", None), ("Faça uma síntese sobre minha horta.", "", "horta"), ("", "", None),
    ],
)
def test_phrases_and_themes(spark, question, phrase, theme):
    got = spark.createDataFrame([(question,)], "t string").select(language.cited_phrase(F.col("t")).alias("p"), language.synthesis_theme(F.col("t")).alias("s")).first()
    assert (got.p, got.s) == (phrase, theme)


def test_phrases_of_all_turns(spark):
    got = {(r.conv_id, r.turn): r.phrase for r in QUERIES["c38_cited_phrases"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        assert got[r.conv_id, r.turn] == md5(plain_phrase(ASKING[(r.conv_id + r.turn) % len(ASKING)] + (r.text or "") + "?"))


def test_verbosity(spark):
    cases = {"explica como se eu fosse criança": "crianca", "por que chove?": "detalhado", "como vai você?": "curto", "como podar uma muda": "detalhado", "quanto custa isso": "curto", "quantas semanas leva": "detalhado", "onde fica a estufa": "curto", "a b c d e f g h i": "normal"}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", language.verbosity(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows} == cases
