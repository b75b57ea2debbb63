"""What an utterance is: a statement, a receipt, a question that needs the turn before; entities; windows of turns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, keywords, normalised, tokens

# Beginnings of questions and requests, compared with normalised text.
NOT_STATEMENTS = (
    "o que", "que ", "qual", "quais", "quem", "quando", "onde", "aonde", "como", "por que", "porque", "pra que", "para que",
    "quanto", "quanta", "quantos", "quantas", "cade", "sera que", "existe", "existem", "tem como", "da pra", "pode", "podem",
    "devo", "voce", "vc ", "sabe ", "sabes ", "me ", "explica", "explique", "detalha", "detalhe", "mostra", "mostre",
    "lista", "liste", "fala", "fale", "diz", "diga", "resume", "resuma", "compara", "compare", "pesquisa", "pesquise",
    "busca", "busque", "procura", "procure", "calcula", "calcule", "salva", "salve", "anota", "anote", "cria", "crie",
    "adiciona", "adicione", "remove", "remova", "cancela", "cancele", "lembra", "lembre", "agenda", "agende", "abre", "abra",
    "toca", "toque", "manda", "mande", "envia", "envie", "define", "defina", "verifica", "verifique",
)
# Utterances that only acknowledge.
RECEIPTS = (
    "aham", "uhum", "uhm", "hmm", "hm", "ah", "aha", "aa", "ha", "ok", "okay", "ta", "ta bom", "ta bem", "ta certo", "certo",
    "sei", "sei la", "entendi", "entendido", "blz", "beleza", "valeu", "vlw", "tchau", "tchau tchau", "ate logo", "ate mais",
    "falou", "isso", "isso ai", "isso mesmo", "pois e", "opa", "eita", "nossa", "uau",
)
# Words that point back; indefinite ones that do so at the end; words that only go on.
POINTING = (
    "ele ela eles elas dele dela deles delas nele nela isso isto esse essa esses essas este esta estes estas nisso disso nesse "
    "neste nessa nesta aquele aquela aquilo aqueles aquelas mesmo mesma tal ai assim acima citado"
).split()
INDEFINITE = "um uma uns umas algum alguma alguns algumas outro outra outros outras nenhum nenhuma qualquer".split()
GOING_ON = (
    "melhor mais menos detalhe detalhes detalha detalhar explique explica explicar explicacao resume resuma resumir continue "
    "continua continuar primeiro primeira segundo segunda terceiro terceira ultimo ultima opcao opcoes depois antes outro outra "
    "outros outras exemplo exemplos fala fale diz diga conta conte sobre"
).split()


def statement(text: Column) -> Column:
    """Whether a message states something: no question mark, and no beginning of a question or request."""
    n = normalised(text)
    opens = "^(" + any_of([p.strip() for p in NOT_STATEMENTS]) + ")( |$)"
    return ~F.contains(text, F.lit("?")) & (n != "") & ~n.rlike(opens)


def receipt(text: Column) -> Column:
    """Whether a message is nothing but an acknowledgement."""
    return F.regexp_replace(normalised(text), "^[ .,!?…-]+|[ .,!?…-]+$", "").isin(*RECEIPTS)


def needs_turn_before(text: Column) -> Column:
    """Whether a question points back, ends in a bare indefinite word, or has no keyword of its own."""
    t = tokens(text)
    core = F.filter(keywords(text), lambda k: ~k.isin(*GOING_ON) & ~k.rlike("^[0-9]+$"))
    last = F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit(""))
    return F.arrays_overlap(t, F.array(*(F.lit(w) for w in POINTING))) | last.isin(*INDEFINITE) | (F.size(core) == 0)


def entities(subject: Column) -> Column:
    """Normalised proper names: capitalised words that don't open it, and words all in capitals anywhere. Where four of
    five words are capitalised, capitals tell nothing and only the latter count."""
    words = F.filter(F.regexp_extract_all(subject, F.lit(r"(?U)[^\W\d_][\w'\-]*"), F.lit(0)), lambda w: F.length(w) >= 2)
    capital = lambda w: w.rlike(r"^\p{Lu}")
    titled = F.size(F.filter(words, capital)) >= 0.8 * F.size(words)
    shouted = lambda w: w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")
    return F.array_distinct(F.transform(F.filter(words, lambda w, i: shouted(w) | (~titled & (i > 0) & capital(w))), normalised))


def names_subject(title: Column, subject: Column) -> Column:
    """Whether a title names an entity of its subject, or shares a keyword with a subject that has none."""
    own, names = keywords(title), entities(subject)
    return F.when(F.size(names) > 0, F.arrays_overlap(names, own)).otherwise(F.arrays_overlap(keywords(subject), own))


def with_subject(title: Column, subject: Column) -> Column:
    """The title, with its subject before it where it doesn't name it."""
    return F.when((F.size(keywords(subject)) == 0) | names_subject(title, subject), title).otherwise(F.concat(subject, F.lit(": "), title))


def corrected(text: Column, source: Column, corrections: list[tuple[str, str, str]]) -> Column:
    """Known wrong translations (wrong, right, evidence) put right where the source has the evidence; a capital stays."""
    out = text
    for wrong, right, evidence in corrections:
        lower = F.regexp_replace(out, rf"(?U)\b{wrong}\b", right)
        both = F.regexp_replace(lower, rf"(?U)\b{wrong.capitalize()}\b", right.capitalize())
        out = F.when(F.lower(source).rlike(rf"(?U)\b{evidence}"), both).otherwise(out)
    return out


def passages_within(passages: Column, budget: int) -> Column:
    """Passages in order until one doesn't fit; the first is always there, cut to the budget."""
    start = F.struct(F.array().cast("array<string>").alias("used"), F.lit(budget).alias("left"), F.lit(False).alias("over"))

    def step(a, p):
        size = F.length(p)
        first = F.struct(F.array(F.substring(p, 1, budget)).alias("used"), (budget - F.least(size, F.lit(budget))).alias("left"), F.lit(False).alias("over"))
        ended = F.struct(a["used"].alias("used"), a["left"].alias("left"), F.lit(True).alias("over"))
        taken = F.struct(F.concat(a["used"], F.array(p)).alias("used"), (a["left"] - size).alias("left"), F.lit(False).alias("over"))
        return F.when(a["over"], a).when(F.size(a["used"]) == 0, first).when(size > a["left"], ended).otherwise(taken)

    return F.aggregate(passages, start, step, lambda a: F.array_join(a["used"], "\n\n"))
