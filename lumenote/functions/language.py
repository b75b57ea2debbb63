"""Which language a title or body is in, which route a question takes, what hard facts a text holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, begins_shared, let, normalised, tokens, without_accents

# Function words, whose presence tells a sentence's language.
ENGLISH = (
    "the of and for with from that this these those how what when where why in on at to by as is are was were be been "
    "being do does did your you their its his her our not no more most than then into over under"
).split()
PORTUGUESE = (
    "de da do das dos e para com por que o a os as um uma uns umas em no na nos nas ao aos à às pelo pela pelos pelas "
    "como quando onde porque é são foi eram ser sendo seu sua seus suas não mais menos entre sobre até após durante "
    "antes depois cada todo toda todos todas"
).split()
# Phrases that ask for data of the moment.
REAL_TIME = (
    "cotacao", "quanto esta o dolar", "quanto esta o euro", "quanto esta o bitcoin", "dolar hoje", "euro hoje",
    "bitcoin hoje", "preco do bitcoin", "preco do dolar", "preco do euro", "bolsa hoje", "ibovespa", "preco das acoes",
    "noticias de hoje", "noticias hoje", "ultimas noticias", "manchetes", "previsao do tempo", "clima hoje",
    "temperatura hoje", "vai chover",
)
# Phrases that ask for a definition, and marks of a personal question.
DEFINITION = (
    "o que e ", "o que sao ", "o que significa", "o que quer dizer", "o que vem a ser", "o que representa", "quem e ",
    "quem foi ", "defina ", "definicao de ", "significado de ", "conceito de ", "para que serve", "me explica",
    "me explique", "explica ", "explique ",
)
PERSONAL = ("meu ", "minha ", "meus ", "minhas ", " eu ", "que eu", "nosso ", "nossa ", "a gente ")


# Phrases that may ask for an action.
ACTION = (
    "salva", "salvar", "guarda", "guardar", "anota", "anotar", "cria uma nota", "criar nota", "nova nota", "calcula", "calcular", "quanto e", "que horas", "que dia", "data de hoje",
    "abre a nota", "abrir nota", "le a nota", "leia a nota", "ler nota", "mostra a nota", "lista as notas", "listar notas", "quais notas", "minhas notas", "procura na web",
    "procure na web", "pesquisa na web", "pesquise na web", "busca na web", "busque na web", "me lembra", "me lembre", "lembra de", "lembre de", "lembrete", "lembretes", "alarme",
    "despertador", "timer", "cronometro", "temporizador", "daqui a", "toda segunda", "toda terca", "toda quarta", "toda quinta", "toda sexta", "todo sabado", "todo domingo", "todo dia",
    "toda semana", "a cada", "me avisa", "me avise", "avise quando", "avisa quando", "fica de olho", "ficar de olho", "briefing", "resumo diario", "meus lembretes", "meus avisos",
    "cancela o lembrete", "cancelar lembrete", "cancela lembrete", "adiciona na lista", "adicionar na lista", "adiciona a lista", "poe na lista", "bota na lista", "coloca na lista",
    "lista de compras", "na minha lista", "remove da lista", "remover da lista", "tira da lista", "o que tem na lista", "mostra a lista", "ler lista", "le a lista", "anota rapido",
    "anotar rapido", "anota isso", "anota ai", "captura isso", "capturar", "nota rapida", "joga na inbox", "poe na inbox", "inbox", "diagnostico", "status do sistema", "autoteste",
    "voce esta funcionando", "esta funcionando", "checagem", "health check", "ta tudo ok", "esta tudo certo", "o que voce fez", "que voce fez hoje", "trilha de auditoria", "suas acoes",
    "historico de acoes", "o que aconteceu hoje", "seu historico de hoje",
)
# Phrases whose answer holds for hours only, beside those of REAL_TIME.
PASSING = (
    "clima", "previsao do tempo", "temperatura em", "vai chover", "chove", "quanto esta o", "quanto custa", "preco do", "preco da", "preco atual", "bolsa de valores", "acoes da",
    "noticia", "manchete", "dolar", "euro", "bitcoin", "que horas", "que dia e hoje", "data de hoje",
)


def function_words(text: Column, words) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ]+"), F.lit(0))
    return F.size(F.filter(found, lambda w: w.isin(*words)))  # a set that Spark looks words up in


def without_provenance(title: Column) -> Column:
    """A title without names of works, chapter labels and what stands in brackets."""
    # Fixed value: names of works and chapter labels.
    names = r"(?iu)(the cannabis encyclopedia|jorge cervantes|marijuana horticulture|edi[çc][ãa]o web|s[íi]ntese|[–\-—]\s*chapter\s*\d+)"
    return F.trim(F.regexp_replace(F.regexp_replace(title, names, " "), r"\([^)]*\)", " "))


def english_title(text: Column) -> Column:
    """Three words or more, with an English function word and no Portuguese one; provenance doesn't count."""
    words = F.regexp_extract_all(F.lower(without_provenance(text)), F.lit("[a-zà-ÿ]+"), F.lit(0))
    return let(words, lambda ws: (F.size(ws) >= 3) & F.exists(ws, lambda w: w.isin(*ENGLISH)) & ~F.exists(ws, lambda w: w.isin(*PORTUGUESE)))


def english_body(text: Column) -> Column:
    return function_words(text, ENGLISH) > function_words(text, PORTUGUESE)


def any_phrase(text: Column, phrases) -> Column:
    return normalised(text).rlike(begins_shared(phrases))


def asks_real_time(text: Column) -> Column:
    return any_phrase(text, REAL_TIME)


def asks_action(text: Column) -> Column:
    return any_phrase(text, ACTION)


def passing(text: Column) -> Column:
    """Whether the answer holds for hours only, and so isn't worth keeping."""
    return any_phrase(text, (*REAL_TIME, *PASSING))


def asks_definition(text: Column) -> Column:
    """A question of general knowledge: a definition phrase and no mark of a personal question."""
    return any_phrase(text, DEFINITION) & ~any_phrase(text, PERSONAL)


def hard_facts(text: Column) -> Column:
    """Distinct normalised tokens that hold a digit, without references to pages and figures."""
    # Fixed value: editorial references.
    noise = r"(?i)(?U)\b(p|pp|pág|pag|pagina|página|fig|figura|cap|capítulo|capitulo)s?\.?\s*\d+(\s*[-–—]\s*\d+)?"
    found = F.regexp_extract_all(F.regexp_replace(text, noise, " "), F.lit(r"(?U)[\wÀ-ÿ°%,\.\-/]+"), F.lit(0))
    clean = F.transform(F.filter(found, lambda t: t.rlike(r"\d")), lambda t: F.regexp_replace(normalised(t), "^[.,;:]+|[.,;:]+$", ""))
    return F.array_distinct(F.filter(clean, lambda t: t != ""))


def precedence(origin: Column, preferred: list[str]) -> Column:
    """How much a work counts in a tie: the first mark most, 0 without any."""
    low = F.lower(F.coalesce(origin, F.lit("")))
    rule = F.lit(0)
    for i in range(len(preferred) - 1, -1, -1):
        mark = preferred[i].strip().lower()
        if mark:
            rule = F.when(F.contains(low, F.lit(mark)), len(preferred) - i).otherwise(rule)
    return rule


def replaces(new: Column, old: Column, preferred: list[str], superseded: list[str]) -> Column:
    """Whether a nearly equal new note takes the old one's place: only a declared relation of the two works does it."""
    marks = [m.strip().lower() for m in superseded if m.strip()]
    if not preferred or not marks:
        return F.lit(False)
    low = F.lower(F.coalesce(old, F.lit("")))
    outdated = F.lit(False)
    for m in marks:
        outdated = outdated | F.contains(low, F.lit(m))
    return outdated & (precedence(new, preferred) > precedence(old, preferred))


def first_yes(answer: Column) -> Column:
    """The reason of a verdict that begins with yes (a stated one where none is given), else null."""
    bare = F.regexp_replace(answer, r"^\s+|\s+$", "")
    reason = F.regexp_replace(F.regexp_replace(F.substring(bare, F.lit(4), F.length(bare)), r"^[ :.\t\n-]+", ""), r"^\s+|\s+$", "")
    return F.when(normalised(answer).startswith("sim"), F.when(reason == "", "contradição detectada (sem detalhe)").otherwise(reason))


# Words that announce a quoted phrase, and what may stand between; phrases that ask what is known of a theme.
QUOTING = ("expressao", "expressoes", "frase", "frases", "ditado", "ditados", "giria", "girias", "proverbio", "proverbios", "dito", "ditado popular", "jargao")
BETWEEN = ("que", "diz", "e", ":")
SYNTHESIS = (
    "o que eu sei sobre", "o que sei sobre", "o que eu tenho sobre", "o que tenho sobre", "tudo que eu sei sobre", "tudo que sei sobre", "tudo sobre", "resuma o que",
    "faca uma sintese sobre", "faz uma sintese sobre", "sintese sobre", "sintetiza sobre", "me resuma sobre", "resuma sobre", "resuma tudo sobre",
)
# Phrases that tell how long an answer should be, of normalised text.
CHILD = (
    "para uma crianca", "pra uma crianca", "para crianca", "pra crianca", "como uma crianca", "como para uma crianca", "como se eu fosse crianca", "como se eu fosse uma crianca",
    "como se eu tivesse 5 anos", "como se eu tivesse cinco anos", "modo crianca", "explica como crianca", "para leigos", "para um leigo", "como se eu fosse leigo", "para leigo",
    "linguagem simples", "de forma bem simples", "de um jeito simples", "de um jeito bem simples", "bem simples", "de forma simples", "explica simples", "facil de entender", "eli5",
)
EXPLAINING = (
    "explica", "explique", "explicar", "detalha", "detalhe", "detalhar", "discorra", "aprofunda", "aprofunde", "como funciona", "por que", "porque", "por quê", "pq ", "me ensina",
    "ensina", "fale mais", "mais detalhes", "elabore", "passo a passo", "descreve", "descreva", "compara", "compare", "diferenca entre", "resuma", "resumo",
)
WIDE_STARTS = (
    "o que e ", "o que sao ", "o que eu ", "o que voce ", "qual o melhor ", "qual a melhor ", "quais os melhores ", "quais as melhores ", "me fale sobre ", "fale sobre ",
    "me fala sobre ", "fala sobre ", "me conte sobre ", "conte sobre ", "me diga sobre ",
)
WIDE_PARTS = (
    "qual a diferenca", "qual e a diferenca", "quais as diferencas", "quais sao as diferencas", "diferenca entre", "diferencas entre", "compare ", "comparado com", "em relacao a",
)
PLAIN_HOW = ("como esta", "como estao", "como vai", "como vao", "como se chama", "como se escreve", "como se diz", "como se fala")
PLAIN_AMOUNT = ("quanto e ", "quanto eh ", "quanto custa", "quanto vale", "quanto fica", "quanto tem ", "quantos sao ", "quanto sao ", "quantas sao ")
SHORT_QUESTION = 8


def cited_phrase(question: Column) -> Column:
    """The phrase that a question quotes: what follows the first announcing word with three words or more behind it. Empty without one."""
    words = F.split(F.regexp_replace(F.regexp_replace(question, r"(?U)^\s+|\s+$", ""), "[?.!]+$", ""), r"(?U)\s+")

    def behind(ws: Column) -> Column:
        def rest(w: Column, i: Column) -> Column:
            after = F.slice(ws, i + 2, F.size(ws))
            first = F.array_position(F.transform(after, lambda x: ~normalised(x).isin(*BETWEEN)), F.lit(True))
            return F.when(normalised(w).isin(*QUOTING) & (first > 0), F.slice(after, F.greatest(first, F.lit(1)), F.size(ws))).otherwise(F.array().cast("array<string>"))

        long = F.filter(F.transform(ws, rest), lambda r: F.size(r) >= 3)
        return F.coalesce(F.regexp_replace(F.array_join(F.get(long, F.lit(0)), " "), "^[ :\"']+|[ :\"']+$", ""), F.lit(""))

    return let(words, behind)


def synthesis_theme(question: Column) -> Column:
    """What a request for all that is known is about, in its own spelling; null if it is no such request or names nothing."""
    plain = F.lower(without_accents(question))
    rule = F.lit(None).cast("string")
    for phrase in reversed(SYNTHESIS):
        at = F.locate(phrase, plain)
        rule = F.when(at > 0, F.substring(question, at + len(phrase), F.length(question))).otherwise(rule)
    edge = "^[ ?.!:,\"']+|[ ?.!:,\"']+$"
    theme = F.regexp_replace(F.regexp_replace(rule, edge, ""), r"(?i)^(?:o|a|os|as|meu|minha|sobre|tema|assunto)\s+", "")
    return F.nullif(F.trim(theme), F.lit(""))


def verbosity(question: Column) -> Column:
    """How long an answer should be: crianca, detalhado, curto or normal; the first class that holds."""
    n = normalised(question)
    starts = lambda phrases: n.rlike("^(" + any_of(phrases) + ")")
    wide = starts(WIDE_STARTS) | n.rlike(any_of(WIDE_PARTS)) | (n.startswith("como ") & ~starts(PLAIN_HOW)) | (starts(("quanto", "quantas")) & ~starts(PLAIN_AMOUNT))
    return F.when(n.rlike(any_of(CHILD)), "crianca").when(n.rlike(any_of(EXPLAINING)) | wide, "detalhado").when(F.size(tokens(question)) <= SHORT_QUESTION, "curto").when(n.isNotNull(), "normal")
