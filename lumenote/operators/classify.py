"""Predicates and classifiers over text columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.language import asks_definition
from ..functions.text import any_of, keywords, normalised, stem, tokens, without_accents

# Terms of editorial apparatus, compared with lower-cased text without accents.
APPARATUS_TERMS = (
    "creditos das fotos", "credito das fotos", "coordenacao editorial", "edicao de texto", "assistencia editorial",
    "preparacao de texto", "todos os direitos reservados", "isbn", "dados internacionais de catalogacao",
    "impressao e acabamento", "revisao tecnica", "projeto grafico", "diagramacao", "editoracao eletronica",
    "indice remissivo", "ficha catalografica", "sumario", "referencias bibliograficas", "bibliografia recomendada",
    "sobre os autores",
)
# Signatures of prompt injection, compared with normalised text.
INJECTION_SIGNATURES = (
    "ignore previous instruction", "ignore all previous", "ignore the above", "ignore your instruction",
    "ignore your previous", "disregard previous instruction", "disregard all previous", "disregard the above",
    "forget previous instruction", "forget all previous", "new instructions:", "system prompt:", "reveal your prompt",
    "reveal your instruction", "reveal your system", "print your instruction", "you are now dan", "do anything now",
    "developer mode enabled", "override your", "you must ignore", "ignore as instrucoes anterior",
    "ignore todas as instrucoes", "ignore suas instrucoes", "desconsidere as instrucoes", "esqueca as instrucoes",
    "esqueca tudo que", "novas instrucoes:", "revele seu prompt", "revele suas instrucoes", "mostre seu prompt",
    "voce agora e um", "voce agora e uma", "a partir de agora voce", "ignore o texto acima",
)
# Fixed value: a line of a subject index.
INDEX_ENTRY = r"(?m)^\s*[A-ZÀ-Ú][^,\n]{1,60},\s*(?:\(|ver\b|\d)"


def injected(text: Column) -> Column:
    """Whether the text holds a signature of prompt injection."""
    return normalised(text).rlike(any_of(INJECTION_SIGNATURES))


def prose_share(text: Column, least: int = 80) -> Column:
    """Share of the characters that stand in long lines."""
    sizes = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.length(F.trim(x)))
    zero = F.struct(F.lit(0).alias("all"), F.lit(0).alias("long"))
    total = F.aggregate(sizes, zero, lambda a, n: F.struct((a["all"] + n).alias("all"), (a["long"] + F.when(n >= least, n).otherwise(0)).alias("long")), lambda a: F.when(a["all"] == 0, F.lit(0.0)).otherwise(a["long"] / a["all"]))
    return total


def digit_ratio(text: Column) -> Column:
    """Digits per letter; 1 without letters."""
    letters = F.nullif(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(0))
    return F.when(text.isNotNull(), F.coalesce(F.regexp_count(text, F.lit(r"\p{Nd}")) / letters, F.lit(1.0)))


def per_thousand(count: Column, text: Column) -> Column:
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(1000.0 * count / F.length(text))


def index_density(text: Column) -> Column:
    return per_thousand(F.regexp_count(text, F.lit(INDEX_ENTRY)), text)


def slash_density(text: Column) -> Column:
    return per_thousand(F.length(text) - F.length(F.replace(text, F.lit("/"), F.lit(""))), text)


def apparatus_terms(text: Column) -> Column:
    """How many of the terms occur."""
    plain = F.lower(without_accents(text))
    return functools.reduce(lambda a, b: a + b, (F.contains(plain, F.lit(t)).cast("int") for t in APPARATUS_TERMS))


def triaged(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds prose, numeric, entries, slashes, terms (the measures) and verdict: why a passage isn't worth keeping, or
    'content'; the first rule that holds. Each measure is taken once."""
    t = F.col(text)
    rows = rows.withColumns({"prose": prose_share(t), "numeric": digit_ratio(t), "entries": index_density(t), "slashes": slash_density(t), "terms": apparatus_terms(t)})
    # The thresholds.
    rules = (
        F.when(F.length(F.trim(t)) < 400, "short")
        .when(F.col("entries") >= 1.0, "index")
        .when(F.col("slashes") >= 5.0, "credits")
        .when((F.col("prose") < 0.30) & (F.col("numeric") > 0.05), "apparatus")
        .when((F.col("terms") >= 3) & (F.col("prose") < 0.55), "imprint")
        .otherwise("content")
    )
    return rows.withColumn("verdict", rules)


def origin_family(origin: Column) -> Column:
    """Family of a note by its origin text; order matters."""
    v = F.trim(F.coalesce(origin, F.lit("")))
    low = F.lower(v)
    return (
        F.when(v == "", "sem_origem")
        .when(v.startswith("Livro"), "livro")
        .when(low.endswith(".json"), "importado")
        .when(low.isin("sintese", "síntese"), "sintese")
        .when(low.isin("proativa", "conversa", "temaquente"), low)
        .otherwise("outro")
    )


def page_origin(origin: Column) -> Column:
    """Whether an origin names a page of a book."""
    return F.coalesce(origin, F.lit("")).rlike(r"\(p\.\s*\d+")


def numbers(text: Column) -> Column:
    """Distinct numbers of two digits or more, or with a decimal part."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+[.,]\d+|\d{2,}"), F.lit(0)))


def faithful(atom: Column, source: Column) -> Column:
    """Whether every number of the atom occurs in its source."""
    return F.size(F.array_except(numbers(atom), numbers(source))) == 0


def within_caps(ttft: Column, rate: Column, most_ttft: float = 120_000, most_rate: float = 300) -> Column:
    """Rows that are no outliers; missing values pass."""
    return F.coalesce(ttft <= most_ttft, F.lit(True)) & F.coalesce(rate <= most_rate, F.lit(True))


# What a recogniser hears in silence, compared with normalised text.
SILENCE = (
    "obrigado", "obrigada", "muito obrigado", "obrigado por assistir", "tchau", "ate logo", "ate a proxima", "valeu", "e ai", "e ae", "legendas pela comunidade amara org", "amara org",
    "inscreva se no canal", "compartilhe o video",
)
NO_SPEECH = 0.6


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def phantom(text: Column, no_speech: Column, most_words: int = 2) -> Column:
    """Whether a transcript is of silence: where no speech was likely, a known filler, nothing, or very few words (0: off)."""
    bare = F.regexp_replace(normalised(text), "^[ .!?,]+|[ .!?,]+$", "")
    few = (word_count(bare) <= most_words) if most_words > 0 else F.lit(False)
    return (no_speech >= NO_SPEECH) & ((bare == "") | bare.isin(*SILENCE) | few)


def uncertain(text: Column, logprob: Column, least: float, most_words: int = 2) -> Column:
    """Whether a transcript is short and of low confidence."""
    return word_count(text).between(1, most_words) & (logprob < least)


def weak_definitions(questions: DataFrame, found: DataFrame, least: int = 3) -> DataFrame:
    """id, escalate: questions (id, text) that ask for a definition while what was found (id, source) has too few sources."""
    n = found.groupBy("id").agg(F.count_distinct("source").alias("n"))
    return questions.join(n, "id", "left").select("id", (asks_definition(F.col("text")) & (F.coalesce("n", F.lit(0)) < least)).alias("escalate"))


def matching(requests: DataFrame, candidates: DataFrame, flexible: bool = False) -> DataFrame:
    """request, candidate: the candidates (candidate, text) that have a keyword of a request (request, text), or its plural
    where `flexible`. A request without any usable keyword accepts all."""
    form = stem if flexible else lambda t: t
    keys = requests.select("request", F.transform(keywords(F.coalesce("text", F.lit(""))), form).alias("ks"))
    words = candidates.select("candidate", F.explode(F.array_distinct(F.transform(tokens(F.coalesce("text", F.lit(""))), form))).alias("k"))
    hits = words.join(keys.select("request", F.explode(F.array_distinct("ks")).alias("k")), "k").select("request", "candidate").distinct()
    # these accept everything: that is their result
    return hits.unionByName(keys.filter(F.size("ks") == 0).select("request").join(candidates.select("candidate"), F.lit(True)))
