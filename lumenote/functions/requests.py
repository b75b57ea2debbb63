"""What a request for a picture is about: without words of format, channel and command."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalised

# Words of format, marks of the web, verbs of asking (compared with normalised words).
FORMAT_WORDS = (
    "imagem", "imagens", "foto", "fotos", "fotografia", "fotografias", "figura", "figuras", "ilustracao", "ilustracoes", "desenho", "desenhos", "diagrama", "diagramas", "esquema",
    "esquemas", "grafico", "graficos", "video", "videos", "print", "prints", "screenshot", "screenshots", "link", "links", "foto?", "visual", "visuais",
)
WEB_MARKS = ("internet", "web", "online", "google", "rede", "navegador", "site", "sites")
REQUEST_VERBS = (
    "mostra", "mostre", "mostrar", "procura", "procure", "procurar", "busca", "busque", "buscar", "pesquisa", "pesquise", "pesquisar", "acha", "ache", "achar", "encontra", "encontre",
    "encontrar", "ver", "veja", "vejo", "exibe", "exiba", "exibir", "manda", "mande", "envia", "envie", "traz", "traga", "trazer", "quero", "queria", "gostaria", "preciso", "tem", "temos", "existe",
)
# Verbs that open a command and articles behind them (compared in lower case), and what is cut off at the ends.
ORDER_VERBS = (
    "mostra", "mostre", "mostrar", "exibe", "exiba", "exibir", "ve", "vê", "veja", "ver", "busca", "busque", "buscar", "procura", "procure", "procurar", "pesquisa", "pesquise",
    "pesquisar", "acha", "ache", "achar", "encontra", "encontre", "encontrar", "quero", "queria",
)
ARTICLES = ("um", "uma", "o", "a", "os", "as")
EDGE = "\\s.,;:—–\\-\"'“”‘’"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_format(terms: Column) -> Column:
    """The terms without words of format, channel and asking; as they are if nothing else is left."""
    words = F.filter(F.split(_trimmed(terms), r"(?U)\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~normalised(w).isin(*FORMAT_WORDS, *WEB_MARKS, *REQUEST_VERBS))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(terms)


def cleaned_request(terms: Column) -> Column:
    """The term to look up: no question marks, no signs at the ends, no verb of command before it (with its article).

    Never empty: a request of nothing else stays as it is.
    """
    plain = F.regexp_replace(F.regexp_replace(terms, "[?!]+", " "), r"(?U)\s+", " ")
    words = F.split(F.regexp_replace(plain, f"(?U)^[{EDGE}]+|[{EDGE}]+$", ""), " ")
    ordered = (F.size(words) > 1) & F.lower(F.get(words, F.lit(0))).isin(*ORDER_VERBS)
    article = ordered & (F.size(words) > 2) & F.lower(F.get(words, F.lit(1))).isin(*ARTICLES)
    start = F.when(article, 3).when(ordered, 2).otherwise(1)
    left = F.trim(F.array_join(F.slice(words, start, F.size(words)), " "))
    return F.coalesce(F.nullif(left, F.lit("")), _trimmed(terms))
