"""Queries over texts: scalar functions, classifiers, notes. Literal rows stand in where the tables lack a case."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as C
from .base import query, table

NORM = "trim(lower(strip_accents(text)))"
TOKENS = f"regexp_extract_all({NORM}, '[a-z0-9]+')"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
KEYWORDS = f"list_filter(list_distinct({TOKENS}), lambda t: NOT list_contains({STOP}, t) AND (length(t) >= 3 OR regexp_matches(t, '[0-9]')))"
KEYS = ("the", "tion", "des", "que")
KEY_LIST = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"


def stem_sql(t: str) -> str:
    cut = lambda k, end="": f"{t}[1:length({t})-{k}] || '{end}'"
    return (
        f"CASE WHEN length({t}) <= 3 THEN {t} WHEN {t} LIKE '%oes' AND length({t}) > 3 THEN {cut(3, 'ao')} WHEN {t} LIKE '%aes' AND length({t}) > 3 THEN {cut(3, 'ao')} "
        f"WHEN {t} LIKE '%aos' AND length({t}) > 3 THEN {cut(3, 'ao')} WHEN {t} LIKE '%ns' AND length({t}) > 3 THEN {cut(2, 'm')} WHEN {t} LIKE '%is' AND length({t}) > 4 THEN {cut(2, 'l')} "
        f"WHEN {t} LIKE '%es' AND length({t}) > 4 THEN {cut(2)} WHEN {t} LIKE '%s' THEN {cut(1)} ELSE {t} END"
    )


def values(spark, columns: str, rows: list[tuple]):
    return spark.createDataFrame(rows, columns)


def sql_values(names: str, rows: list[tuple]) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS v({names})"


@query("c1_without_accents", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def c1(spark, d):
    return table(spark, d, "documents").select("doc_id", T.without_accents(F.col("text")).alias("plain"))


@query("c2_normalised", f"SELECT doc_id, {NORM} AS norm FROM documents")
def c2(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalised(F.col("text")).alias("norm"))


@query("c3_tokens", f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n_tokens, md5(array_to_string({TOKENS}, ' ')) AS tokens_md5 FROM documents")
def c3(spark, d):
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query("c4_keywords", f"SELECT doc_id, array_to_string(list_sort({KEYWORDS}), ' ') AS keys FROM documents")
def c4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.keywords(F.col("text"))), " ").alias("keys"))


@query(
    "c5_trimmed_query",
    f"""WITH w AS (SELECT item_id, list_transform(string_split_regex(trim(text), '\\s+'), lambda x: struct_pack(w := x, b := regexp_replace(trim(lower(strip_accents(x))), '[^0-9A-Za-z_]', '', 'g'))) AS ws FROM benchmark)
    SELECT item_id, array_to_string(list_transform(list_filter(ws, lambda x: length(x.b) >= 2 AND NOT list_contains({STOP}, x.b))[1:6], lambda x: x.w), ' ') AS query FROM w""",
)
def c5(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.trimmed_query(F.col("text")).alias("query"))


@query("c6_stems", f"SELECT doc_id, md5(array_to_string(list_transform({TOKENS}, lambda t: {stem_sql('t')}), ' ')) AS stems_md5 FROM documents")
def c6(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(F.transform(T.tokens(F.col("text")), T.stem), " ")).alias("stems_md5"))


#: Endings of plurals and others, put on every word of the corpus, which lacks most of them.
ENDINGS = ("s", "es", "is", "ns", "oes", "aes", "aos", "a")


@query("c6_plural_forms", f"SELECT w, {stem_sql('w')} AS stem FROM (SELECT t || unnest({list(ENDINGS)!r}) AS w FROM (SELECT DISTINCT unnest({TOKENS}) AS t FROM documents)) GROUP BY w")
def c6b(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("t")).distinct()
    forms = words.select(F.explode(F.transform(T.words_array(ENDINGS), lambda e: F.concat("t", e))).alias("w")).distinct()
    return forms.select("w", T.stem(F.col("w")).alias("stem"))


SLUG = "regexp_replace(regexp_replace(trim(lower(strip_accents(title))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(
    "c14_slugs",
    f"""WITH t AS (SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN '## ' || regexp_extract(coalesce(text, ''), '^([^\r\n]*)', 1) ELSE regexp_extract(coalesce(text, ''), '^([^\r\n]*)', 1) END, '^#+', '')) AS title FROM documents),
    s AS (SELECT doc_id, {SLUG} AS s FROM t), c AS (SELECT doc_id, s, length(s) > 40 AS long, strpos(reverse(left(s, 41)), '_') AS back FROM s),
    k AS (SELECT doc_id, CASE WHEN NOT long THEN s WHEN back > 0 AND 41 - back > 20 THEN left(s, 41 - back) ELSE left(s, 40) END AS s FROM c)
    SELECT doc_id, coalesce(nullif(regexp_replace(s, '^_+|_+$', '', 'g'), ''), 'atomo') AS slug FROM k""",
)
def c14(spark, d):
    """File names of all documents: of a third by a heading behind front matter, of the others by the first line."""
    t = F.coalesce("text", F.lit(""))
    note = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\norigem: x\n---\n## "), t)).otherwise(t)
    return table(spark, d, "documents").select("doc_id", T.slug(T.heading(note)).alias("slug"))


@query("c31_first_folder", "SELECT page_id, CASE WHEN len(p) > 1 THEN p[1] ELSE '(raiz)' END AS folder FROM (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') AS p FROM pages)")
def c31(spark, d):
    parts = F.filter(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/"), lambda x: x != "")
    return table(spark, d, "pages").select("page_id", F.when(F.size(parts) > 1, parts[0]).otherwise("(raiz)").alias("folder"))


@query("c39_cache_name", "SELECT page_id, left(sha256(url), 24) || '.html' AS name FROM pages")
def c39(spark, d):
    return table(spark, d, "pages").select("page_id", F.concat(F.substring(F.sha2("url", 256), 1, 24), F.lit(".html")).alias("name"))


@query("d1_grounding", f"SELECT doc_id, list_has_any({TOKENS}, {KEY_LIST}) AS grounded FROM documents")
def d1(spark, d):
    return table(spark, d, "documents").select("doc_id", T.mentions(F.col("text"), T.words_array(KEYS)).alias("grounded"))


@query("d2_flexible_grounding", f"SELECT doc_id, list_has_any(list_transform({TOKENS}, lambda t: {stem_sql('t')}), list_transform({KEY_LIST}, lambda t: {stem_sql('t')})) AS grounded FROM documents")
def d2(spark, d):
    return table(spark, d, "documents").select("doc_id", T.mentions_stem(F.col("text"), T.words_array(KEYS)).alias("grounded"))


PROSE = "WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: trim(x)), lambda x: length(x) > 0) AS ls FROM documents), "
MEASURES = """m AS (SELECT doc_id, text, coalesce(CAST(list_sum(list_transform(ls, lambda x: CASE WHEN length(x) >= 80 THEN length(x) ELSE 0 END)) AS DOUBLE) / nullif(list_sum(list_transform(ls, lambda x: length(x))), 0), 0.0) AS prose,
 length(regexp_replace(text, '[^\\p{Nd}]', '', 'g')) AS digits, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters,
 CASE WHEN length(text) = 0 THEN 0.0 ELSE 1000.0 * (length(text) - length(replace(text, '/', ''))) / length(text) END AS slashes,
 CASE WHEN length(text) = 0 THEN 0.0 ELSE 1000.0 * len(regexp_extract_all(text, '(?m)^\\s*[A-ZÀ-Ú][^,\\n]{1,60},\\s*(?:\\(|ver(?:[^\\p{L}\\p{N}_]|$)|\\d)')) / length(text) END AS entries FROM l), """
TRIAGE = f"""t AS (SELECT *, CASE WHEN letters = 0 THEN 1.0 ELSE digits::DOUBLE / letters END AS numeric,
 len(list_filter([{', '.join(repr(x) for x in C.APPARATUS_TERMS)}], lambda x: contains(lower(strip_accents(text)), x))) AS terms FROM m)
SELECT doc_id, round(prose, 6) AS prose, round(numeric, 6) AS numeric, round(entries, 6) AS entries, round(slashes, 6) AS slashes, CAST(terms AS BIGINT) AS terms,
 CASE WHEN length(trim(text)) < 400 THEN 'short' WHEN entries >= 1 THEN 'index' WHEN slashes >= 5 THEN 'credits' WHEN prose < 0.3 AND numeric > 0.05 THEN 'apparatus' WHEN terms >= 3 AND prose < 0.55 THEN 'imprint' ELSE 'content' END AS verdict FROM t"""


@query("d13_triage", PROSE + MEASURES + TRIAGE)
def d13(spark, d):
    measures = (F.round(c, 6).alias(c) for c in ("prose", "numeric", "entries", "slashes"))
    return C.triaged(table(spark, d, "documents")).select("doc_id", *measures, F.col("terms").cast("long").alias("terms"), "verdict")


@query("d19_triage_summary", PROSE + MEASURES + "v AS (" + TRIAGE.replace("t AS (", "SELECT verdict FROM (WITH t AS (", 1) + "))" + " SELECT verdict, count(*) AS n FROM v GROUP BY verdict")
def d19(spark, d):
    return C.triaged(table(spark, d, "documents")).groupBy("verdict").agg(F.count("*").alias("n"))


@query(
    "h7_jaccard",
    f"WITH t AS (SELECT item_id, list_distinct({TOKENS}) AS s FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 6) AS similarity FROM t a JOIN t b ON b.item_id = a.item_id + 1",
)
def h7(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("s"))
    b = t.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("s").alias("u"))
    return t.join(b, "item_id").select(F.col("item_id").alias("a"), "b", F.round(T.jaccard(F.col("s"), F.col("u")), 6).alias("similarity"))
