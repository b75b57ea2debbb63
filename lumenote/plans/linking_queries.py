"""Queries on link candidates, figures beside what was found, the application's tables, JSON and times in running text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import captions, jsons, when
from ..functions import language as L
from ..operators import linking
from ..operators import ranking as R
from ..operators.tables import shared_dir
from ..sources import store
from .base import query, table
from .ranking_queries import DISTANCE
from .text_queries import KEYWORDS, NORM, STOP, TOKENS
from .vault_queries import notes

CONCEPT = "lower(p_name || ' ' || p_type)"


@query(
    "f6_candidate_concepts",
    f"""WITH e AS (SELECT DISTINCT l_orderkey AS note, {CONCEPT} AS concept FROM lineitem JOIN part ON l_partkey = p_partkey), f AS (SELECT concept, count(*) AS freq FROM e GROUP BY concept),
    n AS (SELECT o_orderkey AS note, min(struct_pack(l := l_linenumber, c := {CONCEPT})).c AS text FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey),
    c AS (SELECT concept, freq, list_filter({TOKENS.replace('text', 'concept')}, lambda t: NOT list_contains({STOP}, t) AND length(t) >= 3) AS ts FROM f), t AS (SELECT concept, freq, len(ts) AS al, unnest(ts) AS t FROM c),
    w AS (SELECT note, unnest({KEYWORDS}) AS t FROM n), a AS (SELECT note, concept, 3.0::DOUBLE * count(*) / any_value(al) + ln(1 + any_value(freq)) / 10 AS score FROM w JOIN t USING (t) GROUP BY note, concept),
    co AS (SELECT x.concept, y.concept AS near, count(*) AS n FROM e x JOIN e y ON x.note = y.note AND x.concept <> y.concept GROUP BY ALL),
    k AS (SELECT co.* FROM co QUALIFY row_number() OVER (PARTITION BY concept ORDER BY n DESC, near) <= 6),
    b AS (SELECT e.note, near AS concept, sum(1 + ln(1 + n) / 10) AS score FROM e JOIN k USING (concept) JOIN f g ON g.concept = near AND g.freq >= 3 JOIN f h ON h.concept = e.concept AND h.freq >= 2 GROUP BY ALL),
    h AS (SELECT concept, 0.5 - (row_number() OVER (ORDER BY freq DESC, concept) - 1) * 0.01 AS score FROM f ORDER BY freq DESC, concept LIMIT 10),
    s AS (SELECT note, concept, round(sum(score), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT note, concept, score::DOUBLE FROM n, h) GROUP BY ALL)
    SELECT note, concept, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY note ORDER BY s.score DESC, concept) <= 24""",
)
def f6(spark, d):
    """Orders are notes, the kinds of their parts concepts, and the kind of the first part the text."""
    kind = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), kind.alias("concept")), "l_partkey").select(F.col("l_orderkey").alias("note"), "l_linenumber", "concept")
    first = lines.groupBy("note").agg(F.min(F.struct("l_linenumber", "concept"))["concept"].alias("text"))
    notes = table(spark, d, "orders").select(F.col("o_orderkey").alias("note")).join(first, "note", "left")
    return linking.candidate_concepts(notes, lines).select("note", "concept", F.round("score", 6).alias("score"))


ORIGIN = "CASE WHEN vec_id % 5 = 0 THEN 'Conversa' ELSE 'Livro ' || label || ' (p. ' || vec_id % 4 || ')' END"


@query(
    "e4_attachments",
    f"""WITH o AS (SELECT *, {ORIGIN} AS origin FROM embeddings), r AS (SELECT a.vec_id AS query_id, b.origin, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DISTANCE}, b.vec_id) AS place FROM o a JOIN o b ON a.vec_id % 50 = 0 AND b.vec_id % 3 <> 0 QUALIFY place <= 34),
    g AS (SELECT query_id, origin, min(place) AS place FROM r WHERE origin <> 'Conversa' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(place), origin) <= 6),
    f AS (SELECT a.vec_id AS query_id, b.vec_id AS id, 'fig' || (b.vec_id // 12) AS source, b.vec_id % 11 = 0 AS suspect, {DISTANCE} AS dist FROM o a JOIN o b ON a.vec_id % 50 = 0 AND b.vec_id % 3 = 0 JOIN g ON g.query_id = a.vec_id AND g.origin = b.origin),
    k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, id) <= 8), u AS (SELECT *, min(dist) OVER (PARTITION BY query_id) AS least FROM k WHERE NOT suspect),
    s AS (SELECT query_id, source, min(dist) AS dist, arg_min(id, dist) AS id FROM u WHERE dist <= least * 1.1 GROUP BY ALL)
    SELECT query_id, source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS INT) AS place FROM s QUALIFY place <= 2""",
)
def e4(spark, d):
    """Every third vector is a figure, the others are passages; a label is a book and has four pages."""
    rows = table(spark, d, "embeddings").withColumn("origin", F.expr(ORIGIN))
    asked = rows.filter("vec_id % 50 = 0")
    found = R.nearest(rows.filter("vec_id % 3 <> 0"), asked, "vec_id", "embedding", 34)
    ranked = found.join(rows.select(F.col("vec_id").alias("id"), "origin"), "id").select("query_id", "place", "origin")
    source = F.concat(F.lit("fig"), F.floor(F.col("vec_id") / 12).cast("string"))
    figures = rows.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), source.alias("source"), "origin", (F.col("vec_id") % 11 == 0).alias("suspect"), F.col("embedding").alias("v"))
    return linking.colocated(ranked, asked.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), figures)


@query("a6_topic_upserts", "SELECT event_type AS chave, CAST(user_id AS VARCHAR) AS dono, arg_max(props, ts) AS termos, CAST(count(*) AS BIGINT) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS visto_em FROM events GROUP BY 1, 2")
def a6(spark, d):
    """What each user did how often, upserted in three batches into the table of hot topics."""
    folder = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    seen = F.col("ts").cast("timestamp").alias("visto_em")
    rows = table(spark, d, "events").select(F.col("event_type").alias("chave"), F.col("user_id").cast("string").alias("dono"), F.col("props").alias("termos"), F.lit(1).alias("n"), seen, (F.col("event_id") % 3).alias("batch"))
    for batch in range(3):
        store.upsert(rows.filter(F.col("batch") == batch), folder, "temas_quentes", how="add", order="visto_em", sums=("n",))
    return store.read_table(spark, folder, "temas_quentes").select("chave", "dono", "termos", "n", F.date_format("visto_em", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("visto_em"))


@query("c23_json_objects")
def c23(spark, d):
    """Documents with a tool call, a loose brace and the document itself as an argument; held against a character loop."""
    t = F.coalesce("text", F.lit(""))
    call = F.to_json(F.struct(F.lit("anotar").alias("tool"), F.struct(t.alias("texto"), F.lit('}{"').alias("sinais")).alias("args")))
    said = F.concat(t, F.lit(' {sorriso} "ok {'), F.lit('"x"} '), call, F.lit(" fim {"), t)
    rows = table(spark, d, "documents").select("doc_id", said.alias("said"))
    return rows.select("doc_id", F.size(jsons.json_objects(F.col("said"))).alias("n"), F.md5(F.array_join(jsons.json_objects(F.col("said")), "|")).alias("objects"), jsons.tool_call(F.col("said"))["tool"].alias("tool"))


#: Ways to name a time, one for each turn in turn; the turns themselves name none.
WAYS = (
    "daqui a dez minutos", "a cada trinta minutos", "toda segunda às 9h", "amanhã às 8h30", "em duas horas e meia hora", "todo dia às 7h", "de 2 em 2 horas", "ao meio-dia", "às 15", "hoje 18:45",
    "toda semana", "daqui 1h30", "todas as sextas", "a cada hora", "quando der", "em vinte e cinco segundos", "às 25h", "meia-noite de amanhã", "toda manhã", "a cada 0 dias",
)


@query("g15_due_times")
def g15(spark, d):
    """Every turn asks for a reminder in one of the ways, at a time of its own; held against a plain version."""
    k = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(WAYS)))
    way = F.element_at(F.array(*(F.lit(w) for w in WAYS)), (k + 1).cast("int"))
    now = F.timestamp_seconds(F.lit(1_784_300_000) + F.col("conv_id") * 7919 + F.col("turn") * 601)
    rows = table(spark, d, "conversations").select("conv_id", "turn", when.due(F.concat(F.lit("me lembra "), way, F.lit(": "), F.coalesce("text", F.lit(""))), now).alias("due"))
    return rows.select("conv_id", "turn", F.date_format(F.col("due.at").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("due.recurrence").alias("recurrence"))


@query("c41_captions")
def c41(spark, d):
    """Documents as pages of a book with two captions and mentions of figures; held against a plain version."""
    t = F.coalesce("text", F.lit(""))
    k = F.col("doc_id") % 4
    page = F.concat(F.lit("Figura "), k.cast("string"), F.lit(".1 — "), F.substring(t, 1, 70), F.lit("\n"), t, F.lit("\nFIG. 2.1: segunda  legenda\nO texto diz muito mais (Figura 3-2). E isto se vê na figura 2.1"))
    rows = table(spark, d, "documents").select("doc_id", k.alias("figures"), captions.page_captions(page).alias("found"))
    labels = F.transform("found", lambda x: x["caption"])
    return rows.select("doc_id", F.array_join(F.transform("found", lambda x: x["number"]), ",").alias("numbers"), F.md5(captions.caption_of(labels, F.lit(1), F.col("figures"))).alias("caption"))


@query("c42_swapped_captions")
def c42(spark, d):
    """Every note gets its line as title and body, and a new caption; held against a plain version."""
    rows = notes(spark, d).withColumn("line", F.regexp_replace("text", r"\s+", " "))
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n\n"), "line")).otherwise(F.lit("\n![[f.webp]]"))
    head = F.concat(F.lit("---\norigem: "), "origem", F.lit("\n---\n## "), F.substring("line", 1, 120), body, F.lit("\n**Malha Neural:** [[x]]"))
    new = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("Nova legenda "), F.col("doc_id").cast("string")))
    return rows.select("doc_id", F.md5(captions.note_caption(head)).alias("caption"), F.md5(captions.swapped(head, new)).alias("note"))


ASKING = ("Qual é a expressão que diz ", "O que eu sei sobre o ", "Como se diz ", "Quanto tempo leva ", "Explica ", "")


@query("c38_cited_phrases")
def c38(spark, d):
    """Every turn as a question with one of the beginnings; held against a plain version."""
    start = F.element_at(F.array(*(F.lit(a) for a in ASKING)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(ASKING))) + 1).cast("int"))
    said = F.concat(start, F.coalesce("text", F.lit("")), F.lit("?"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(L.cited_phrase(said)).alias("phrase"), F.md5(L.synthesis_theme(said)).alias("theme"))


def _any(phrases, n, how="contains"):
    return f"len(list_filter({list(phrases)!r}, lambda p: {how}({n}, p))) > 0"


@query(
    "d34_verbosity",
    f"""WITH q AS (SELECT conv_id, turn, {list(ASKING)!r}[1 + (conv_id + turn) % {len(ASKING)}] || CASE WHEN turn % 2 = 0 THEN left(coalesce(text, ''), 40) ELSE coalesce(text, '') END || '?' AS text FROM conversations), t AS (SELECT conv_id, turn, {NORM} AS n, len({TOKENS}) AS k FROM q)
    SELECT conv_id, turn, CASE WHEN {_any(L.CHILD, 'n')} THEN 'crianca' WHEN {_any(L.EXPLAINING, 'n')} OR {_any(L.WIDE_STARTS, 'n', 'starts_with')} OR {_any(L.WIDE_PARTS, 'n')} OR (starts_with(n, 'como ') AND NOT {_any(L.PLAIN_HOW, 'n', 'starts_with')})
      OR ((starts_with(n, 'quanto') OR starts_with(n, 'quantas')) AND NOT {_any(L.PLAIN_AMOUNT, 'n', 'starts_with')}) THEN 'detalhado' WHEN k <= 8 THEN 'curto' ELSE 'normal' END AS level FROM t""",
)
def d34(spark, d):
    start = F.element_at(F.array(*(F.lit(a) for a in ASKING)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(ASKING))) + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    said = F.concat(start, F.when(F.col("turn") % 2 == 0, F.substring(text, 1, 40)).otherwise(text), F.lit("?"))
    return table(spark, d, "conversations").select("conv_id", "turn", L.verbosity(said).alias("level"))
