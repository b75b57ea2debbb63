"""Queries on turns of conversations: what an utterance is, windows, deliveries, session memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dialogue as G
from ..operators.turns import turn_windows
from .base import query, table
from .text_queries import KEYWORDS, NORM, TOKENS

LIST = lambda words: "[" + ", ".join(repr(w) for w in words) + "]"


@query("c18_windows")
def c18(spark, d):
    return turn_windows(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", "user", 900)


@query("d8_statements", f"SELECT conv_id, turn, NOT contains(text, '?') AND n <> '' AND len(list_filter({LIST([p.strip() for p in G.NOT_STATEMENTS])}, lambda p: n = p OR starts_with(n, p || ' '))) = 0 AS statement, list_contains({LIST(G.RECEIPTS)}, regexp_replace(n, '^[ .,!?…-]+|[ .,!?…-]+$', '', 'g')) AS receipt FROM (SELECT conv_id, turn, text, {NORM} AS n FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN 'Que ' || text WHEN 2 THEN 'Ok!' ELSE text END AS text FROM conversations))")
def d8(spark, d):
    """Every fourth turn begins like a question, every fourth is a bare acknowledgement."""
    kind = F.col("turn") % 4
    rows = table(spark, d, "conversations").withColumn("text", F.when(kind == 1, F.concat(F.lit("Que "), "text")).when(kind == 2, "Ok!").otherwise(F.col("text")))
    return rows.select("conv_id", "turn", G.statement(F.col("text")).alias("statement"), G.receipt(F.col("text")).alias("receipt"))


@query("d9_antecedents", f"SELECT conv_id, turn, list_has_any({TOKENS}, {LIST(G.POINTING)}) OR list_contains({LIST(G.INDEFINITE)}, coalesce({TOKENS}[-1], '')) OR len(list_filter({KEYWORDS}, lambda k: NOT list_contains({LIST(G.GOING_ON)}, k) AND NOT regexp_matches(k, '^[0-9]+$'))) = 0 AS needs FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN text || ' isso' WHEN 2 THEN text || ' de um?' WHEN 3 THEN 'explique mais 12' ELSE text END AS text FROM conversations)")
def d9(spark, d):
    kind = F.col("turn") % 4
    said = F.when(kind == 1, F.concat("text", F.lit(" isso"))).when(kind == 2, F.concat("text", F.lit(" de um?"))).when(kind == 3, "explique mais 12").otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", G.needs_turn_before(said).alias("needs"))


NAMES = "SELECT item_id, ws, list_transform(ws, lambda w: regexp_matches(w, '^\\p{Lu}')) AS c, list_transform(ws, lambda w: regexp_matches(w, '\\p{Lu}') AND NOT regexp_matches(w, '\\p{Ll}')) AS u FROM (SELECT item_id, list_filter(regexp_extract_all('Sobre YOLO ' || text, '[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ0-9_''-]*'), lambda w: length(w) >= 2) AS ws FROM benchmark)"


@query("c25_entities", f"SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(ws, lambda w, i: u[i] OR (len(list_filter(c, lambda x: x)) < 0.8 * len(ws) AND i > 1 AND c[i])), lambda w: trim(lower(strip_accents(w)))))), ' ') AS names FROM ({NAMES})")
def c25(spark, d):
    names = G.entities(F.concat(F.lit("Sobre YOLO "), "text"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(names), " ").alias("names"))


@query("c26_subjects", f"WITH t AS (SELECT item_id, text, {KEYWORDS} AS ks FROM benchmark) SELECT item_id, CASE WHEN list_contains(ks, 'tarkov') THEN text ELSE 'jogo de Tarkov: ' || text END AS title FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text || ' tarkov' ELSE text END AS text, CASE WHEN item_id % 2 = 0 THEN list_append(ks, 'tarkov') ELSE ks END AS ks FROM t)")
def c26(spark, d):
    title = F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit(" tarkov"))).otherwise(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", G.with_subject(title, F.lit("jogo de Tarkov")).alias("title"))


@query("c35_corrections", "SELECT doc_id, md5(CASE WHEN regexp_matches(lower(coalesce(text, '')), '(^|[^a-z0-9_à-ÿ])the') THEN 'broto, Broto e botoeira. ' ELSE 'botao, Botao e botoeira. ' END || coalesce(text, '')) AS fixed FROM documents")
def c35(spark, d):
    text = F.concat(F.lit("botao, Botao e botoeira. "), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.md5(G.corrected(text, F.coalesce("text", F.lit("")), [("botao", "broto", "the")])).alias("fixed"))


@query("d37_owned", "SELECT user_id AS owner, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id IN (3, 5) GROUP BY user_id")
def d37(spark, d):
    """Reads of personal rows go through owned(), which asks for owners."""
    mine = owned(table(spark, d, "events"), "user_id", [3, 5])
    return mine.groupBy(F.col("user_id").alias("owner")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def owned(df, column: str, owners: list):
    """Rows of the owners only; without an owner it is refused, never the rows of all."""
    if not owners or any(o is None for o in owners):
        raise ValueError("an owner is needed")
    return df.filter(F.col(column).isin(*owners))


@query("h19_passages", "WITH p AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (turn = 0 OR before + length(text) <= 600) AS joined FROM (SELECT conv_id, turn, CASE WHEN turn = 0 THEN left(text, 600) ELSE text END AS text, coalesce(sum(least(length(text), 600)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) GROUP BY conv_id) SELECT conv_id, md5(joined) AS passages FROM p")
def h19(spark, d):
    # a conversation is one record, and read as one
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("ps")).select("conv_id", F.md5(G.passages_within(F.col("ps"), 600)).alias("passages"))


@query("k8_deliveries", "SELECT s.event_id, CASE WHEN min(a.ts) IS NULL THEN 'pending' WHEN min(a.ts) <= s.ts + INTERVAL 10 MINUTE THEN 'acked' ELSE 'late' END AS state FROM events s LEFT JOIN events a ON a.user_id = s.user_id AND a.event_type = 'click' AND a.ts > s.ts AND a.ts <= s.ts + INTERVAL 1 DAY WHERE s.event_type = 'view' GROUP BY s.event_id, s.ts")
def k8(spark, d):
    """A delivery is acknowledged by its owner's next click: within ten minutes in time, within a day late, else it stays
    pending. The day is cut into hours, so that a key's deliveries and clicks don't meet in one group."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    hour = lambda c: F.floor(F.unix_timestamp(c) / 3600)
    first = e.filter("event_type = 'click'").groupBy("user_id", hour("ts").alias("hour")).agg(F.array_sort(F.collect_list("ts")).alias("clicks"))
    sent = e.filter("event_type = 'view'").withColumn("hour", F.explode(F.sequence(hour("ts"), hour("ts") + 24)))
    next_click = F.array_min(F.filter("clicks", lambda c: c > F.col("ts")))
    met = sent.join(first, ["user_id", "hour"], "left").groupBy("event_id", "ts").agg(F.min(next_click).alias("acked"))
    late = F.col("acked") - F.col("ts")
    state = F.when(F.col("acked").isNull() | (late > F.expr("INTERVAL 1 DAY")), "pending").when(late <= F.expr("INTERVAL 10 MINUTES"), "acked").otherwise("late")
    return met.select("event_id", state.alias("state"))


@query("k9_session_memory", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) <= CASE role WHEN 'user' THEN 2 ELSE 3 END")
def k9(spark, d):
    """A session keeps its last two questions and its last three turns of any other role."""
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("turn")))
    kept = table(spark, d, "conversations").withColumn("nth", nth).filter(F.col("nth") <= F.when(F.col("role") == "user", 2).otherwise(3))
    return kept.select("conv_id", "turn")


@query("h12_hubs_first", "WITH e AS (SELECT DISTINCT l_orderkey AS atom, l_partkey AS concept FROM lineitem), w AS (SELECT concept, (count(*) - 1) * ln((SELECT count(DISTINCT atom) FROM e) / count(*)) AS w FROM e GROUP BY concept), c AS (SELECT atom, sum(w) AS centrality FROM e JOIN w USING (concept) GROUP BY atom) SELECT o_custkey AS customer, o_orderkey AS atom FROM orders JOIN c ON atom = o_orderkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY round(centrality, 6) DESC, o_orderkey) <= 5")
def h12(spark, d):
    """Of a customer's orders the most central first."""
    from ..operators import graph
    from .graph_queries import edges

    e = edges(spark, d)
    central = graph.centrality(e, e).select(F.col("atom"), F.round("score", 6).alias("centrality"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("atom")).join(central, "atom")
    place = F.row_number().over(Window.partitionBy("customer").orderBy(F.desc("centrality"), "atom"))
    return rows.withColumn("place", place).filter("place <= 5").select("customer", "atom")
