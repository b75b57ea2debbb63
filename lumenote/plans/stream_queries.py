"""Stream queries, run to the end of their input with availableNow."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.tables import shared_dir
from ..streaming import deliveries, monitors, quiet, schedule, sentences
from .base import query, table


def run(spark, d, name, make):
    folder = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = make(monitors.event_stream(spark, d, "events.parquet", schema))
    return monitors.available_now(stream, f"{folder}/out", f"{folder}/state")


#: Ends of sessions and windows that the watermark has passed when the input ends; the others stay in the state.
CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query(
    "k1_sessions",
    f"""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o), g AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS n FROM s GROUP BY user_id, k)
    SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS begin_at, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS end_at, n FROM g WHERE b <= {CLOSED}""",
)
def k1(spark, d):
    found = run(spark, d, "sessions", lambda e: monitors.sessions(e, "user_id", "30 minutes"))
    return found.select("user_id", F.date_format("start", STAMP).alias("begin_at"), F.date_format("end", STAMP).alias("end_at"), "n")


@query("k6_throttle")
def k6(spark, d):
    return run(spark, d, "throttle", lambda e: monitors.throttle(e, "user_id", 86_400.0))


#: Steps in which the stream queries below get their events.
STEPS = 3
#: Events and documents of a bucket of keys, about, and buckets at least; buckets of a partition of state, and partitions at least.
BUCKET_EVENTS, BUCKET_DOCUMENTS, LEAST_BUCKETS = 20_000, 256, 64
PARTITION_BUCKETS, LEAST_PARTITIONS = 64, 12


def bucketed(spark, rows, each):
    """A session for buckets of keys with so many rows each, and their number."""
    buckets = max(LEAST_BUCKETS, rows.count() // each)
    return quiet.state_session(spark, max(LEAST_PARTITIONS, buckets // PARTITION_BUCKETS)), buckets


def sliced(spark, d):
    """events with their step: thirds of the time that they span."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = e.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b"))
    at = F.floor((F.unix_micros("ts") - F.col("a")) * STEPS / (F.col("b") - F.col("a") + 1)).cast("int")
    return e.crossJoin(F.broadcast(span)).withColumn("slice", at).drop("a", "b")  # one row


SLICED = f"SELECT *, CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) * {STEPS} / (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1)) AS INT) AS slice FROM events"


def in_steps(rows, name, make):
    """What a stream of the rows, fed step by step, has written when the input ends."""
    folder = f"{shared_dir(rows.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"
    out = []

    def run(stream, state):
        out.append(monitors.available_now(make(stream.withWatermark("ts", "10 minutes")), f"{folder}/out", state))

    monitors.replayed(rows, STEPS, folder, run)
    return out[-1]


K3_KIND = "CASE event_type WHEN 'purchase' THEN 'yes' WHEN 'error' THEN 'no' ELSE 'input' END"


@query(
    "k3_idle_actions",
    f"""WITH e AS (SELECT user_id, event_id, ts, {K3_KIND} AS kind FROM events), w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events),
    i AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS back, ts + INTERVAL 4 HOUR AS asked FROM e WHERE kind = 'input'),
    a AS (SELECT * FROM i WHERE back IS NULL OR asked <= back),
    f AS (SELECT a.*, arg_min(e.kind, e.ts) AS said, min(e.ts) AS said_at FROM a LEFT JOIN e ON e.user_id = a.user_id AND e.kind <> 'input' AND e.ts >= asked AND e.ts < asked + INTERVAL 1 HOUR AND (back IS NULL OR e.ts < back) GROUP BY ALL),
    r AS (SELECT *, CASE said WHEN 'yes' THEN said_at WHEN 'no' THEN NULL ELSE asked + INTERVAL 1 HOUR END AS ran FROM f),
    x AS (SELECT user_id, asked AS done_at, 'ask' AS action FROM r UNION ALL SELECT user_id, ran, 'run' FROM r WHERE ran IS NOT NULL AND (back IS NULL OR ran <= back)
          UNION ALL SELECT user_id, back, 'stop' FROM r WHERE back IS NOT NULL AND ran <= back)
    SELECT user_id, strftime(done_at, '%Y-%m-%d %H:%M:%S.%f') AS done_at, action FROM x, w WHERE done_at <= w""",
)
def k3(spark, d):
    """Purchases stand for a yes, errors for a no, other events for input; four hours and one hour for 300 and 15 seconds."""
    own, buckets = bucketed(spark, table(spark, d, "events"), BUCKET_EVENTS)
    rows = sliced(own, d)
    found = in_steps(rows, "idle", lambda e: quiet.idle_actions(e, ["user_id"], F.expr(K3_KIND), "event_id", 4 * 3600, 3600, buckets))
    return found.select("user_id", F.date_format("at", STAMP).alias("done_at"), "action")


@query(
    "k5_put_off_work",
    """WITH e AS (SELECT user_id, event_id, ts, event_type IN ('view', 'signup') AS closes, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_at FROM events),
    f AS (SELECT *, CASE WHEN closes AND (next_at IS NULL OR ts + INTERVAL 3 HOUR <= next_at) THEN ts + INTERVAL 3 HOUR END AS quiet FROM e),
    h AS (SELECT user_id, event_id, closes, min(quiet) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS done_at FROM f)
    SELECT user_id, event_id AS item, strftime(done_at, '%Y-%m-%d %H:%M:%S.%f') AS done_at FROM h WHERE closes AND done_at <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def k5(spark, d):
    """Views and signups end a conversation and leave an item; after three quiet hours all items so far are handed on."""
    own, buckets = bucketed(spark, table(spark, d, "events"), BUCKET_EVENTS)
    rows = sliced(own, d)
    kind = F.when(F.col("event_type").isin("view", "signup"), "close").otherwise("use")
    found = in_steps(rows, "put-off", lambda e: quiet.put_off_work(e, ["user_id"], kind, "event_id", 3 * 3600, buckets))
    return found.select("user_id", "item", F.date_format("at", STAMP).alias("done_at"))


@query(
    "k7_ticks",
    f"""WITH e AS ({SLICED}), c AS (SELECT slice, max(ts) AS tick FROM e GROUP BY slice),
    s AS (SELECT event_id AS id, slice, ts + to_microseconds(CAST(round(value * 1e9) AS BIGINT)) AS due, CASE WHEN event_id % 7 = 0 THEN 86400 END AS period FROM e),
    n AS (SELECT s.*, c.slice AS k, tick, lag(tick) OVER (PARTITION BY id ORDER BY c.slice) AS before FROM s JOIN c ON c.slice >= s.slice),
    p AS (SELECT id, k, tick, CASE WHEN before IS NULL OR due > before THEN due WHEN period IS NULL THEN NULL ELSE due + to_seconds(86400 * CAST(floor((epoch_us(before) - epoch_us(due)) / 86400e6) + 1 AS BIGINT)) END AS due FROM n)
    SELECT id, strftime(due, '%Y-%m-%d %H:%M:%S.%f') AS due, strftime(tick, '%Y-%m-%d %H:%M:%S.%f') AS tick FROM p WHERE due <= tick""",
)
def k7(spark, d):
    """Each event is an item due 1000 seconds for each unit of its value later; those of every seventh come again daily."""
    due = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1e9).cast("long"))
    items = sliced(spark, d).select(F.col("event_id").alias("id"), due.alias("due"), F.when(F.col("event_id") % 7 == 0, 86400.0).alias("period"), "ts", "slice")
    folder = f"{shared_dir(spark)}/ticks-{uuid.uuid4().hex}"
    monitors.replayed(items, STEPS, folder, lambda stream, state: schedule.run_ticks(stream, folder, state))
    return schedule.sent(spark, folder).select("id", F.date_format("due", STAMP).alias("due"), F.date_format("tick", STAMP).alias("tick"))


K8_JOIN = "a.event_type = 'click' AND a.event_id - a.event_id % 8 % 3 - 1 = s.event_id AND a.ts BETWEEN s.ts AND s.ts + INTERVAL 1 HOUR"


@query(
    "k8_delivery_stream",
    f"""WITH s AS (SELECT * FROM events WHERE event_type = 'view'), o AS (SELECT s.event_id, min(a.ts) FILTER (a.user_id % 2 = s.user_id % 2) AS acked, count(a.ts) FILTER (a.user_id % 2 <> s.user_id % 2) AS refusals FROM s LEFT JOIN events a ON {K8_JOIN} GROUP BY s.event_id)
    SELECT event_id AS id, CASE WHEN acked IS NOT NULL THEN 'acked' WHEN ts + INTERVAL 1 HOUR < (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) THEN 'resend' ELSE 'pending' END AS state, strftime(acked, '%Y-%m-%d %H:%M:%S.%f') AS acked_at, refusals FROM s JOIN o USING (event_id)""",
)
def k8_stream(spark, d):
    """Views are deliveries to one of two owners; a click acknowledges the delivery of up to three events before."""

    def make(e):
        ack = F.col("event_id") - F.col("event_id") % 8 % 3 - 1
        owner = (F.col("user_id") % 2).alias("owner")
        sent = e.filter("event_type = 'view'").select(F.col("event_id").alias("id"), owner, F.col("ts").alias("sent"))
        acks = e.filter("event_type = 'click'").select(ack.alias("id"), owner, F.col("ts").alias("at"))
        return deliveries.outcomes(sent, acks, "1 hour")

    rows = sliced(spark, d)
    found = in_steps(rows, "deliveries", make)
    sent = rows.filter("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("ts").alias("sent"))
    return deliveries.delivery_states(sent, found).select("id", "state", F.date_format("acked_at", STAMP).alias("acked_at"), "refusals")


@query("c19_spoken_sentences")
def c19(spark, d):
    """Every document as a reply that arrives in pieces of 40 to 400 characters, in three steps, some before their turn;
    held against the sentences of the whole texts."""
    own, buckets = bucketed(spark, table(spark, d, "documents"), BUCKET_DOCUMENTS)
    docs = table(own, d, "documents").filter("doc_id IS NOT NULL").select("doc_id", "text")
    pieces = sentences.pieces_of(docs, "doc_id", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(361)) + 40).cast("int"))
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "seq"), F.lit(STEPS)).cast("int"))
    folder = f"{shared_dir(spark)}/stream-spoken-{uuid.uuid4().hex}"
    out = []
    monitors.replayed(pieces, STEPS, folder, lambda stream, state: out.append(monitors.available_now(sentences.spoken(stream, "doc_id", buckets=buckets), f"{folder}/out", state)))
    return out[-1].select("doc_id", "nth", F.md5("sentence").alias("sentence"))


LATE = f"SELECT *, least(slice + CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END, {STEPS - 1}) AS step FROM ({SLICED})"


@query(
    "k12_hourly_with_late_data",
    f"""WITH e AS ({LATE}), m AS (SELECT step, max(ts) AS t FROM e GROUP BY step), w AS (SELECT step, max(t) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS w FROM m),
    k AS (SELECT event_type, date_trunc('hour', ts) AS hour FROM e JOIN w USING (step) WHERE w IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > w)
    SELECT event_type, strftime(hour, '%Y-%m-%d %H:%M') AS hour, count(*) AS n FROM k WHERE hour + INTERVAL 1 HOUR <= {CLOSED} GROUP BY 1, 2""",
)
def k12(spark, d):
    """Every twentieth event comes a step late. What the watermark has passed by then is dropped, not counted."""
    rows = sliced(spark, d)
    rows = rows.withColumn("slice", F.least(F.col("slice") + (F.col("event_id") % 20 == 0).cast("int"), F.lit(STEPS - 1)))
    found = in_steps(rows, "hourly", lambda e: monitors.hourly(e, "event_type"))
    return found.select("event_type", F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "n")
