"""State machines over streams: the same result however the input is cut into micro-batches."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lumenote.streaming import deliveries, monitors, quiet, schedule

START = datetime(2026, 1, 5, 8, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


def fed(session, rows, cuts, make, folder):
    """Rows (key, seconds, kind, item) in time order, cut before the places in `cuts`, through a stream."""
    out, folder = [], f"file://{folder}/{uuid.uuid4().hex}"
    # a last event of another key moves the watermark past everything
    rows = [*rows, ("end", 10**6, "input", 0)]
    frame = session.createDataFrame([(k, at(s), kind, i, sum(n >= c for c in cuts)) for n, (k, s, kind, i) in enumerate(rows)], "user string, ts timestamp, kind string, item long, slice int")
    monitors.replayed(frame, len(cuts) + 1, folder, lambda stream, state: out.append(monitors.available_now(make(stream.withWatermark("ts", "5 seconds")), f"{folder}/out", state)))
    return sorted((r.user, round((r.at.replace(tzinfo=timezone.utc) - START).total_seconds(), 3), *r[2:]) for r in out[-1].select("user", F.to_utc_timestamp("at", "UTC").alias("at"), *[c for c in out[-1].columns if c not in ("user", "at")]).collect() if r.user != "end")


@pytest.fixture(scope="module")
def states(spark):
    return quiet.state_session(spark)


IDLE = [
    # asked at 300, silent for 15 seconds: runs, and stops when input comes
    ("silent", 0, "input", 1), ("silent", 400, "input", 2),
    # refused while asked: not asked again until input came and went
    ("refuses", 0, "input", 3), ("refuses", 305, "no", 4), ("refuses", 310, "yes", 5), ("refuses", 2000, "input", 6),
    # agrees at once; an answer at another time means nothing
    ("agrees", 0, "input", 7), ("agrees", 100, "yes", 8), ("agrees", 301, "yes", 9), ("agrees", 302, "no", 10), ("agrees", 350, "input", 11),
    # comes back while asked, and at the very moment of the question
    ("returns", 0, "input", 12), ("returns", 310, "input", 13), ("returns", 610, "input", 14),
]
ACTIONS = [
    ("silent", 300, "ask"), ("silent", 315, "run"), ("silent", 400, "stop"), ("silent", 700, "ask"), ("silent", 715, "run"),
    ("refuses", 300, "ask"), ("refuses", 2300, "ask"), ("refuses", 2315, "run"),
    ("agrees", 300, "ask"), ("agrees", 301, "run"), ("agrees", 350, "stop"), ("agrees", 650, "ask"), ("agrees", 665, "run"),
    ("returns", 300, "ask"), ("returns", 610, "ask"), ("returns", 910, "ask"), ("returns", 925, "run"),
]


@pytest.mark.parametrize("cuts", [[], [4, 9], [1, 3, 6, 12]])
def test_idle_machine(states, tmp_path, cuts):
    rows = sorted(IDLE, key=lambda r: r[1])
    got = fed(states, rows, cuts, lambda e: quiet.idle_actions(e, ["user"], F.col("kind"), "item"), tmp_path)
    assert got == sorted(ACTIONS)


def test_events_out_of_order_within_the_delay(states, tmp_path):
    rows = [("a", 3, "input", 1), ("a", 0, "input", 2), ("a", 307, "yes", 3), ("a", 304, "input", 4)]
    got = fed(states, rows, [1, 3], lambda e: quiet.idle_actions(e, ["user"], F.col("kind"), "item"), tmp_path)
    assert got == [("a", 303, "ask"), ("a", 604, "ask"), ("a", 619, "run")]


@pytest.mark.parametrize("cuts", [[], [2, 4, 6]])
def test_put_off_work(states, tmp_path, cuts):
    rows = [("a", 0, "close", 1), ("a", 50, "use", 90), ("a", 60, "close", 2), ("a", 61, "close", 3), ("b", 70, "close", 7), ("a", 161, "use", 91), ("a", 300, "close", 4), ("b", 400, "use", 92), ("a", 350, "use", 93), ("a", 900, "use", 94)]
    rows = sorted(rows, key=lambda r: r[1])
    got = fed(states, rows, cuts, lambda e: quiet.put_off_work(e, ["user"], F.col("kind"), "item", 100).select("user", "at", "item"), tmp_path)
    # the timers of items 1 and 2 were taken back, their items went with item 3; item 4 is never quiet and stays
    assert got == [("a", 161, 1), ("a", 161, 2), ("a", 161, 3), ("b", 170, 7)]


def test_a_replayed_tick_dispatches_nothing_twice(spark, tmp_path):
    folder = f"file://{tmp_path}/ticks"
    batches = [
        [(1, at(10), None, at(0)), (2, at(100), None, at(0)), (3, at(5), 50.0, at(5)), (None, None, None, at(20))],
        [(4, at(30), None, at(40)), (2, at(100), None, at(40)), (5, at(500), None, at(130))],
        [(6, at(140), None, at(180))],
    ]
    want = {(1, 10, 20, 0), (3, 5, 20, 0), (3, 55, 130, 1), (4, 30, 130, 1), (2, 100, 130, 1), (3, 155, 180, 2), (6, 140, 180, 2)}

    def rows(k):
        return spark.createDataFrame(batches[k], "id long, due timestamp, period double, ts timestamp")

    def found():
        off = lambda t: round((t.astimezone(timezone.utc) - START).total_seconds())
        return sorted((r.id, off(r.due), off(r.tick), r.batch) for r in schedule.sent(spark, folder).collect())

    for k in range(3):
        schedule.tick(rows(k), k, folder)
        before = found()
        schedule.tick(rows(k), k, folder)  # Spark runs a batch again whose end it did not record
        assert found() == before
    assert found() == sorted(want)


def test_deliveries(spark, tmp_path):
    sent = [(1, "ana", 0), (2, "ana", 10), (3, "rui", 20), (4, "rui", 30), (5, "eva", 900), (1, "ana", 700)]
    acks = [(1, "ana", 5), (1, "ana", 8), (2, "rui", 12), (2, "ana", 400), (3, "eva", 25), (3, "rui", 60), (9, "rui", 70), (1, "ana", 705)]
    d = spark.createDataFrame([(i, o, at(s)) for i, o, s in sent], "id long, owner string, sent timestamp")
    a = spark.createDataFrame([(i, o, at(s)) for i, o, s in acks], "id long, owner string, at timestamp")
    every = d.select("id", "owner", F.col("sent").alias("ts"), F.lit(True).alias("is_push")).unionByName(a.select("id", "owner", F.col("at").alias("ts"), F.lit(False).alias("is_push")))
    every = every.withColumn("slice", F.when(F.col("ts") < at(15), 0).when(F.col("ts") < at(600), 1).otherwise(2))
    folder, out = f"file://{tmp_path}/deliveries", []

    def make(e):
        e = e.withWatermark("ts", "1 second")
        return deliveries.outcomes(e.filter("is_push").withColumnRenamed("ts", "sent"), e.filter("NOT is_push").withColumnRenamed("ts", "at"), "300 seconds")

    monitors.replayed(every, 3, folder, lambda stream, state: out.append(monitors.available_now(make(stream), f"{folder}/out", state)))
    batch = deliveries.batch_outcomes(d, a, "300 seconds", F.lit(at(899)))
    assert sorted(map(tuple, out[-1].collect())) == sorted(map(tuple, batch.collect()))
    for found in (out[-1], batch):
        states = {(r.id, round((r.sent.astimezone(timezone.utc) - START).total_seconds())): (r.state, r.acked_at and round((r.acked_at.astimezone(timezone.utc) - START).total_seconds()), r.refusals) for r in deliveries.delivery_states(d, found).collect()}
        # 2: refused once, its owner came late; 4: nobody; 5: still waiting; 1 was sent again
        assert states == {(1, 0): ("acked", 5, 0), (2, 10): ("resend", None, 1), (3, 20): ("acked", 60, 1), (4, 30): ("resend", None, 0), (5, 900): ("pending", None, 0), (1, 700): ("acked", 705, 0)}
