"""Findings of review 3 on streams whose state is held by bucket: F13, F18, F22."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lumenote.streaming import monitors, quiet, sentences

START = datetime(2026, 1, 5, 8, tzinfo=timezone.utc)
BIG = 2**60 + 1  # a double does not hold it


@pytest.fixture(scope="module")
def states(spark):
    return quiet.state_session(spark)


def at(seconds):
    return START + timedelta(seconds=seconds)


def in_three(session, rows, make, folder):
    """What a stream of rows (user, group, ts, kind, item, slice) has written, its last one past all deadlines."""
    out, folder = [], f"file://{folder}/{uuid.uuid4().hex}"
    frame = session.createDataFrame([*rows, (0, "end", at(10**6), "input", 0, 2)], "user long, group string, ts timestamp, kind string, item long, slice int")
    monitors.replayed(frame, 3, folder, lambda stream, state: out.append(monitors.available_now(make(stream.withWatermark("ts", "5 seconds")), f"{folder}/out", state)))
    found = out[-1].filter("group <> 'end' OR group IS NULL").withColumn("s", (F.unix_micros("at") / 1e6 - START.timestamp()).cast("int")).drop("at")
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("make", [lambda e: quiet.idle_actions(e, ["user"], F.col("kind"), "item"), lambda e: quiet.put_off_work(e, ["user"], F.col("kind"), "item", 100)])
def test_state_and_calls_follow_the_buckets(states, tmp_path, make):
    rows = [(k, at(i), kind, k) for k in range(6000) for i, kind in enumerate(("close", "input"))]
    states.createDataFrame(rows, "user long, ts timestamp, kind string, item long").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = states.readStream.schema("user long, ts timestamp, kind string, item long").parquet(f"file://{tmp_path}/in").withWatermark("ts", "5 seconds")
    run = make(stream).writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators]
    assert max(held) <= 5 * quiet.BUCKETS  # a few rows a bucket; it was several for each of the 6000 keys


def test_keys_and_items_of_one_bucket_that_are_null_or_large(states, tmp_path):
    users = [None, BIG, BIG + 1, 7]
    rows = [(u, g, at(10 * i), "close", item, i) for u in users for g in (None, "a") for i, item in enumerate([BIG, None, BIG + 2])]
    got = in_three(states, rows, lambda e: quiet.put_off_work(e, ["user", "group"], F.col("kind"), "item", 100, buckets=1), tmp_path)
    assert got == sorted(((u, g, item, 120) for u in users for g in (None, "a") for item in (BIG, BIG + 2)), key=repr)


@pytest.mark.parametrize("buckets", [1, 3, 1000])
def test_many_keys_in_few_buckets(states, tmp_path, buckets):
    rows = [(u, "a", at(u + 200 * i), "close" if (u + i) % 3 else "use", 10 * u + i, i) for u in range(40) for i in range(3)]
    got = in_three(states, rows, lambda e: quiet.put_off_work(e, ["user", "group"], F.col("kind"), "item", 150, buckets=buckets), tmp_path)
    want = []
    for u in range(40):
        held = []
        for i in range(3):
            if (u + i) % 3:
                held.append(10 * u + i)
                want += [(u, "a", item, u + 200 * i + 150) for item in held]
                held = []
    assert got == sorted(want, key=repr)
    asked = in_three(states, rows, lambda e: quiet.idle_actions(e, ["user", "group"], F.lit("input"), "item", 100, 30, buckets=buckets), tmp_path)
    acts = [(u, "a", action, u + 200 * i + s) for u in range(40) for i in range(3) for action, s in (("ask", 100), ("run", 130), ("stop", 200)) if action != "stop" or i < 2]
    assert asked == sorted(acts, key=repr)


def test_state_follows_the_buckets_of_replies(states, tmp_path):
    rows = [(k, s, f"Frase {s} da resposta {k}, inteira. ", s == 3) for k in range(3000) for s in (1, 0, 3)]
    states.createDataFrame(rows, "key long, seq int, piece string, last boolean").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = sentences.spoken(states.readStream.schema("key long, seq int, piece string, last boolean").parquet(f"file://{tmp_path}/in"), "key")
    run = stream.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators]
    assert 0 < max(held) <= quiet.BUCKETS  # one row a bucket; it was two for each of the 3000 replies


def test_replies_of_one_bucket(states, tmp_path):
    texts = {None: "Sem nome. " * 9, BIG: "Uma frase, e outra frase maior. " * 20, BIG + 1: "", 3: "x" * 700}
    steps = [[], [], []]
    for n, (name, text) in enumerate(texts.items()):
        cuts = [text[i : i + 37] for i in range(0, len(text), 37)] or [""]
        for s, piece in enumerate(cuts):
            steps[(s * 7 + n) % 3].append((name, s, piece, s == len(cuts) - 1))
    schema, out = "key long, seq int, piece string, last boolean", f"file://{tmp_path}/out"
    for rows in steps:
        states.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = sentences.spoken(states.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), "key", buckets=1)
        found = monitors.available_now(stream, out, f"file://{tmp_path}/state")
    got = {}
    for r in found.orderBy("nth").collect():
        got.setdefault(r.key, []).append((r.nth, r.sentence))
    assert got == {k: list(enumerate(w)) for k, t in texts.items() if (w := sentences.Cutting().go_on("", t, True, True)[0])}


def test_pieces_are_cut_in_one_pass(spark):
    texts = ["ab\ncde\r\nf😀gh", "", None, "abc", "x" * 1000]
    rows = spark.createDataFrame([(i, t, n) for i, t in enumerate(texts) for n in (1, 3, 400)], "id int, text string, n int")
    cut = sentences.pieces_of(rows.withColumn("k", F.struct("id", "n")), "k", "text", F.col("n"))
    want = {(i, n, s, p, s == len(c) - 1) for i, t in enumerate(texts) for n in (1, 3, 400) for c in [[(t or "")[a : a + n] for a in range(0, len(t or ""), n)] or [""]] for s, p in enumerate(c)}
    assert {(r.k.id, r.k.n, r.seq, r.piece, r["last"]) for r in cut.collect()} == want
    # the text itself is not copied for every piece
    generate = cut._jdf.queryExecution().optimizedPlan().toString().split("Generate ")[1].splitlines()
    assert "_t" not in generate[0] and "explode(" in generate[0]
