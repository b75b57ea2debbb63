"""Ordered folds: what depends on all earlier rows of a key and isn't a window function.

A key's rows stream through one task in order, and only the state is kept between them, never a key's rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def folded(df: DataFrame, key: str, order: list[str], start, step: Callable, out: str, schema: pa.Schema) -> DataFrame:
    """For each row of a key in order, step(state, row as a tuple) gives the next state and a row of `out` or None."""
    columns = df.columns

    def run(batches):
        at, now, state = columns.index(key), None, start
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[at] != now:
                    now, state = row[at], start
                state, one = step(state, row)
                if one is not None:
                    rows.append(one)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return df.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out)


def throttled(events: DataFrame, key: str, seconds: str, window: float) -> DataFrame:
    """key, seconds of the events at least `window` after the last one of the key that was let through."""

    def step(last, row):
        if last is None or row[1] - last >= window:
            return row[1], row
        return last, None

    kind = dict(events.dtypes)[key]
    schema = pa.schema([(key, pa.string() if kind == "string" else pa.int64()), (seconds, pa.float64())])
    rows = events.select(key, F.col(seconds).cast("double")).filter(F.col(seconds).isNotNull())
    return folded(rows, key, [seconds], None, step, f"{key} {'string' if kind == 'string' else 'long'}, {seconds} double", schema)


def integral_means(readings: DataFrame, key: str, order: str, seconds: str, millijoules: str, least_window: float, most_watts: float) -> DataFrame:
    """key, order, watts: mean power at each reading of a counter, null where there is none. The baseline stays while the
    window is too short, and moves on after the first reading, a counter that ran back, or an absurd mean."""

    def step(base, row):
        user, nth, s, mj = row
        if base is None or mj < base[1]:
            return (s, mj), (user, nth, None)
        if s - base[0] < least_window:
            return base, (user, nth, None)
        watts = (mj - base[1]) / 1000 / (s - base[0])
        return (s, mj), (user, nth, watts if watts <= most_watts else None)

    schema = pa.schema([(key, pa.int64()), (order, pa.int64()), ("watts", pa.float64())])
    rows = readings.select(F.col(key).cast("long"), F.col(order).cast("long"), F.col(seconds).cast("double"), F.col(millijoules).cast("double"))
    rows = rows.filter(F.col(seconds).isNotNull() & F.col(millijoules).isNotNull())
    return folded(rows, key, [seconds, order], None, step, f"{key} long, {order} long, watts double", schema)


def breaker_opens(outcomes: DataFrame, key: str, seconds: str, order: str, ok: str, limit: int, cooldown: float) -> DataFrame:
    """Adds open: whether the key's breaker is open at that moment, before the outcome is noted.

    A failure from the `limit`-th in a row on opens it for `cooldown` seconds, a success closes it. So it is open if the
    row before is such a failure and not longer ago.
    """
    w = Window.partitionBy(key).orderBy(seconds, order)
    run = F.sum(F.col(ok).cast("int")).over(w)
    rows = outcomes.withColumn("_run", run)
    nth = F.when(F.col(ok), 0).otherwise(F.sum((~F.col(ok)).cast("int")).over(Window.partitionBy(key, "_run").orderBy(seconds, order)))
    rows = rows.withColumn("_failures", nth)
    before, then = F.lag("_failures").over(w), F.lag(seconds).over(w)
    return rows.withColumn("open", F.coalesce((before >= max(1, limit)) & (F.col(seconds) < then + cooldown), F.lit(False))).drop("_run", "_failures")


def leitner_boxes(answers: DataFrame, key: str, order: list[str], ok: str, intervals: list[int]) -> DataFrame:
    """key, box after all answers in order: a right one moves up to the last box at most, a wrong one back to 0."""
    at = F.struct(*order)
    wrong = answers.groupBy(key).agg(F.max(F.when(~F.col(ok), at)).alias("_wrong"))
    # one row a key on the hashed side
    since = answers.join(wrong.hint("shuffle_hash"), key).filter(F.col("_wrong").isNull() | (at > F.col("_wrong")))
    box = since.groupBy(key).agg(F.count("*").alias("n"))
    top = max(len(intervals) - 1, 0)
    return wrong.join(box, key, "left").select(key, F.least(F.coalesce("n", F.lit(0)), F.lit(top)).cast("int").alias("box"))


def leaks(samples: DataFrame, key: str, order: str, used: str, n: int, slack: float) -> DataFrame:
    """key, order of the samples at which a leak is suspected: the last n samples rose by more than slack and end at
    their highest. The window is emptied when it fires; n is 3 at least."""
    n = max(3, n)

    def step(window, row):
        window = (*(window or ()), row[2])[-n:]
        if len(window) == n and window[-1] - window[0] > slack and window[-1] == max(window):
            return (), row[:2]
        return window, None

    schema = pa.schema([(key, pa.int64()), (order, pa.int64())])
    rows = samples.select(F.col(key).cast("long"), F.col(order).cast("long"), F.col(used).cast("double")).filter(F.col(used).isNotNull())
    return folded(rows, key, [order], None, step, f"{key} long, {order} long", schema)
