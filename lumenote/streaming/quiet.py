"""State machines over a key's quiet times: asking before idle work starts, and work put off until it is quiet.

Events wait in the state until the watermark has passed them and are then taken in time order (ties: by item, those
without one last), so results don't depend on how the input was cut into micro-batches. Deadlines are event-time timers;
one that falls between two events, or before the watermark, is acted on at its own time. What waits is what a key sends
within the watermark's delay and a micro-batch. Events later than the watermark are dropped, as everywhere in Spark.

Keys are dealt to buckets by their hash, and a bucket is what Spark groups by: calls, timers and reads of the state are
made for a bucket, not for each of its keys. A bucket's states are read and written together, so the number of buckets
should follow that of the events; it is fixed for the life of a checkpoint.

These run by transformWithStateInPandas and need the RocksDB state store: `state_session` gives a session that has it.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, IntegralType, LongType, StringType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000
#: Buckets of keys, unless a caller says otherwise.
BUCKETS = 1024
PACKED = StructType([StructField("packed", BinaryType())])
ACTION = StructType([StructField("at", LongType()), StructField("action", StringType()), StructField("item", LongType())])


def state_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of its own with the state store that timers and list state need. partitions: of state at most; each is a
    store of its own, which costs time and some 5 MB of disk even where it holds little."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    if partitions is not None:
        own.conf.set("spark.sql.shuffle.partitions", min(partitions, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return own


def dealt(rows: DataFrame, key: list[str], buckets: int) -> list[Column]:
    """The column `bucket`, and the key's. The last bits of the bucket say which of them are null, so those of a bucket are
    null or not throughout; whole numbers travel as 0 then, as pandas makes doubles of columns with nulls."""
    number = F.pmod(F.xxhash64(*key), F.lit(buckets))
    for k in key:
        number = number * 2 + F.isnull(k).cast("long")
    whole = {k for k in key if isinstance(rows.schema[k].dataType, IntegralType)}
    return [number.alias("bucket"), *(F.coalesce(k, F.lit(0).cast(rows.schema[k].dataType)).alias(k) if k in whole else F.col(k) for k in key)]


def names_of(frame: pd.DataFrame, key: list[str], bucket: int) -> list[tuple]:
    """The keys of a bucket's rows as tuples."""
    null = [bucket >> i & 1 for i in reversed(range(len(key)))]
    return list(zip(*([None] * len(frame) if n else frame[k].tolist() for k, n in zip(key, null, strict=True)), strict=True))


def pack(value) -> tuple[bytes]:
    """A row of PACKED."""
    return (zlib.compress(pickle.dumps(value), 1),)


def unpack(row):
    return pickle.loads(zlib.decompress(row[0]))


class InTimeOrder(StatefulProcessor):
    """Takes the events (at, kind, item) of each key of a bucket in time order. `enter` and `deadline` are the machine's;
    times are in microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PACKED)
        self.states = handle.getValueState("states", PACKED)
        self.passed: dict[int, int] = {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            events = list(zip(frame["at"].tolist(), frame["bare"].tolist(), frame["item"].tolist(), names_of(frame, self.key, key[0]), frame["kind"].tolist(), strict=True))
            if events:
                self.waiting.appendValue(pack(events))
                first = min(e[0] for e in events) if first is None else min(first, *(e[0] for e in events))
        if first is not None:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000 + 999
        if self.passed.get(key[0]) == now:
            return  # another timer of the bucket
        self.passed[key[0]] = now
        waiting = [e for row in self.waiting.get() for e in unpack(row)]
        due = sorted((e for e in waiting if e[0] <= now), key=itemgetter(0, 1, 2))
        rest = [e for e in waiting if e[0] > now]
        if due:
            if rest:
                self.waiting.put([pack(rest)])
            else:
                self.waiting.clear()
        states = unpack(self.states.get()) if self.states.exists() else {}
        out: list[tuple[int, str, int | None]] = []
        whose: list[tuple] = []
        for at, bare, item, name, kind in due:
            state = self._until(states[name] if name in states else self.begin(), at, out)
            states[name] = self.enter(state, at, kind, None if bare else item, out)
            whose += [name] * (len(out) - len(whose))
        wakes = [min(e[0] for e in rest)] if rest else []
        for name, before in states.items():
            states[name] = state = self._until(before, now, out)
            whose += [name] * (len(out) - len(whose))
            if (at := self.deadline(state)) is not None:
                wakes.append(at)
        if due or out:
            self.states.update(pack(states))
        if wakes:
            self._wake(min(wakes))
        if out:
            yield pd.DataFrame({**{k: [n[i] for n in whose] for i, k in enumerate(self.key)}, "at": [o[0] for o in out], "action": [o[1] for o in out], "item": pd.array([o[2] for o in out], "Int64")})

    def close(self) -> None:
        pass

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def _until(self, state, now: int, out: list):
        """Act on every deadline up to now."""
        while (at := self.deadline(state)) is not None and at <= now:
            state = self.pass_deadline(state, at, out)
        return state


class IdleMachine(InTimeOrder):
    """active, after `ask` without input asking, after `answer` without a word running; input ends all of them.

    A yes while asking runs at once; a no lasts until input comes. Answers at other times are ignored.
    """

    def __init__(self, key: list[str], ask: float, answer: float):
        self.key, self.ask, self.answer = key, round(ask * SECOND), round(answer * SECOND)

    def begin(self):
        return "new", None

    def deadline(self, state):
        phase, since = state
        return since + self.ask if phase == "active" else since + self.answer if phase == "asking" else None

    def pass_deadline(self, state, at, out):
        asks = state[0] == "active"
        out.append((at, "ask" if asks else "run", None))
        return "asking" if asks else "running", at

    def enter(self, state, at, kind, item, out):
        if kind == "input":
            if state[0] == "running":
                out.append((at, "stop", None))
            return "active", at
        if state[0] == "asking" and kind == "yes":
            out.append((at, "run", None))
            return "running", at
        return ("refused", at) if state[0] == "asking" and kind == "no" else state


class PutOff(InTimeOrder):
    """Work that ends of conversations leave (kind close, with an item) is handed on after `grace` of quiet.

    Any other event takes the timer back, not the items: they go with those of the next end that stays quiet.
    """

    def __init__(self, key: list[str], grace: float):
        self.key, self.grace = key, round(grace * SECOND)

    def begin(self):
        return None, []

    def deadline(self, state):
        return None if state[0] is None else state[0] + self.grace

    def pass_deadline(self, state, at, out):
        out.extend((at, "hand on", item) for item in state[1])
        return self.begin()

    def enter(self, state, at, kind, item, out):
        items = state[1]
        if kind != "close":
            return None, items
        if item is not None:
            items.append(item)
        return at, items


def _run(events: DataFrame, machine: InTimeOrder, kind, item: str, buckets: int) -> DataFrame:
    """events need a watermarked timestamp `ts`."""
    key, number = machine.key, F.col(item).cast("long")
    rows = events.filter("ts IS NOT NULL").select(*dealt(events, key, buckets), "ts", F.unix_micros("ts").alias("at"), kind.alias("kind"), F.coalesce(number, F.lit(0)).alias("item"), F.isnull(number).alias("bare"))
    out = StructType([*(events.schema[k] for k in key), *ACTION.fields])
    found = rows.groupBy("bucket").transformWithStateInPandas(machine, outputStructType=out, outputMode="Append", timeMode="eventTime")
    return found.select(*key, F.timestamp_micros("at").alias("at"), "action", "item")


def idle_actions(events: DataFrame, key: list[str], kind, item: str, ask: float = 300, answer: float = 15, buckets: int = BUCKETS) -> DataFrame:
    """key, at, action (ask, run, stop) of every key's idle machine. kind: a column of input, yes and no."""
    return _run(events, IdleMachine(key, ask, answer), kind, item, buckets).drop("item")


def put_off_work(events: DataFrame, key: list[str], kind, item: str, grace: float, buckets: int = BUCKETS) -> DataFrame:
    """key, item, at: each item of an end of conversation (kind `close`) and when it is handed on."""
    return _run(events, PutOff(key, grace), kind, item, buckets).select(*key, "item", "at")
