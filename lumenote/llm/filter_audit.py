"""How document filters interact: what each would remove at each step of every order of application.

A document's failures are a set, one bit a filter. Which step removes it under an order depends on that set alone, so a
table of all sets by all orders (32 by 120 for five filters) holds the first failing step; tasks look it up for their
rows, count removals by part, order and step, and the partial counts are summed.

The filters, on whole texts (null: empty; words are runs without white space, case-sensitive):
A under 100 words; B 100 * distinct words < 80 * words; C 100 * capitals A-Z > 10 * code points; D any of #$%&*|;
E the text of a smaller doc_id, wherever in the table it is and whether it stays or not.

Texts are read once, by the tasks that judge A to D; E compares SHA-256 digests. What a digest's documents add is summed
by part and labels before anything meets at the digest, so a text with many copies is not one task's work.

A null lang is the empty part. Each row counts, also a repeated one (a copy of itself is not a smaller doc_id). A row
with a null doc_id has no labels, and makes no other row a copy nor is one. A document of several labels takes the
largest; null labels count as 0. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import binary_parts, released

FILTERS = "ABCDE"
ORDERS = list(permutations(range(len(FILTERS))))
COPY = 1 << FILTERS.index("E")
CAPITALS, SIGNS = bytes(range(65, 91)), b"#$%&*|"
#: Rows whose lookups are held at a time.
ROWS = 8192
JUDGED = "doc_id long, part string, digest binary, fails int"
COUNTED = "part string, filter_order int, step int, total long, failing long, unique_fails long, removed long, good_lost long, toxic_lost long"


def first_failures() -> np.ndarray:
    """Step (from 0) of the first failing filter, for each set of failures and each order; the number of filters if none."""
    sets = np.arange(1 << len(FILTERS))
    failing = (sets[:, None, None] >> np.array(ORDERS)[None]) & 1  # set, order, step
    return np.where(failing.any(axis=2), failing.argmax(axis=2), len(FILTERS))


def failures(body: bytes) -> int:
    """The set of filters A to D that a text fails."""
    words = body.split()  # of bytes: at spaces and the control bytes 9 to 13
    points = len(body) - int(np.count_nonzero((np.frombuffer(body, np.uint8) & 0xC0) == 0x80))
    capitals = len(body) - len(body.translate(None, CAPITALS))
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * points, len(body.translate(None, SIGNS)) < len(body))
    return sum(1 << i for i, f in enumerate(fails) if f)


def _judged(batches):
    for batch in batches:
        data, offsets = binary_parts(batch.column("body"))
        bodies = (data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
        found = [(hashlib.sha256(b).digest(), failures(b)) for b in bodies]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array([d for d, _ in found], pa.binary()), pa.array([f for _, f in found], pa.int32())], names=["doc_id", "part", "digest", "fails"])


def _counted(batches):
    """(part, fails, good, toxic, n) to a task's counts by part, order and step. Counts are exact below 2^53 rows."""
    table, orders, steps = first_failures(), len(ORDERS), len(FILTERS) + 1
    sums: dict[str, np.ndarray] = {}  # part: removed, good and toxic by order and step
    totals: dict[str, np.ndarray] = {}  # part: rows by set of failures
    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        names, at = parts.dictionary.to_pylist(), parts.indices.to_numpy()
        fails, n = batch.column("fails").to_numpy(), batch.column("n").to_numpy()
        by_set = np.bincount(at * len(table) + fails, n, len(names) * len(table)).astype(np.int64).reshape(len(names), -1)
        lost = np.zeros((len(names), 3, orders, steps), np.int64)
        for s in range(0, len(at), ROWS):
            some = slice(s, s + ROWS)
            cell = ((at[some, None] * orders + np.arange(orders)) * steps + table[fails[some]]).ravel()
            for k, weight in enumerate((n[some], n[some] * batch.column("good").to_numpy()[some], n[some] * batch.column("toxic").to_numpy()[some])):
                lost[:, k] += np.bincount(cell, np.repeat(weight, orders), len(names) * orders * steps).astype(np.int64).reshape(-1, orders, steps)
        for i, name in enumerate(names):
            sums[name] = sums.get(name, 0) + lost[i]
            totals[name] = totals.get(name, 0) + by_set[i]
    sets = np.arange(len(table))
    filters = np.array(ORDERS).ravel()
    cells = len(filters)
    for name, lost in sums.items():
        failing = np.array([totals[name][(sets >> f & 1) == 1].sum() for f in range(len(FILTERS))])
        alone = totals[name][1 << np.arange(len(FILTERS))]
        columns = [np.repeat(np.arange(orders), len(FILTERS)), np.tile(np.arange(len(FILTERS)), orders), np.full(cells, totals[name].sum()), failing[filters], alone[filters], *(x[:, : len(FILTERS)].ravel() for x in lost)]
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array([name] * cells, pa.string()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[c.split()[0] for c in COUNTED.split(", ")])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails, good, toxic, n: how many rows fail which filters (E included), summed per text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.mapInArrow(released(_judged), JUDGED).groupBy("doc_id", "part", "digest", "fails").agg(F.count("*").alias("n"))
    best = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.join(best, "doc_id", "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("good", "toxic")})
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    texts = rows.groupBy("digest", "part", "fails", "good", "toxic", F.col("doc_id").isNull().alias("unnamed")).agg(F.sum("n").alias("n"), F.min(known).alias("first"))
    texts = texts.withColumn("smallest", F.min("first.doc_id").over(Window.partitionBy("digest")))
    # of a text's rows with the smallest doc_id none is a copy
    own = F.when(F.col("unnamed"), F.col("n")).when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("fails"), own.alias("n")), F.struct((F.col("fails") + COPY).alias("fails"), (F.col("n") - own).alias("n"))))
    return texts.select("part", "good", "toxic", both.alias("x")).select("part", "x.fails", "good", "toxic", "x.n").filter("n > 0")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of every part,
    order and step, zeros included."""
    cells = judged(docs, labels).mapInArrow(released(_counted), COUNTED)
    names = [c.split()[0] for c in COUNTED.split(", ")][3:]
    cells = cells.groupBy("part", "filter_order", "step").agg(*(F.sum(c).alias(c) for c in names))
    order = F.element_at(F.array(*(F.lit("".join(FILTERS[f] for f in o)) for o in ORDERS)), F.col("filter_order") + 1)
    cells = cells.withColumn("filter_order", order).withColumn("step", F.col("step") + 1)
    own = F.substring("filter_order", F.col("step"), F.lit(1))
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    cells = cells.withColumn("kept", F.col("total") - F.sum("removed").over(so_far)).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", own)))
    return cells.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(words) < 100 AS a,
             100 * len(list_distinct(words)) < 80 * len(words) AS b, 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) AS c,
             regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
      FROM w LEFT JOIN l USING (doc_id)),
n AS (SELECT part, good, toxic, [a, b, c, d, e] AS fails, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [p.k, q.k, r.k, s.k, t.k] AS filters FROM k p, k q, k r, k s, k t WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
c AS (SELECT part, filters, k AS step, filters[k] AS filter, good, toxic, n, fails,
             fails[filters[k]] AS here, len(list_filter(range(1, k), lambda j: fails[filters[j]])) > 0 AS gone,
             len(list_filter(fails, lambda x: x)) AS n_fails FROM n, o, k),
s AS (SELECT part, list_aggregate(list_transform(filters, lambda j: substr('ABCDE', j, 1)), 'string_agg', '') AS filter_order, step, filter,
             coalesce(sum(n) FILTER (NOT gone AND NOT here), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
             coalesce(sum(n) FILTER (here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (here AND n_fails = 1), 0) AS unique_fails,
             coalesce(sum(n * good) FILTER (here AND NOT gone), 0) AS good_lost, coalesce(sum(n * toxic) FILTER (here AND NOT gone), 0) AS toxic_lost
      FROM c GROUP BY part, filters, step, filter)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM s
"""
