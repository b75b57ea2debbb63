"""Concept graph over an edge table (atom, concept): document frequencies, neighbours, centrality, bridges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

#: Pairs of a task, about.
TASK_PAIRS = 1 << 20
#: Concepts up to this number travel with the tasks that read the atoms.
MOST_SENT = 1 << 21


def with_idf(edges: DataFrame) -> DataFrame:
    """concept, df, idf = ln(atoms / df)."""
    edges = edges.distinct()
    n = edges.agg(F.count_distinct("atom").alias("n"))
    df = edges.groupBy("concept").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("concept", "df", F.ln(F.col("n") / F.col("df")).alias("idf"))  # one row of totals


def neighbours(edges: DataFrame, seeds: DataFrame, least_idf: float) -> DataFrame:
    """atom, score: summed idf of the concepts that an atom outside the seeds shares with them."""
    edges = edges.distinct()
    shared = edges.join(seeds.select("atom").distinct(), "atom", "left_semi").select("concept").distinct().join(with_idf(edges).filter(F.col("idf") >= least_idf), "concept")
    return edges.join(shared, "concept").join(seeds.select("atom").distinct(), "atom", "left_anti").groupBy("atom").agg(F.sum("idf").alias("score"))


def centrality(edges: DataFrame, members: DataFrame) -> DataFrame:
    """atom, score: over its concepts, idf times the number of other members with the concept."""
    edges = edges.distinct()
    own = edges.join(members.select("atom").distinct(), "atom", "left_semi")
    weight = own.groupBy("concept").agg((F.count("*") - 1).alias("others")).join(with_idf(edges), "concept").select("concept", (F.col("idf") * F.col("others")).alias("w"))
    return own.join(weight, "concept").groupBy("atom").agg(F.sum("w").alias("score"))


def connectivity(edges: DataFrame, most_df: int) -> DataFrame:
    """One row: concepts, singletons, connectors (df from 2 to most_df), inert atoms (no concept shared), links per atom."""
    edges = edges.distinct()
    df = edges.groupBy("concept").agg(F.count("*").alias("df"))
    concepts = df.agg(F.count("*").alias("concepts"), F.count_if(F.col("df") == 1).alias("singletons"), F.count_if(F.col("df").between(2, most_df)).alias("connectors"))
    atoms = edges.join(df, "concept").groupBy("atom").agg(F.max("df").alias("top"), F.count("*").alias("links"))
    return concepts.crossJoin(F.broadcast(atoms.agg(F.count_if(F.col("top") == 1).alias("inert"), F.round(F.avg("links"), 6).alias("links_per_atom"))))


def pairs_within(sets: DataFrame, pairs: int | None = None) -> DataFrame:
    """a, b, n: rows whose array cs (sorted, distinct) holds both (a < b). pairs: how many are formed, for bounded tasks."""
    first = sets.select("cs", F.posexplode("cs").alias("i", "a"))
    each = first.select("a", F.explode(F.slice("cs", F.col("i") + 2, F.size("cs"))).alias("b"))
    if pairs is not None:
        each = each.repartition(1 + pairs // TASK_PAIRS, "a", "b")
    return each.groupBy("a", "b").agg(F.count("*").alias("n"))


def cooccurrence(edges: DataFrame, least: int = 1) -> DataFrame:
    """a, b, n: atoms that hold both concepts (a < b). Pairs are formed within an atom's concepts only.

    The number of tasks follows that of the pairs, so a task's memory does not grow. Pairs are mostly met once: counting
    them before they are shuffled would hold them and spare nothing.
    """
    sets = stored(edges.groupBy("atom").agg(F.array_sort(F.collect_set("concept")).alias("cs")), "sets")
    n = F.size("cs").cast("long")
    return pairs_within(sets, sets.agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)).cast("long").alias("n")).first().n).filter(F.col("n") >= least)


def shared_neighbours(edges: DataFrame, most_concepts: int = 64) -> DataFrame:
    """atom, neighbours: the number of other atoms that share a concept with it; atoms without any have no row.

    Each concept offers its other atoms, which is a count. One that shares m concepts was offered m times, so m - 1 are
    taken off: such atoms hold a pair of concepts that several hold, and only these are met. Atoms of more than
    `most_concepts` are met by their concepts, one for one, and both sides' counts are put right.
    """
    edges = stored(edges.filter("concept IS NOT NULL AND atom IS NOT NULL").distinct(), "edges")
    df = edges.groupBy("concept").agg(F.count("*").alias("df"))
    offered = edges.join(df, "concept").groupBy("atom").agg(F.sum(F.col("df") - 1).alias("n"))
    sets = stored(edges.groupBy("atom").agg(F.array_sort(F.collect_set("concept")).alias("cs")).filter("size(cs) > 1"), "sets")
    narrow, wide = sets.filter(F.size("cs") <= most_concepts), sets.filter(F.size("cs") > most_concepts)
    first = narrow.select("atom", "cs", F.posexplode("cs").alias("i", "a"))
    held = first.select("atom", "a", F.explode(F.slice("cs", F.col("i") + 2, F.size("cs"))).alias("b"))
    several = held.groupBy("a", "b").agg(F.count("*").alias("k")).filter("k > 1").select("a", "b")
    both = stored(held.join(several, ["a", "b"]), "pairs")
    other = both.select(F.col("atom").alias("other"), "a", "b")
    met = both.join(other, ["a", "b"]).filter("atom <> other").groupBy("atom", "other").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))).alias("m"))
    far = edges.join(wide.select("atom"), "atom", "left_semi").withColumnRenamed("atom", "other")
    mixed = edges.join(far, "concept").filter("atom <> other").groupBy("atom", "other").agg(F.count("*").alias("m"))
    # a pair of wide atoms is met from both sides, one of a wide and a narrow one from the wide side only
    back = mixed.join(wide.select("atom"), "atom", "left_anti").select(F.col("other").alias("atom"), F.col("atom").alias("other"), "m")
    less = met.unionByName(mixed).unionByName(back).filter("m > 1").groupBy("atom").agg(F.sum(F.col("m") - 1).alias("less"))
    left = offered.join(less, "atom", "left").select("atom", (F.col("n") - F.coalesce("less", F.lit(0))).alias("neighbours"))
    return left.filter("neighbours > 0")


def pack(values: np.ndarray) -> bytes:
    """Ascending distinct numbers as the first one and the gaps: their lowest bytes, then the next ones, as far as any gap has
    them. The highest are much alike, so a shuffle's compression leaves little of them."""
    gaps = np.diff(values.view(np.uint64))
    width = (int(gaps.max(initial=0)).bit_length() + 7) // 8
    return values[:1].tobytes() + bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() if len(values) else b""


def unpack(body: bytes) -> np.ndarray:
    if len(body) < 10:  # at most one number, no gaps
        return np.frombuffer(body[:8], np.int64)
    parts = np.frombuffer(body, np.uint8, offset=9).reshape(body[8], -1)
    gaps = np.zeros((parts.shape[1], 8), np.uint8)
    gaps[:, : body[8]] = parts.T
    return np.cumsum(np.append(np.frombuffer(body, np.uint64, 1), gaps.view(np.uint64).ravel())).view(np.int64)


def _packed(batches):
    """(c, sorted array) to c, size, the packed array."""
    for batch in batches:
        lists = batch.column(1)
        values, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        bodies = [pack(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int32()), pa.array(bodies, pa.binary())], names=["c", "k", "body"])


def _common(batches):
    """Rows (home, a, b, n, k_a, k_b, body) sorted by home, its own row without a pair first, to the pairs with the numbers that
    both bodies have."""
    own = None
    for batch in batches:
        rows, common = [], []
        for i, (a, body) in enumerate(zip(batch.column(1).to_pylist(), batch.column(6).to_pylist(), strict=True)):
            part = unpack(body)
            if a is None:
                own = part
                continue
            at = np.searchsorted(own, part)
            rows.append(i)
            common.append(int((own[np.minimum(at, len(own) - 1)] == part).sum()))
        taken = batch.select([1, 2, 3, 4, 5]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(common, pa.int64())], names=["a", "b", "n", "k_a", "k_b", "common"])


def _numbered(edges: DataFrame, least_df: int, most_together: int) -> DataFrame:
    """bridges() of concepts that are not whole numbers."""
    ids = stored(edges.select("concept").filter("concept IS NOT NULL").distinct().withColumn("id", F.monotonically_increasing_id()), "ids")
    found = bridges(edges.join(ids, "concept").select("atom", F.col("id").alias("concept")), least_df, most_together)
    for side in ("a", "b"):
        found = found.join(ids.select(F.col("id").alias(side), F.col("concept").alias(f"name_{side}")), side)
    return found.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"), "n", "surprise")


def bridges(edges: DataFrame, least_df: int, most_together: int) -> DataFrame:
    """a, b, n, surprise: frequent concepts that seldom occur together, 1 - Jaccard of the concepts around each.

    Only pairs of frequent concepts are formed, and what is around each is one packed list. Of a pair the shorter list
    travels to the longer one, and tasks count what both have: no row is made for a pair and a concept around it. Edges without
    an atom count for a concept's frequency only.
    """
    kind = dict(edges.dtypes)["concept"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        return _numbered(edges, least_df, most_together)
    sets = stored(edges.groupBy("atom").agg(F.array_sort(F.collect_set(F.col("concept").cast("long"))).alias("cs")), "sets")
    frequent = stored(sets.select(F.explode("cs").alias("c")).groupBy("c").agg(F.count("*").alias("df")).filter(F.col("df") >= least_df).select("c"), "frequent")
    held = sets.filter("atom IS NOT NULL AND size(cs) > 1").select("atom", "cs", F.explode("cs").alias("c"))
    held = held.join(F.broadcast(frequent) if frequent.count() <= MOST_SENT else frequent, "c")
    some = stored(held.groupBy("atom").agg(F.array_sort(F.collect_list("c")).alias("cs")).filter("size(cs) > 1"), "some")
    n = F.size("cs").cast("long")
    pairs = pairs_within(some, some.agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)).cast("long").alias("n")).first().n).filter(F.col("n") <= most_together)
    others = F.array_distinct(F.flatten(F.collect_list(F.array_remove("cs", F.col("c")))))
    around = stored(held.groupBy("c").agg(F.array_sort(others).alias("os")).mapInArrow(_packed, "c long, k int, body binary"), "around")
    for side in ("a", "b"):
        pairs = pairs.join(around.select(F.col("c").alias(side), F.col("k").alias(f"k_{side}")), side)
    less = F.col("k_a") < F.col("k_b")
    pairs = pairs.select("a", "b", "n", "k_a", "k_b", F.when(less, F.col("a")).otherwise(F.col("b")).alias("c"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("home"))
    pairs = stored(pairs, "pairs")
    columns = ["home", "a", "b", "n", "k_a", "k_b", "body"]
    homes = around.join(pairs.select(F.col("home").alias("c")).distinct(), "c", "left_semi").select(F.col("c").alias("home"), "body")
    rows = pairs.join(around.select("c", "body"), "c").select(columns).unionByName(homes, allowMissingColumns=True)
    found = rows.repartition("home").sortWithinPartitions("home", "a").mapInArrow(_common, "a long, b long, n long, k_a int, k_b int, common long")
    # each is in the other's surroundings, which doesn't count
    union = F.col("k_a") - 1 + F.col("k_b") - 1 - F.col("common")
    surprise = F.when(union > 0, 1 - F.col("common") / union).otherwise(1.0)
    return found.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "n", surprise.alias("surprise"))


def local_graph(edges: DataFrame, seed, hops: int = 1, most_nodes: int = 40, least_idf: float = 0.0, most_edges: int = 0) -> DataFrame:
    """a, b, concept, weight: the strongest link of each pair of atoms met within some hops of the seed.

    A hop offers the atoms that share a concept of idf `least_idf` or more with one of the hop before, strongest link
    first (ties by names); at most `most_nodes` atoms join. `most_edges` above 0 keeps the seed's links first. Only the
    atoms of the graph, at most `most_nodes`, are ever in the driver.
    """
    edges = edges.distinct()
    idf = with_idf(edges).filter((F.col("idf") >= least_idf) & (F.col("idf") > 0)).select("concept", "idf")
    spark, nodes, front, offered = edges.sparkSession, [seed], [seed], None
    kind = dict(edges.dtypes)["atom"]
    for _ in range(max(1, hops)):
        here = F.broadcast(spark.createDataFrame([(x,) for x in front], f"origin {kind}"))  # at most most_nodes rows
        links = edges.join(here, F.col("atom") == F.col("origin")).select("origin", "concept").join(idf, "concept")
        found = links.join(edges.withColumnRenamed("atom", "target"), "concept").filter("origin <> target")
        fresh = found.filter(~F.col("target").isin(nodes)).groupBy("target").agg(F.min(F.struct((-F.col("idf")).alias("w"), "origin", "target", "concept")).alias("m"))
        front = [r.target for r in fresh.orderBy("m").limit(max(0, most_nodes - len(nodes))).collect()]
        nodes += front
        inside = found.filter(F.col("target").isin(nodes))
        offered = inside if offered is None else offered.unionByName(inside)
        if not front:
            break
    pair = [F.least("origin", "target").alias("a"), F.greatest("origin", "target").alias("b")]
    best = offered.groupBy(*pair).agg(F.min(F.struct((-F.col("idf")).alias("w"), "concept")).alias("m")).select("a", "b", "m.concept", F.round(-F.col("m.w"), 3).alias("weight"))
    if most_edges > 0:
        own = (F.col("a") == F.lit(seed)) | (F.col("b") == F.lit(seed))
        best = best.orderBy(F.desc(own), F.desc("weight"), "a", "b").limit(most_edges)
    return best
