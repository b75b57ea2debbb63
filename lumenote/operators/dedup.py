"""Clustering and near-duplicate decisions over vectors (id, v), connected components, hop distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near import earliest_near, usable
from .tables import dropped, stored


def clusters(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component, by alternating star steps, each stored."""
    now, last = edges.select("a", "b").filter("a <> b"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        down = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        parent = down.groupBy("a").agg(F.min("b").alias("m"))
        linked = down.join(parent, "a")
        stars = linked.select("a", F.col("m").alias("b")).unionByName(linked.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        now = stored(stars)
        if last is not None:
            dropped(last)
        last = now
        several = now.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
        if not several and not now.join(now.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def leaders(rows: DataFrame, most: float) -> DataFrame:
    """id, leader: greedy leader clustering of vectors (id, v) in the order of id.

    A row leads if no earlier leader is nearer than `most`, and else belongs to the smallest such leader. In rounds: an
    undecided row without an earlier undecided one near it leads, and rows near a new earlier leader are members. Each
    round is stored, and compares in blocks that return one row per vector.
    """
    rows = stored(rows)
    open_rows, led = rows, None
    while open_rows.limit(1).count():
        behind = earliest_near(open_rows, open_rows, most)
        fresh = stored(open_rows.join(behind, "id", "left_anti"))
        led = fresh if led is None else led.unionByName(fresh)
        rest = open_rows.join(fresh.select("id"), "id", "left_anti")
        open_rows = stored(rest.join(earliest_near(rest, fresh, most), "id", "left_anti"))
    if led is None:
        return rows.select("id", F.col("id").alias("leader"))
    members = earliest_near(rows.join(led.select("id"), "id", "left_anti"), led, most)
    return led.select("id", F.col("id").alias("leader")).unionByName(members.withColumnRenamed("least", "leader"))


def kept(rows: DataFrame, most: float) -> DataFrame:
    """id, kept: the running decision in the order of id, to keep a vector unless one kept before is nearer than `most`."""
    return leaders(rows, most).select("id", (F.col("id") == F.col("leader")).alias("kept"))


def write_decision(nearest: DataFrame, drop_below: float, replace_below: float) -> DataFrame:
    """Adds decision: replace the near older note if the new work is declared newer, else drop an exact twin, else keep."""
    rule = F.when((F.col("distance") < replace_below) & F.col("newer"), "replace").when(F.col("distance") < drop_below, "drop").otherwise("keep")
    return nearest.withColumn("decision", rule)


def hop_distances(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """atom, hops: fewest steps from any seed through shared concepts, up to `most` steps; unreached atoms are left out."""
    edges = stored(edges.distinct())
    seen = stored(seeds.select("atom").distinct().withColumn("hops", F.lit(0)))
    for hop in range(1, most + 1):
        front = seen.filter(F.col("hops") == hop - 1).select("atom")
        concepts = edges.join(front, "atom", "left_semi").select("concept").distinct()
        fresh = edges.join(concepts, "concept", "left_semi").select("atom").distinct().join(seen, "atom", "left_anti")
        seen = stored(seen.unionByName(fresh.withColumn("hops", F.lit(hop))))
        if not seen.filter(F.col("hops") == hop).limit(1).count():
            break
    return seen


def consolidation_plan(rows: DataFrame, root: str, most: float, least: int = 3, groups: int = 50) -> DataFrame:
    """leader, source, n: the groups of nearly equal notes below a root that one cycle merges.

    rows: id, source (a path), vector. A source's first usable vector (by id) stands for it. Groups are those of `leaders`
    with `least` members or more, the largest first (ties: the smaller leader), at most `groups` of them.
    """
    inside = F.regexp_replace(F.replace("source", F.lit("\\"), F.lit("/")), "/+", "/")
    known = usable(rows.withColumn("_s", inside), "id", "vector", "_s").filter(F.col("_s").startswith(root.rstrip("/") + "/"))
    first = stored(known.groupBy("_s").agg(F.min_by(F.struct("id", "v"), "id").alias("x")).select("x.id", "x.v", F.col("_s").alias("source")))
    led = stored(leaders(first.select("id", "v"), most))
    sizes = led.groupBy("leader").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    chosen = sizes.orderBy(F.desc("n"), "leader").limit(groups)
    return led.join(F.broadcast(chosen), "leader").join(first.select("id", "source"), "id").select("leader", "source", "n")  # `groups` rows
