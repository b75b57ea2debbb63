"""How the sources of a language differ in their use of terms, by term-block dense matrices.

Terms are runs of letters A-Z, a-z and of any characters from U+0080, of which only A-Z are lower-cased; a language keeps
the V terms found in at least `least_docs` of its documents. A group (language and source) gives each kept term the share
p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), with N its occurrences of kept terms; so does the language.

The kept terms of a language are dealt to blocks by hash. A block is one task's dense int64 matrix, groups by terms, whose
shares are set against each other by broadcasting: every pair of groups gets a partial sum of differences, every group
its largest excesses over its language. Partial sums are added up and the best kept by Spark. The number of terms of a block
falls with the number of groups, so a matrix has about CELLS numbers, whatever the corpus.

All arithmetic is exact: shares are divided digit by digit in int64, for N + PRIOR * V below 9 * 10**15.

Null text, lang and source count as ''. Each row counts as a document, also a repeated one or one with a null doc_id.
Ties go by the item's UTF-8 bytes. Groups without terms take part; a language without kept terms has pairs of value 0 and
no terms. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import binary_parts, released, stored

SCALE, PRIOR = 1_000_000_000, 5
#: Numbers in a block's matrix, about, terms of a block at most, and numbers of one broadcast difference.
CELLS, MOST_TERMS, SLAB = 1 << 20, 1024, 1 << 22
#: Distinct terms that a task counts before it hands its counts on.
HELD = 200_000
#: A-Z become a-z, other letters and all bytes of characters from U+0080 stay, the rest are gaps.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _counted(batches):
    """(lang, source, body) to counts of (lang, source, term), a row without a term for each group met."""

    def rows(held):
        for (lang, source), (n, docs) in held.items():
            terms = [None, *(t.decode() for t in n)]
            columns = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())], schema=COUNTED)

    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for batch in batches:
        data, offsets = binary_parts(batch.column("body"))
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for group, a, b in zip(groups, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found = Counter(data[a:b].tobytes().translate(TERM_BYTES).split())
            n, docs = held.setdefault(group, (Counter(), Counter()))
            n.update(found)
            docs.update(found.keys())
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from rows(held)
            held = {}
    yield from rows(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents that hold the term; a row with a null term for each group."""
    empty = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")}
    texts = docs.select(*empty.values(), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"))
    counts = texts.mapInArrow(released(_counted), "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / total), exactly: three digits at a time, so nothing passes 64 bits."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def pair_sums(p: np.ndarray):
    """Yields (first group, other groups, sums of |p - q|) for the rows of a group-by-term matrix, each pair once."""
    n, step = p.shape[0], max(1, SLAB // max(1, p.size))
    for s in range(0, n, step):
        sums = np.abs(p[s : s + step, None, :] - p[None, s:, :]).sum(axis=2)
        for i in range(len(sums)):
            yield s + i, np.arange(s + i + 1, n), sums[i, i + 1 :]


def _block(top: int):
    """All rows of a block: every group with its N (term null) and the counts of the block's terms."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lang = table.column("lang")[0].as_py()
        term = table.column("term")
        head = table.filter(term.is_null()).sort_by("source")
        cells = table.filter(term.is_valid())
        sources = head.column("source").to_pylist()
        row = pa.compute.index_in(cells.column("source"), head.column("source").combine_chunks()).to_numpy()
        terms = pa.compute.unique(cells.column("term")).sort()  # by UTF-8 bytes, as ties are
        column = pa.compute.index_in(cells.column("term"), terms).to_numpy()
        count = np.zeros((len(sources), len(terms)), np.int64)
        count[row, column] = cells.column("n").to_numpy()
        prior = PRIOR * table.column("kept_terms")[0].as_py()
        out = []
        if len(terms):
            p = shares(count + PRIOR, head.column("group_n").to_numpy()[:, None] + prior)
            q = shares(count.sum(axis=0) + PRIOR, table.column("lang_n")[0].as_py() + prior)
            excess = np.where(count > 0, p - q, 0)
            for i, source in enumerate(sources):
                best = np.argsort(-excess[i], kind="stable")[:top]
                best = best[excess[i][best] > 0]
                out.append((source, "term", terms.take(pa.array(best)), excess[i][best]))
        else:
            p = np.zeros((len(sources), 1), np.int64)
        names = pa.array(sources, pa.string())
        out += [(sources[i], "pair", names.take(pa.array(others)), sums) for i, others, sums in pair_sums(p)]
        made = [pa.RecordBatch.from_arrays([*(pa.array([x] * len(v), pa.string()) for x in (lang, source, part)), item.cast(pa.string()), pa.array(v, pa.int64())], schema=FOUND) for source, part, item, v in out]
        return pa.Table.from_batches(made, FOUND)

    return run


def blocks(counts: DataFrame, least_docs: int = 30) -> DataFrame:
    """Rows of every block of kept terms, one block at least for each lang: the counts, and each group once."""
    by_lang = Window.partitionBy("lang", "term")
    kept = counts.filter("term IS NOT NULL").withColumn("found_in", F.sum("docs").over(by_lang)).filter(F.col("found_in") >= least_docs)
    kept = stored(kept.select("lang", "source", "term", "n"), "kept")
    group_n = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(group_n, ["lang", "source"], "left").withColumn("group_n", F.coalesce("group_n", F.lit(0).cast("long")))
    groups = stored(groups, "groups")
    lang_terms = kept.groupBy("lang", "term").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("kept_terms"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_groups"), F.sum("group_n").alias("lang_n")).join(lang_terms, "lang", "left")
    each = F.least(F.lit(MOST_TERMS), F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("n_groups"))))
    langs = langs.withColumn("kept_terms", F.coalesce("kept_terms", F.lit(0).cast("long"))).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("kept_terms") / each)))
    langs = stored(langs.select("lang", "kept_terms", "lang_n", "n_blocks"), "langs")
    head = groups.join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    cells = kept.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("n_blocks")))
    names = ["lang", "block", "source", "kept_terms", "lang_n"]
    rest = head.select(*names, "group_n", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"))
    return rest.unionByName(cells.select(*names, F.lit(None).cast("long").alias("group_n"), "term", "n"))


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: for each group every other source of its language (part pair), and its
    `top` terms of the largest excess over the language (part term)."""
    counts = stored(term_counts(docs), "terms")
    found = stored(blocks(counts, least_docs).groupBy("lang", "block").applyInArrow(_block(top), "lang string, source string, part string, item string, value long"), "found")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", ways.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms.select(pairs.columns))


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY lang, source, v),
lt AS (SELECT lang, sum(total) AS total FROM g GROUP BY lang),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (g.total + 5 * g.v) AS p
      FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT lc.lang, lc.term, 1 + CAST(1000000000 AS HUGEINT) * (lc.n + 5) // (lt.total + 5 * v.v) AS q FROM lc JOIN lt USING (lang) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT r.lang, r.source AS one, s.source AS other, sum(abs(r.p - s.p)) AS f FROM p r JOIN p s ON r.lang = s.lang AND r.term = s.term AND r.source <> s.source GROUP BY ALL) x
          ON x.lang = a.lang AND x.one = a.source AND x.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
