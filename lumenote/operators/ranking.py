"""Retrieval: exact cosine search, BM25, rank fusion, ranking quality, threshold calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import is_stop_word, tokens
from . import cosine
from .tables import small_batches, stored

#: Scores that a task holds at once, and terms of queries at most that travel with the tasks.
SCORES, MOST_ASKED = 1 << 20, 1 << 20
DIGITS = 9


def nearest(vectors: DataFrame, queries: DataFrame, id_column: str, vector: str, k: int, most_queries: int | None = None, **rule) -> DataFrame:
    """query_id, id, distance, place: exact top k of each query vector (ties: smaller id), as cosine.compared has it.

    More than `most_queries`, where given, meet the vectors in tiles, whatever their size.
    """
    if most_queries is not None and queries.limit(most_queries + 1).count() > most_queries:
        rule["most_numbers"] = 0
    found = cosine.compared(vectors, queries, id_column, vector, k=k, **rule)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", F.asc_nulls_last("id")))
    return found.withColumn("place", place)


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: ~is_stop_word(t))


def term_counts(docs: DataFrame, queries: DataFrame, doc_id: str, text: str = "text", most_terms: int = 100_000) -> DataFrame:
    """doc_id, dl (content tokens of the document), term, tf: of the terms that some query has, stored; and for every
    document a row with a null term, whose tf is the number of its rows. The corpus is tokenised once.

    Other terms are dropped before anything is shuffled, while there are at most `most_terms` to look for.
    """
    terms = queries.select(F.explode(content_tokens(F.col(text))).alias("term")).distinct()
    small = terms.limit(most_terms + 1).count() <= most_terms
    d = docs.select(doc_id, content_tokens(F.col(text)).alias("t")).select(doc_id, F.coalesce(F.size("t"), F.lit(0)).alias("dl"), F.coalesce("t", F.array().cast("array<string>")).alias("t"))
    each = d.select(doc_id, "dl", F.explode(F.concat("t", F.array(F.lit(None).cast("string")))).alias("term"))
    if small:
        asked = F.broadcast(terms.withColumn("asked", F.lit(True)))
        each = each.join(asked, "term", "left").filter("asked OR term IS NULL").drop("asked")
        return stored(each.groupBy(doc_id, "dl", "term").agg(F.count("*").alias("tf")), "terms")
    counts = each.groupBy(doc_id, "dl", "term").agg(F.count("*").alias("tf"))
    return stored(counts.join(terms, "term", "left_semi").unionByName(counts.filter("term IS NULL")), "terms")


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, text: str = "text", k1: float = 1.5, b: float = 0.75, tf: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score of every document that shares a term; a term asked twice counts twice.

    tf: term_counts() of the same tables, where the caller has them already.
    """
    tf = term_counts(docs, queries, doc_id, text) if tf is None else tf
    stats = tf.filter("term IS NULL").agg(F.sum("tf").alias("n"), (F.sum(F.col("tf") * F.col("dl")) / F.sum("tf")).alias("mean_dl"))
    tf = tf.filter("term IS NOT NULL")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    q = queries.select(query_id, F.explode(content_tokens(F.col(text))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("qf"))
    hit = tf.join(q, "term").join(df, "term").crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean_dl")))
    return hit.groupBy(query_id, doc_id).agg(F.sum(part).alias("score"))


class Retrieval:
    """The best documents of each query, by BM25 or by the number of terms shared. The corpus is tokenised once.

    The queries' terms, up to `most_asked`, travel with the tasks: a task scores its documents and keeps k of a query, so
    what is shuffled are the documents' counts of these terms and k rows of a query and task. More terms are joined.
    """

    def __init__(self, docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, text: str = "text", most_asked: int = MOST_ASKED):
        self.docs, self.queries, self.doc_id, self.query_id, self.text = docs, queries, doc_id, query_id, text
        asked = queries.select(query_id, F.explode(content_tokens(F.col(text))).alias("term"))
        self.asked = stored(asked.groupBy(query_id, "term").agg(F.count("*").alias("qf")), "asked")
        self.small = self.asked.limit(most_asked + 1).count() <= most_asked
        if not self.small:
            self.tf = term_counts(docs, queries, doc_id, text)
            return
        small_batches(docs.sparkSession)
        terms = pc.unique(self.asked.select("term").toArrow().column("term")).cast(pa.string())
        t = docs.select(F.col(doc_id).alias("id"), F.coalesce(content_tokens(F.col(text)), F.array().cast("array<string>")).alias("t"))
        kind = docs.schema[doc_id].dataType.simpleString()
        counts = t.mapInArrow(_term_counts(terms), f"id {kind}, dl int, terms array<string>, tfs array<long>")
        # repeated rows of a document count together
        self.rows = stored(counts.groupBy("id").agg(F.collect_list(F.struct("dl", "terms", "tfs")).alias("rows")), "terms")
        each = self.rows.select("id", F.explode("rows").alias("r"))
        stats = each.agg(F.count("*").alias("n"), F.avg("r.dl").alias("mean")).first()
        self.n, self.mean = stats.n, stats.mean or 1.0
        self.df = each.select("id", "r.dl", F.explode("r.terms").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))

    def _best(self, weights: DataFrame, k: int, part) -> DataFrame:
        weights, kind = weights.toArrow(), self.queries.schema[self.query_id].dataType
        schema = StructType([StructField(self.query_id, kind), StructField(self.doc_id, self.docs.schema[self.doc_id].dataType), StructField("score", DoubleType())])
        return self._placed(self.rows.mapInArrow(_best_of_task(weights, k, part, schema.names), schema), k)

    def _placed(self, scores: DataFrame, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(self.query_id).orderBy(F.desc(F.round("score", DIGITS)), self.doc_id))
        return scores.withColumn("place", place).filter(F.col("place") <= k)

    def bm25(self, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """query_id, doc_id, score, place of the k best (ties within 9 digits by doc_id); a term asked twice counts twice."""
        if not self.small:
            return self._placed(bm25(self.docs, self.queries, self.doc_id, self.query_id, self.text, k1, b, self.tf), k)
        idf = F.ln(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights, mean = self.asked.join(self.df, "term").select(F.col(self.query_id).alias("query"), "term", (F.col("qf") * idf).alias("w")), self.mean
        return self._best(weights, k, lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean)))

    def shared(self, k: int) -> DataFrame:
        """query_id, doc_id, score, place by the number of different terms that both have."""
        if not self.small:
            both = self.tf.join(self.asked.select(self.query_id, "term"), "term").select(self.query_id, self.doc_id, "term").distinct()
            return self._placed(both.groupBy(self.query_id, self.doc_id).agg(F.count("*").cast("double").alias("score")), k)
        return self._best(self.asked.select(F.col(self.query_id).alias("query"), "term", F.lit(1.0).alias("w")), k, None)


def _term_counts(terms: pa.Array):
    def run(batches):
        for batch in batches:
            row, words = cosine.listed(batch.column("t"))
            code = cosine.codes(words, terms)
            some = (code >= 0) & (code < len(terms))
            key, tf = np.unique(row[some] * (len(terms) + 1) + code[some], return_counts=True)
            begin = pa.array(np.searchsorted(key // (len(terms) + 1), np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(begin, v) for v in (terms.take(pa.array(key % (len(terms) + 1))), pa.array(tf.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pc.list_value_length(batch.column("t")), *lists], names=["id", "dl", "terms", "tfs"])

    return run


def _best_of_task(weights: pa.Table, k: int, part, names: list[str]):
    """Rows of Retrieval to the k best of each query among them; part(tf, dl) is a term's share, 1 a term if None."""
    queries, terms = (pc.unique(weights.column(c)) for c in ("query", "term"))
    of = cosine.codes(weights.column("term").combine_chunks(), terms)
    order = np.argsort(of, kind="stable")
    begin = np.searchsorted(of[order], np.arange(len(terms) + 1))
    to = np.array([{q: i for i, q in enumerate(queries.to_pylist())}[q] for q in weights.column("query").to_pylist()], np.int64)[order]
    weight = weights.column("w").to_numpy()[order]

    def cut(held):
        every = pa.concat_tables(held)
        every = every.take(pc.sort_indices(every, [("q", "ascending"), ("key", "ascending"), ("id", "ascending")], null_placement="at_start"))
        q = every.column("q").to_numpy()
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        worst = np.full(len(queries), np.inf)
        worst[q[nth == k - 1]] = every.column("key").to_numpy()[nth == k - 1]
        return every.filter(pa.array(nth < k)), worst

    def run(batches):
        held, n_held, worst, step = [], 0, np.full(len(queries), np.inf), max(1, SCORES // max(1, len(queries)))
        for whole in batches:
            for s in range(0, whole.num_rows if len(queries) else 0, step):
                batch = whole.slice(s, step)
                doc, rows = cosine.listed(batch.column("rows"))
                dl, words, tfs = rows.flatten()
                row, flat = cosine.listed(words)
                code, tf, dl = cosine.codes(flat, terms), cosine.listed(tfs)[1].to_numpy().astype(float), dl.to_numpy()[row]
                some = code < len(terms)
                doc, code, tf, dl = doc[row][some], code[some], tf[some], dl[some]
                if len(rows) > batch.num_rows:  # a document's repeated rows: of one length they are one, for terms any are
                    _, at, back = np.unique(np.stack([doc, code, dl if part else dl * 0]), axis=1, return_index=True, return_inverse=True)
                    tf = np.bincount(back.ravel(), tf, len(at))
                    doc, code, dl = doc[at], code[at], dl[at]
                share = part(tf, dl) if part else np.ones(len(tf))
                size = begin[code + 1] - begin[code]
                at = np.arange(size.sum()) + np.repeat(begin[code] - (np.cumsum(size) - size), size)
                score = np.bincount(np.repeat(doc, size) * len(queries) + to[at], np.repeat(share, size) * weight[at], batch.num_rows * len(queries))
                score = score.astype(float).reshape(batch.num_rows, len(queries))  # numpy counts nothing in integers
                key = -np.round(score, DIGITS)
                # the kth of a block is a bound too; what is not shared has no score
                if batch.num_rows > k:
                    worst = np.minimum(worst, np.partition(key, k - 1, axis=0)[k - 1])
                r, c = np.nonzero((score > 0) & (key <= worst))
                held.append(pa.table({"q": pa.array(c), "key": pa.array(key[r, c]), "id": batch.column("id").take(pa.array(r)), "score": pa.array(score[r, c])}))
                n_held += len(r)
                if n_held > 4 * k * len(queries) + SCORES:
                    every, least = cut(held)
                    held, n_held, worst = [every], every.num_rows, np.minimum(worst, least)
        if held:
            every = cut(held)[0].combine_chunks()
            for batch in every.select(["q", "id", "score"]).to_batches():
                yield pa.RecordBatch.from_arrays([queries.take(batch.column("q")), batch.column("id"), batch.column("score")], names=names)

    return run


def fuse(rankings: list[DataFrame], key: list[str], place: str = "place", const: int = 60) -> DataFrame:
    """key, score: the sum over rankings of 1 / (const + zero-based place)."""
    every = None
    for r in rankings:
        part = r.select(*key, (1.0 / (const + F.col(place) - 1)).alias("s"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(*key).agg(F.sum("s").alias("score"))


def best_threshold(df: DataFrame, score: str, truth: str) -> DataFrame:
    """The smallest observed threshold with the largest true-positive less false-positive rate of `score >= threshold`.

    Counts are taken per distinct value first, so the ordered pass sees distinct values only.
    """
    per = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.sum(1 - F.col(truth).cast("long")).alias("neg"))
    above = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    j = F.sum("pos").over(above) / F.sum("pos").over(every) - F.sum("neg").over(above) / F.sum("neg").over(every)
    return per.withColumn("j", F.round(j, 9)).orderBy(F.desc("j"), "threshold").limit(1).select("threshold", "j")
