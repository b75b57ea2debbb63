"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by encoded length; suffix sums over the histogram answer, for every context limit, how many
documents are longer, how many tokens all documents keep when cut at the limit, and every quantile. The histogram has
one row per distinct length, whatever the number of documents.

Null and empty texts have length 0 and count as documents. Repeated rows count each. An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import binary_parts, bounded_runs, input_bytes, small_batches
from .tokens import encoder, tokenizer_path

BATCH = 4 << 20


def _lengths(path: str, cut: str, added: bool):
    def run(batches):
        for batch in batches:
            _, offsets = binary_parts(batch.column(1))
            for s, e in bounded_runs(offsets[1:] - offsets[:-1], BATCH):
                _, sizes = encoder(path, cut, added).encode_column(batch.column(1).slice(s, e - s), with_ids=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(sizes)], names=["doc_id", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, path: str | None = None, cut: str = "space", added: bool = False) -> DataFrame:
    """doc_id, n_tokens of each whole text. added: the tokenizer's added tokens in it count as one."""
    small_batches(docs.sparkSession)
    return input_bytes(docs).mapInArrow(_lengths(path or tokenizer_path("byte_bpe_50k.json"), cut, added), "doc_id long, n_tokens long")


def length_histogram(docs: DataFrame, path: str | None = None, cut: str = "space", added: bool = False) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length."""
    return token_lengths(docs, path, cut, added).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length in the histogram taken as a context limit:

    n_docs of that length, docs_over (longer), tokens_over (in those), docs_total, tokens_total, tokens_kept (sum of the
    smaller of length and limit), share_within (share of documents not longer: the limit is that quantile of lengths).
    """
    # one row per distinct length, bounded by the longest text: a single ordered task suffices
    after = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    tokens: Column = F.col("n_tokens") * F.col("n_docs")
    h = histogram.withColumn("docs_over", F.coalesce(F.sum("n_docs").over(after), F.lit(0))).withColumn("tokens_over", F.coalesce(F.sum(tokens).over(after), F.lit(0)))
    h = h.withColumn("docs_total", F.sum("n_docs").over(every)).withColumn("tokens_total", F.sum(tokens).over(every))
    h = h.withColumn("tokens_kept", F.col("tokens_total") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens"))
    return h.withColumn("share_within", F.round(1 - F.col("docs_over") / F.col("docs_total"), 9))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least that share of documents doesn't exceed (exact, nearest rank)."""
    rank = lambda share: F.greatest(F.lit(1), F.ceil(F.lit(float(share)) * F.col("docs_total"))).cast("long")
    within = F.col("docs_total") - F.col("docs_over")
    asked = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), (within >= rank(s)).alias("reached")) for s in shares))).alias("q")
    return sums.select("n_tokens", asked).filter("q.reached").groupBy("q.share").agg(F.min("n_tokens").alias("n_tokens"))


def totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_over, tokens_kept for any limits, from the suffix sums of the longest length at or below each.

    What is longer than that length is longer than the limit too; below the shortest length everything is longer.
    """
    # one row per distinct length, and one per limit
    last = [F.max_by(F.struct("n_tokens", "docs_over", "tokens_over"), F.when(F.col("n_tokens") <= x, F.col("n_tokens"))).alias(f"l{i}") for i, x in enumerate(limits)]
    row = sums.agg(F.max("docs_total").alias("docs"), F.max("tokens_total").alias("tokens"), *last)
    over = lambda i: F.coalesce(F.col(f"l{i}.docs_over"), F.col("docs"), F.lit(0))
    kept = lambda i, x: F.coalesce(F.col("tokens") - F.coalesce(F.col(f"l{i}.tokens_over"), F.col("tokens")) + over(i) * x, F.lit(0))
    return row.select(F.explode(F.array(*(F.struct(F.lit(int(x)).alias("context_limit"), over(i).cast("long").alias("docs_over"), kept(i, int(x)).cast("long").alias("tokens_kept")) for i, x in enumerate(limits)))).alias("t")).select("t.*")
