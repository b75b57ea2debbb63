"""One query per operator, over whole tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontam import LEAKS_SQL
from .divergence import DIVERGENCE_SQL
from .filter_audit import AUDIT_SQL
from .topk import TOP_K_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import length_histogram, with_suffix_sums

    return with_suffix_sums(length_histogram(table(spark, sf_dir, "documents"), added=True))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores, train_quality

    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores, train_toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import new_folder, read_tokens, write_tokens

    folder = new_folder(spark)
    write_tokens(table(spark, sf_dir, "documents"), folder, cut="space", end_id=2, added=True)
    return read_tokens(spark, folder, with_ids=False).drop("ids")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from .shared import shared_dir
    from .warc import read_pages, write_pages

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=10)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shortest=1)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), limit=4096, end_id=1, added=True)


def op11_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .harmonic import harmonic_packing

    return harmonic_packing(table(spark, sf_dir, "documents"), limit=2048, end_id=1, added=True)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_suffix_dedup, op3_quality, op4_toxicity, op5_ngram_join, op6_token_output, op7_warc, op8_top_k, op9_decontamination, op10_packing, op11_harmonic_packing, op12_divergence, op13_filter_audit)}
ORACLE_SQL: dict[str, str] = {"op8_top_k": TOP_K_SQL, "op9_decontamination": LEAKS_SQL, "op12_divergence": DIVERGENCE_SQL, "op13_filter_audit": AUDIT_SQL}
