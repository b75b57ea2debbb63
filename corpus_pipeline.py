"""Training-data pipeline over the documents table: one operator per stage, each stage stored before the next reads it.

1. quality: documents that the trained classifier rejects (score below 0.3) go.
2. near_duplicates: of each group linked by word five-grams of Jaccard similarity 0.8 or more, the smallest doc_id stays.
3. repeated_passages: bytes of 200-byte strings that occur more than once in what is left go; a document left without
   any text goes.
4. decontamination: documents that hold a benchmark passage, also one with some words replaced, go.
5. packing: the whole texts' token ids are packed into sequences of 4096.

A run deletes what its stages stored, but for the last one's result.

Stages 1 to 4 return the columns of documents; n_chars follows the text. Null texts count as empty: the classifier
scores them like any text, and an empty text is linked with nothing. Rows with a null doc_id go at stage 2, which
names groups by it; taken alone, stages 1 and 3 to 5 treat them like others. Repeated rows stay repeated. Tables without rows pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenote.llm import decontam, ngram_join, packing, quality, suffix_dedup
from lumenote.llm.shared import keep_only, stored, stored_count

#: Ids up to this number travel with tasks.
MOST_SENT = 1 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train_quality(docs, _table(spark, sf_dir, "labels"))
    return quality.kept(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = ngram_join.ngram_join(docs, words=5, percent=80)
    gone = stored(classes.filter("doc_id != component_id").select("doc_id").distinct(), "gone")
    # few ids travel with the texts' tasks; with more of them texts are shuffled, but not sorted, as the hashed side has ids only
    gone = F.broadcast(gone) if gone.count() <= MOST_SENT else gone.hint("shuffle_hash")
    return docs.filter("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").select(docs.columns)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffix_dedup.texts_left(docs, min_len=200).filter("n_removed < n_bytes OR n_bytes = 0")
    columns = {c: F.col("text") if c == "text" else F.col("row")[c] for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return left.select(*(v.alias(k) for k, v in columns.items()))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"), shortest=1)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, limit=4096, added=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer are not expressible in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    before = stored_count()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        keep_only(docs, before)
    return docs
