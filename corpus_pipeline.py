"""Preparation of the documents table: toxicity, quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. Stages work on
whole texts and on every row that the stage before has kept. Null columns pass through, rows
without text count as empty texts, and empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import jaccard, packing, pii, quality, toxicity
from rankloom.llm.registry import WORD_VOCABULARY
from rankloom.llm.shared import shared_folder


def _keep(docs: DataFrame, scored: DataFrame, wanted: int) -> DataFrame:
    return scored.where(F.col(scored.columns[-1]) == wanted).select(*docs.columns)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.language_model(docs)
    words = toxicity.learn(docs, labels, quality.remainder(F.col("doc_id"), 3) != 1, model)
    return _keep(docs, toxicity.flag(docs, model, words, 0.7), 0)


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, quality.remainder(F.col("doc_id"), 5) != 0)
    return _keep(docs, quality.flag(docs, model, 0.3), 1)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that links of similarity 0.8 join, over five-word shingles, the one of least id stays."""
    return jaccard.keep_one(docs, words=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents cut into power-of-two sequences of token ids."""
    return packing.pack(docs, WORD_VOCABULARY)


STAGES = [("toxicity", toxic_out), ("quality", poor_out), ("near_copies", near_copies_out), ("personal_data", mask_personal_data), ("packing", pack)]
#: SQL can't express learned scores, Viterbi decoding or subword merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; what lies between them is written to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
