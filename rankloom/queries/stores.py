"""Queries over stores that grow: an index in segments, vectors in versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import cells
from rankloom.operators.segments import GrowingIndex
from rankloom.sources.durable import shared_folder
from rankloom.sources.vectors import VectorStore

from .common import TOKENS, table, vectors
from .retrieval import ORACLES as RETRIEVAL


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def growing_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of an index after three updates: documents are added in thirds, some get other texts, and some are taken out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(" ", "lang", "source").alias("short"))
    third = lambda k: docs.where(F.col("doc_id") % 3 == k).select("doc_id", "text")
    index = GrowingIndex(spark, _folder(spark, "index"))
    index.update(third(0))
    index.update(third(1).unionByName(docs.where("doc_id % 6 = 0").select("doc_id", F.col("short").alias("text"))))
    index.update(third(2), docs.where("doc_id % 10 = 5").select("doc_id"))
    return index.load().terms.select("term", "df", F.round("idf", 9).alias("idf"))


def growing_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that count, with their lengths and segments, after an update that replaces a fifth and takes out another one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("short"))
    index = GrowingIndex(spark, _folder(spark, "index"))
    index.update(docs.select("doc_id", "text"))
    index.update(docs.where("doc_id % 5 = 0").select("doc_id", F.col("short").alias("text")), docs.where("doc_id % 5 < 2").select("doc_id"))
    return index.documents()


def vector_store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors after an update that gives some ids another vector, leaves those of the same hash alone, and takes some out."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    told = lambda d, how, v: d.select("id", v.alias("v"), F.concat(F.lit(how), F.col("vec_id") % 4).alias("hash"), F.lit("b").alias("backend"), F.lit("m").alias("model"))
    store = VectorStore(spark, _folder(spark, "vectors")).create(64, buckets=16)
    store.upsert(told(rows.where("vec_id % 3 < 2"), "a", F.col("v")))
    other = F.transform("v", lambda x: -x)
    again = told(rows.where("vec_id % 2 = 0"), "a", other).unionByName(told(rows.where("vec_id % 2 = 1 and vec_id % 3 = 1"), "n", other))
    store.upsert(again)
    store.remove(rows.where("vec_id % 7 = 3").select("id"))
    return store.read().select("id", "hash", F.round(F.get("v", F.lit(0)), 6).alias("first"))


def cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each hundredth vector, from the 26 nearest of 32 cells; the vectors are spread evenly, so near ones lie in many cells."""
    rows = vectors(spark, sf_dir)
    index = cells.build(rows, _folder(spark, "cells"), 32)
    return cells.search(index, rows.where("id % 100 = 0").select(F.col("id").alias("qid"), "v"), 10, 26).hits


def cells_exhausted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from all cells, which is exact."""
    rows = vectors(spark, sf_dir)
    index = cells.build(rows, _folder(spark, "cells"), 32)
    return cells.search(index, rows.where("id % 100 = 0").select(F.col("id").alias("qid"), "v"), 10, 32).hits


QUERIES = {f.__name__: f for f in (growing_index_terms, growing_index_documents, vector_store_rows, cells_topk, cells_exhausted)}
ORACLES = {
    "cells_exhausted": RETRIEVAL["dense_topk_cosine"],
    "growing_index_terms": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN concat_ws(' ', lang, source) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 5 OR doc_id % 3 = 2),
w AS (SELECT doc_id, {TOKENS.format("text")} AS w FROM d), t AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY term)
SELECT term, df, round(ln(((SELECT count(*) FROM d) - df + 0.5) / (df + 0.5) + 1), 9) AS idf FROM t""",
    "growing_index_documents": f"SELECT doc_id, len({TOKENS.format('CASE WHEN doc_id % 5 = 0 THEN source ELSE text END')})::BIGINT AS dl, (doc_id % 5 = 0)::INTEGER AS segment FROM documents WHERE doc_id % 5 <> 1",
    "vector_store_rows": """SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 2 = 1 AND vec_id % 3 = 1 THEN 'n' ELSE 'a' END || vec_id % 4 AS hash, round(CASE WHEN vec_id % 3 < 2 AND NOT (vec_id % 2 = 1 AND vec_id % 3 = 1) THEN embedding[1]::DOUBLE ELSE -embedding[1]::DOUBLE END, 6) AS first
FROM embeddings WHERE (vec_id % 3 < 2 OR vec_id % 2 = 0) AND vec_id % 7 <> 3""",
}
