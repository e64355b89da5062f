"""Checks of what stages leave, and of corpus, index and vectors against one another, as tables of problems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stage_problems(rows: DataFrame, expected: DataFrame, required: list[str] = (), articles: DataFrame | None = None, listed: str = "relevant_articles") -> DataFrame:
    """(id, problem) of a stage's rows (id, ...): ids that are expected (id) and missing, extra ones, repeated ones, required fields that are null or empty, and listed references that ``articles`` (article) doesn't know. A sound stage has none."""
    told = lambda d, what: d.select(F.col("id").cast("string").alias("id"), F.lit(what).alias("problem") if isinstance(what, str) else what.alias("problem"))
    out = [
        told(expected.select("id").distinct().join(rows, "id", "left_anti"), "is missing"), told(rows.select("id").distinct().join(expected, "id", "left_anti"), "wasn't expected"),
        told(rows.groupBy("id").count().where("count > 1"), "is repeated"),
    ]
    if required:
        empty = F.array(*(F.when(F.coalesce(F.to_json(F.struct(F.col(c).alias("x"))), F.lit("{}")).isin("{}", '{"x":""}', '{"x":[]}'), F.concat(F.lit("has no "), F.lit(c))) for c in required))
        out.append(rows.select(F.col("id").cast("string").alias("id"), F.explode(F.filter(empty, lambda x: x.isNotNull())).alias("problem")))
    if articles is not None:
        named = rows.select("id", F.explode(listed).alias("article")).join(articles.select("article").distinct(), "article", "left_anti").distinct()
        out.append(told(named, F.concat(F.lit("names the unknown "), F.col("article"))))
    return reduce(DataFrame.unionByName, out)


def consistency(documents: DataFrame, postings: DataFrame, vectors: DataFrame, backend: str | None = None, model: str | None = None) -> DataFrame:
    """(problem, n): what keeps a corpus (doc_id, text, hash), its index (doc_id) and its vectors (id, hash, backend, model) from belonging together; n is 0 where all is well.

    Documents without words have no postings, so only ids that the corpus doesn't know count there.
    """
    ids = documents.select(F.col("doc_id").cast("string").alias("id"), "hash")
    n = lambda d, what: d.agg(F.lit(what).alias("problem"), F.count("*").alias("n"))
    stored = vectors.select(F.col("id").cast("string").alias("id"), "hash", "backend", "model")
    other = F.lit(False)
    for column, wanted in (("backend", backend), ("model", model)):
        other = other | (~F.col(column).eqNullSafe(F.lit(wanted)) if wanted is not None else F.lit(False))
    times = F.count("*").over(Window.partitionBy("id"))
    return reduce(
        DataFrame.unionByName,
        [
            n(ids.withColumn("_n", times).where("_n > 1 or id is null"), "documents share an id or have none"), n(postings.select(F.col("doc_id").cast("string").alias("id")).distinct().join(ids, "id", "left_anti"), "indexed documents are unknown"),
            n(ids.join(stored, "id", "left_anti"), "documents have no vector"), n(stored.join(ids, "id", "left_anti"), "vectors are of unknown documents"),
            n(ids.join(stored.withColumnRenamed("hash", "_hash"), "id").where("not hash <=> _hash"), "vectors are of another text"), n(stored.where(other), "vectors are of another model"),
        ],
    )


def looked_up(refs: DataFrame, table: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Refs with what ``table`` has for their key, each key once. One that it hasn't stays, with nulls; if strict, reading it is an error."""
    rest = [c for c in table.columns if c != key]
    known = table.dropDuplicates([key]).withColumn("_known", F.lit(True))
    out = refs.join(known, key, "left")
    if strict:
        lost = F.raise_error(F.concat(F.lit(f"{key} isn't known: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        out = out.withColumn(key, F.when(F.col("_known"), F.col(key)).otherwise(lost))
    return out.select(*refs.columns, *rest)
