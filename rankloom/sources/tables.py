"""Readers of corpora, questions and status tables, and checks of keys and id sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("chunk_id", "law_id", "law_type", "law_name", "dieu_number", "dieu_title", "content")),
        T.StructField("khoan_list", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())]))),
        T.StructField("relevant_doc_str", T.StringType()),
        T.StructField("relevant_article_str", T.StringType()),
    ]
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a JSON corpus, an object with ``articles`` or a bare list."""
    whole = T.StructType([*ARTICLE.fields, T.StructField("articles", T.ArrayType(ARTICLE))])
    rows = spark.read.schema(whole).json(path, multiLine=True)
    nested = rows.where("articles is not null").select(F.explode("articles").alias("a")).select("a.*")
    return nested.unionByName(rows.where("articles is null and chunk_id is not null").select(*ARTICLE.names))


def read_questions(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(id, question) of a JSON list; raises for repeated ids, empty questions or another number than expected."""
    rows = spark.read.schema("id string, question string").json(path, multiLine=True)
    facts = rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.trim(F.coalesce("question", F.lit(""))) == "").alias("empty")).first()
    if facts["n"] != facts["ids"] or facts["empty"] or expected not in (None, facts["n"]):
        raise ValueError(f"questions: {facts['n']} rows, {facts['ids']} ids, {facts['empty']} empty, {expected} expected")
    return rows


def in_order(questions: DataFrame) -> DataFrame:
    """Questions with ``position``, their place in the file that they were read from (one file, which one task reads from its beginning)."""
    return questions.withColumn("position", F.monotonically_increasing_id())


def read_question(spark: SparkSession, path: str) -> DataFrame:
    """(id, question) of a JSON object, or of a list of exactly one; raises for anything else and for an empty question."""
    return read_questions(spark, path, 1)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return status_of(spark.read.csv(path, header=True))


def status_of(rows: DataFrame) -> DataFrame:
    """(law_id, class): ids without a leading apostrophe; blank classes are unknown; rows without id go."""
    law = F.trim(F.regexp_replace("law_id", "^'+", ""))
    kind = F.trim(F.coalesce("effective_class_as_of", F.lit("")))
    return rows.select(law.alias("law_id"), F.when(kind == "", "unknown").otherwise(kind).alias("class")).where("law_id <> ''")


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``; reading them raises if a key repeats."""
    repeats = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if repeats:
        raise ValueError(f"repeated key {repeats[0].asDict()}")
    return rows


def same_ids(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """For each named pair of tables (id): ids of one side only, and repeats on either side."""
    out = []
    for name, (left, right) in pairs.items():
        counts = left.groupBy("id").agg(F.count("*").alias("a")).join(right.groupBy("id").agg(F.count("*").alias("b")), "id", "full_outer")
        out.append(counts.agg(F.lit(name).alias("pair"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if((F.coalesce("a", F.lit(0)) > 1) | (F.coalesce("b", F.lit(0)) > 1)).alias("repeated")))
    return reduce(DataFrame.unionByName, out)


def spread(rows: DataFrame, small: int = 256 << 20) -> DataFrame:
    """``rows`` dealt to all cores if they are a small input by the plan's estimate of its bytes, in fewer files than cores; larger inputs stay where they are.

    A small file is often one row group, which one task reads and works on alone. Large inputs have
    row groups enough, and would only be shuffled for nothing. The estimate goes by the share of
    columns that are read, so that an input whose texts are nearly all of it counts as a smaller one.
    """
    size, cores = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if size < small and len(rows.inputFiles()) < cores else rows
