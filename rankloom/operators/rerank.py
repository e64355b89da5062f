"""Reranking by models: the texts they see, the scores they give, and pools with their ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import collapse, text_of

#: How much of an article's content each kind of model sees.
LONG, SHORT, BLOCK = 1800, 1000, 400


def long_text(law_type: Column, law_name: Column, number: Column, title: Column, content: Column) -> Column:
    """Type and name, number and title, and content, a line each; white space collapses in each."""
    return F.concat_ws("\n", collapse(F.concat_ws(" ", law_type, law_name)), F.concat(collapse(number), F.lit(". "), collapse(title)), F.substring(collapse(content), 1, LONG))


def short_text(title: Column, content: Column) -> Column:
    return F.concat(text_of(title), F.lit(" "), F.substring(text_of(content), 1, SHORT))


def blocks(pool: DataFrame) -> DataFrame:
    """One prompt a question from (qid, question, position, law_name, number, title, content): numbered blocks from 0, in order."""
    part = F.concat_ws("\n", F.concat(F.lit("Văn bản: "), text_of(F.col("law_name"))), F.concat(F.lit("Điều: "), text_of(F.col("number")), F.lit(" — "), text_of(F.col("title"))), F.substring(text_of(F.col("content")), 1, BLOCK))
    listed = pool.groupBy("qid").agg(F.max("question").alias("question"), F.sort_array(F.collect_list(F.struct("position", part.alias("part")))).alias("parts"))
    numbered = F.transform("parts", lambda x, k: F.concat(F.lit("["), k.cast("string"), F.lit("] "), x["part"]))
    return listed.select("qid", F.concat(F.lit("Câu hỏi: "), "question", F.lit("\n\nDanh sách điều luật cần chấm điểm:\n"), F.array_join(numbered, "\n")).alias("prompt"), F.size("parts").alias("n"))


def reply_scores(reply: Column) -> Column:
    """(index, score) of the first list of a model's reply, code fences and prose aside; items that can't be read are skipped, of repeated indexes the last counts; null if nothing is left."""
    listed = F.from_json(F.regexp_extract(text_of(reply), r"(?s)\[.*\]", 0), "array<struct<index:string,score:string>>")
    read = F.filter(F.transform(listed, lambda x: F.struct(x["index"].try_cast("int").alias("index"), x["score"].try_cast("double").alias("score"))), lambda x: x["index"].isNotNull() & x["score"].isNotNull())
    last = F.filter(read, lambda x, k: ~F.exists(F.slice(read, k + 2, F.size(read)), lambda y: y["index"] == x["index"]))
    return F.when(F.size(read) > 0, last)


def scored_by_reply(pool: DataFrame, replies: DataFrame) -> DataFrame:
    """Pool rows (qid, position from 0) with ``score``: the reply's for that index, 0 where it has none; without a readable reply the order of the pool stands."""
    rows = pool.join(replies.select("qid", reply_scores(F.col("reply")).alias("_scores")), "qid", "left").withColumn("_n", F.count("*").over(Window.partitionBy("qid")))
    told = F.get(F.filter("_scores", lambda x: x["index"] == F.col("position")), F.lit(0))["score"]
    return rows.withColumn("score", F.when(F.col("_scores").isNull(), (F.col("_n") - F.col("position")).cast("double")).otherwise(F.coalesce(told, F.lit(0.0)))).drop("_scores", "_n")


def full_pool(scored: DataFrame, keys: list[str], item: str, top: int) -> DataFrame:
    """All scored rows with ``rank_in_pool`` (missing scores last, ties by item) and ``in_final``, the first ``top``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("score"), item))
    return scored.withColumn("rank_in_pool", rank).withColumn("in_final", F.col("rank_in_pool") <= top)
