"""Fusion of rankings, unions of hits per question, and retrieval metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(rankings: list[DataFrame], k: int | None = None, keys: tuple[str, ...] = ("qid",), item: str = "doc_id", constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (keys, item, rank): keys, item, score (12 digits), rank.

    Scores of the lists don't matter, only ranks from 1. Ties go to the item seen first, in the
    order of the lists. An item that a list repeats counts each time.
    """
    lists = [r.select(*keys, item, F.col("rank").cast("long").alias("_rank"), F.lit(n).alias("_list")) for n, r in enumerate(rankings)]
    fused = reduce(DataFrame.unionByName, lists).groupBy(*keys, item).agg(F.round(F.sum(1 / (constant + F.col("_rank"))), 12).alias("score"), F.min(F.struct("_list", "_rank")).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "_first", item))
    out = fused.select(*keys, item, "score", rank.alias("rank"))
    return out if k is None else out.where(F.col("rank") <= k)


def union_by_article(hits: DataFrame, item: str = "doc_id") -> DataFrame:
    """Hits per intent (qid, intent_index, item, score, rank) as one list a question, by best rank, then best score."""
    grouped = hits.groupBy("qid", item).agg(F.min("rank").alias("min_rank"), F.max("score").alias("max_score"), F.count("*").alias("n_match"), F.sort_array(F.collect_list("intent_index")).alias("intents"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy("min_rank", F.desc("max_score"), item))
    return grouped.withColumn("position", order)


def union_by_chunk(hits: DataFrame, item: str = "doc_id") -> DataFrame:
    """As :func:`union_by_article`, but the score is that of the first intent that found the item."""
    grouped = hits.groupBy("qid", item).agg(F.min("rank").alias("min_rank"), F.min_by("score", "intent_index").alias("first_score"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy("min_rank", F.desc("first_score"), item))
    return grouped.withColumn("position", order)


def ordered_distinct(rows: DataFrame, keys: list[str], item: str, order: list[str]) -> DataFrame:
    """Each item once per key, where ``order`` first meets it, with its position from 1."""
    first = Window.partitionBy(*keys, item).orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, item)))


def tiered_union(fused: DataFrame, reranked: DataFrame, raw: DataFrame, questions: DataFrame, sizes: tuple[int, int, int] = (12, 5, 5), item: str = "doc_id") -> DataFrame:
    """Fused hits first, then each intent's reranked hits, then each intent's raw hits, each item once: qid, item, tier, position.

    ``fused`` has (qid, item, rank), the others intent_index besides; intents beyond a question's
    ``num_intents`` don't count.
    """
    of = lambda rows, tier, size: rows.where(F.col("rank") <= size).select("qid", item, F.lit(tier).alias("tier"), (F.col("intent_index") if "intent_index" in rows.columns else F.lit(-1)).alias("intent_index"), F.col("rank").cast("int").alias("rank"))
    rows = of(fused, 1, sizes[0]).unionByName(of(reranked, 2, sizes[1])).unionByName(of(raw, 3, sizes[2]))
    rows = rows.join(questions.select("qid", "num_intents"), "qid").where(F.col("intent_index") < F.col("num_intents"))
    return ordered_distinct(rows, ["qid"], item, ["tier", "intent_index", "rank"]).select("qid", item, "tier", "position")


def inferred_top(union: DataFrame, m: int, item: str = "doc_id") -> DataFrame:
    """The first m items of each intent, from a union that lists each item's ``intents``: qid, intent_index, item, rank."""
    rows = union.select("qid", item, "min_rank", "max_score", F.explode("intents").alias("intent_index"))
    rank = F.row_number().over(Window.partitionBy("qid", "intent_index").orderBy("min_rank", F.desc("max_score"), item))
    return rows.select("qid", "intent_index", item, rank.alias("rank")).where(F.col("rank") <= m)


def round_robin(hits: DataFrame, item: str = "doc_id") -> DataFrame:
    """First hits of all intents, then second ones, and so on, each item once: qid, item, position."""
    return ordered_distinct(hits, ["qid"], item, ["rank", "intent_index"]).select("qid", item, "position")


def by_reference(items: DataFrame, reference: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Items in the order of a reference list (keys, item, position); unknown ones last, by themselves."""
    joined = items.join(reference.withColumnRenamed("position", "_at"), [*keys, item], "left")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("_at"), item))
    return joined.withColumn("position", place).drop("_at")


def recall(found: Column, gold: Column) -> Column:
    """Share of the gold items that were found; null without gold."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(found, gold)) / F.size(gold))


def collect_ordered(rows: DataFrame, keys: list[str], item: str, position: str = "position", out: str = "items") -> DataFrame:
    """One array of items per key, in order."""
    listed = F.sort_array(F.collect_list(F.struct(position, item)))
    return rows.groupBy(*keys).agg(F.transform(listed, lambda x: x[item]).alias(out))
