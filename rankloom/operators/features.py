"""Scores of candidates over intents, and ranked selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mock_score(query: Column, text: Column) -> Column:
    """A deterministic score in 0..1 in place of a model: the first six hex digits of a SHA-1."""
    return F.conv(F.substring(F.sha1(F.concat(F.substring(query, 1, 40), F.lit("||"), F.substring(text, 1, 120))), 1, 6), 16, 10).cast("double") / 16777215


def rank_by_score(scored: DataFrame, keys: list[str], item: str, k: int | None = None) -> DataFrame:
    """Items by score, missing scores last, ties by item: adds ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("score"), item))
    out = scored.withColumn("rank", rank)
    return out if k is None else out.where(F.col("rank") <= k)


def bucket(rank: Column) -> Column:
    """The weight of a place in the fused list."""
    return F.when(rank <= 10, 1.0).when(rank <= 30, 0.7).when(rank <= 60, 0.4).otherwise(0.0)


def aggregate(reranked: DataFrame, fused: DataFrame, hits: DataFrame, questions: DataFrame, top: int, item: str = "doc_id") -> DataFrame:
    """One score an item over the first ``top`` of each intent's reranked list (qid, intent_index, item, score, rank).

    Best rank counts fully, the place in the fused list and the share of intents a quarter each,
    and being among the intents' hits 0.15.
    """
    best = reranked.where(F.col("rank") <= top).groupBy("qid", item).agg(F.min("rank").alias("best_rank"), F.greatest(F.max("score"), F.lit(0.0)).alias("best_score"), F.count_distinct("intent_index").alias("n_match"))
    joined = best.join(fused.select("qid", item, F.col("rank").alias("rrf_rank")), ["qid", item], "left").join(hits.select("qid", item).distinct().withColumn("_hit", F.lit(True)), ["qid", item], "left").join(questions.select("qid", "num_intents"), "qid")
    share = F.least(F.lit(1.0), F.col("n_match") / F.greatest(F.col("num_intents"), F.lit(1)))
    score = 1 / F.col("best_rank") + 0.25 * bucket(F.col("rrf_rank")) + 0.25 * share + 0.15 * F.coalesce("_hit", F.lit(False)).cast("int")
    return joined.select("qid", item, F.round(score, 9).alias("score"), "best_rank", F.round("best_score", 9).alias("best_score"), "n_match", "rrf_rank", F.coalesce("_hit", F.lit(False)).alias("in_hits"), "num_intents")


def adaptive_cap(num_intents: Column) -> Column:
    return F.least(F.lit(20), F.greatest(F.lit(10), 5 * num_intents))


def select(scored: DataFrame, pins: DataFrame | None = None, cap: Column | None = None, item: str = "doc_id") -> DataFrame:
    """Pinned items first, in their order (qid, item, pin), then by score; ``selected`` up to the cap, with ``output_rank``."""
    rows = scored.join(pins, ["qid", item], "left") if pins is not None else scored.withColumn("pin", F.lit(None).cast("int"))
    order = Window.partitionBy("qid").orderBy(F.asc_nulls_last("pin"), F.desc("score"), F.coalesce("best_rank", F.lit(1_000_000_000)), F.desc("best_score"), item)
    rows = rows.withColumn("output_rank", F.row_number().over(order))
    return rows.withColumn("selected", F.col("output_rank") <= (adaptive_cap(F.col("num_intents")) if cap is None else cap))


def sweep(scored: DataFrame, variants: DataFrame, item: str = "doc_id") -> DataFrame:
    """The selection under each variant (variant, top_each, cap): a small table of settings that rows are joined with."""
    rows = scored.join(F.broadcast(variants), how="cross").where(F.col("best_rank") <= F.col("top_each"))
    order = Window.partitionBy("variant", "qid").orderBy(F.desc("score"), "best_rank", F.desc("best_score"), item)
    return rows.withColumn("output_rank", F.row_number().over(order)).where(F.col("output_rank") <= F.col("cap"))
