"""Snapshots of rankings between stages, and comparisons of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.fusion import round_robin
from rankloom.sources.results import result_rows, write_results

#: Digits of a threshold that one run hands to the next.
DIGITS = 4


def snapshot(questions: DataFrame, rankings: DataFrame, top_each: int, item: str = "article") -> DataFrame:
    """Result rows, without answers, of a phase's rankings (qid, intent_index, item, rank): the first ``top_each`` of each list, dealt in turn. Reading a question without any is an error."""
    first = rankings.where((F.col("rank") <= top_each) & (F.coalesce(item, F.lit("")) != ""))
    rows = result_rows(round_robin(first, item).withColumnRenamed(item, "article"), questions)
    lost = F.raise_error(F.concat(F.lit("no articles for the snapshot of question "), F.col("id").cast("string")))
    return rows.withColumn("relevant_articles", F.when(F.size("relevant_articles") > 0, F.col("relevant_articles")).otherwise(lost))


def ranked_replies(cache: DataFrame, item: str = "article") -> DataFrame:
    """Rankings of a rerank cache (qid, intent_index, ranked_articles: array of article, ..., at): of each intent the last row."""
    last = cache.groupBy("qid", "intent_index").agg(F.max_by("ranked_articles", "at").alias("ranked"))
    return last.select("qid", "intent_index", F.posexplode("ranked").alias("_at", "x")).select("qid", "intent_index", F.col("x.article").alias(item), (F.col("_at") + 1).alias("rank"))


def sizes(rows: DataFrame, phase: str) -> DataFrame:
    """One row about a snapshot: phase, questions, and the least, largest and mean number of articles."""
    n = F.size("relevant_articles")
    return rows.agg(F.lit(phase).alias("phase"), F.count("*").alias("questions"), F.coalesce(F.min(n), F.lit(0)).alias("least"), F.coalesce(F.max(n), F.lit(0)).alias("most"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean"))


def write_snapshot(rows: DataFrame, folder: str, phase: str) -> str:
    """The snapshot as results.json and its zip, with ``summary`` (``sizes``) beside them; the zip's path."""
    path = write_results(rows, folder)
    sizes(rows, phase).coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    return path


def threshold(probe: DataFrame, share: float = 0.1) -> DataFrame:
    """One row (line): the score (top1) below which that share of a run's questions lie, linear between scores, rounded as runs hand it on; 0 without questions."""
    return probe.agg(F.round(F.coalesce(F.percentile("top1", share), F.lit(0.0)), DIGITS).alias("line"))


def compared_probes(old: DataFrame, new: DataFrame, share: float = 0.1) -> DataFrame:
    """Two runs' probes (qid, top1) by the old run's threshold: qid, old_top1, new_top1, old_gap, new_gap, change (closed, opened, both or none).

    A question's gap is closed only where the new run passes the line that the old one set, so a
    lower rate of gaps means better retrieval. Questions of one run only have nulls for the other.
    """
    line = F.broadcast(threshold(old, share))  # one row
    both = old.select("qid", F.col("top1").alias("old_top1")).join(new.select("qid", F.col("top1").alias("new_top1")), "qid", "full_outer").join(line, how="cross")
    gaps = both.select("qid", "old_top1", "new_top1", (F.col("old_top1") <= F.col("line")).alias("old_gap"), (F.col("new_top1") <= F.col("line")).alias("new_gap"))
    change = F.when(F.col("old_gap") & F.col("new_gap"), "both").when(F.col("old_gap") & ~F.col("new_gap"), "closed").when(~F.col("old_gap") & F.col("new_gap"), "opened").when(F.col("old_gap").isNotNull() & F.col("new_gap").isNotNull(), "none")
    return gaps.withColumn("change", change)


def compared_runs(old: DataFrame, new: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Two runs' rankings (keys, item, rank), by key: how many items both have, how many one has alone, whether the first is the same, and the largest shift of a rank."""
    a, b = (d.select(*keys, F.col(item).alias("_item"), F.col("rank").alias(n)) for d, n in ((old, "_old"), (new, "_new")))
    both = a.join(b, [*keys, "_item"], "full_outer")
    shared = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    first = F.max(F.when(F.col("_old") == 1, F.col("_item"))).eqNullSafe(F.max(F.when(F.col("_new") == 1, F.col("_item"))))
    return both.groupBy(*keys).agg(
        F.count_if(shared).alias("in_both"), F.count_if(F.col("_new").isNull()).alias("only_old"), F.count_if(F.col("_old").isNull()).alias("only_new"),
        first.alias("same_first"), F.coalesce(F.max(F.when(shared, F.abs(F.col("_old") - F.col("_new")))), F.lit(0)).cast("long").alias("largest_shift"),
    )
