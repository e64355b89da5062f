"""Tables that stages leave for one another, lookups of articles in them, and what a corpus is written as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import collapse, doc_of, text_of, upper_first

#: Fixed value: the rank of what has none.
LAST = 10**9


def filled(*choices: Column) -> Column:
    """The first choice that isn't null, empty, false or zero."""
    return F.coalesce(*(F.when(~c.cast("string").isin("", "0", "0.0", "false"), c) for c in choices))


def intent_hits(rows: DataFrame) -> DataFrame:
    """(id, article, doc, intent_rank, score) from artifact rows (id, intent_hits, intent_hits_union: arrays of article, doc, intent_rank, best_intent_rank, intent_rrf_score, best_intent_rrf_score).

    An empty list falls back to the union's, a missing or zero rank or score to the best one's, and
    then to the last rank or zero. References have their white space collapsed; empty ones are left out.
    """
    listed = F.when(F.size("intent_hits") > 0, F.col("intent_hits")).otherwise(F.col("intent_hits_union"))
    hits = rows.select("id", F.inline(listed)).where(text_of(F.col("article")) != "")
    article = collapse(F.col("article"))
    return hits.select(
        "id", article.alias("article"), F.coalesce(filled(collapse(F.col("doc"))), doc_of(article)).alias("doc"),
        F.coalesce(filled(F.col("intent_rank"), F.col("best_intent_rank")), F.lit(LAST)).cast("long").alias("intent_rank"), F.coalesce(filled(F.col("intent_rrf_score"), F.col("best_intent_rrf_score")), F.lit(0.0)).alias("score"),
    )


def ranked_hits(rows: DataFrame) -> DataFrame:
    """(id, intent_index, article, rank, score, position) from (id, intent_index, ranked_articles: array of article, rank, rrf_score), in order again by rank, score and article."""
    hits = rows.select("id", "intent_index", F.inline("ranked_articles")).where(text_of(F.col("article")) != "")
    hits = hits.select("id", "intent_index", collapse(F.col("article")).alias("article"), F.coalesce("rank", F.lit(LAST)).cast("long").alias("rank"), F.coalesce("rrf_score", F.lit(0.0)).alias("score"))
    return hits.withColumn("position", F.row_number().over(Window.partitionBy("id", "intent_index").orderBy("rank", F.desc("score"), "article")))


def by_reference(hits: DataFrame, articles: DataFrame, order: str) -> DataFrame:
    """Hits (ref) with the article (ref, ...) of the same reference, white space aside; of repeated references the last by ``order`` counts. Unknown ones are left out."""
    last = Window.partitionBy("_key").orderBy(F.desc(order))
    known = articles.withColumn("_key", collapse(F.col("ref"))).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "ref")
    return hits.withColumn("_key", collapse(F.col("ref"))).join(known, "_key").drop("_key")


def titles(tiers: dict[int, DataFrame]) -> DataFrame:
    """(code, title): the title of each code, case aside, from tables (code, title, position); a lower tier number is preferred, then the last row."""
    rows = None
    for tier, table in tiers.items():
        part = table.select(F.lower(F.trim("code")).alias("code"), collapse(F.col("title")).alias("title"), F.lit(tier).alias("tier"), "position")
        rows = part if rows is None else rows.unionByName(part)
    first = Window.partitionBy("code").orderBy("tier", F.desc("position"))
    return rows.where((text_of(F.col("code")) != "") & (F.col("title") != "")).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("code", "title")


def named(rows: DataFrame, official: DataFrame) -> DataFrame:
    """Rows (code, name) whose name is the official title where there is one, white space collapsed, the first letter in upper case."""
    known = official.select(F.col("code").alias("_code"), F.col("title").alias("_title"))
    return rows.join(known, F.lower(F.trim("code")) == F.col("_code"), "left").withColumn("name", upper_first(collapse(F.coalesce("_title", "name")))).drop("_code", "_title")


def hydrated(refs: DataFrame, articles: DataFrame, most: int = 1800) -> tuple[DataFrame, DataFrame]:
    """Candidates of refs (qid, position, article) with their texts, and the refs that no article is known for."""
    cut = articles.select("article", *(collapse(F.col(c)).alias(c) for c in ("law_type", "law_name", "number", "title")), F.substring(collapse(F.col("content")), 1, most).alias("content"))
    return refs.join(cut, "article"), refs.join(articles.select("article"), "article", "left_anti")


def points(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Vectors of the wanted ids (id); a semi-join, so nothing of the store passes through the driver."""
    return store.join(wanted.select("id").distinct(), "id", "left_semi")


def checked_store(store: DataFrame, dim: int) -> DataFrame:
    """The vector table, whose reading fails where an id repeats or a vector has another length; nothing is read before."""
    n = F.count("*").over(Window.partitionBy("id"))
    right = (F.size("v") == dim) & (n == 1)
    return store.withColumn("v", F.when(right, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("bad vector: "), F.col("id").cast("string")))))


def write_corpus(articles: DataFrame, path: str) -> None:
    """The corpus as one JSON object a line: every executor writes its part."""
    articles.write.mode("overwrite").json(path)


def report(counts: dict[str, DataFrame], most: int = 1000) -> str:
    """A provenance report in markdown from tables of counts, a section each; a section of more than ``most`` rows says how many more there are."""
    out = []
    for title, table in counts.items():
        rows = table.limit(most).collect()
        more = table.count() - len(rows) if len(rows) == most else 0
        out += [f"## {title}", "", "| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns), *("| " + " | ".join(str(v) for v in r) + " |" for r in rows), *([f"and {more} more"] if more else []), ""]
    return "\n".join(out)
