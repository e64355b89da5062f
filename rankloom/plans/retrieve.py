"""The batch workflow: questions to hits, unions, selection by models and rules, checked answers and result rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import answers as prompts
from rankloom.operators import bm25, collective, dense, features, fusion, generate, rules, verify
from rankloom.operators.analysis import intents_of
from rankloom.plans.stages import Stage
from rankloom.sources import calls, clients
from rankloom.sources.results import result_rows


def quoted(prompt: str) -> str:
    """A deterministic answer in place of a model's: the first article of the prompt, cited."""
    found = re.search(r"^\[1\] ([^|\n]*)\|([^|\n]*)\|([^|\n]*)", prompt, re.MULTILINE)
    return f"Theo {found[3]} {found[2]} ({found[1].lstrip(chr(39))})." if found else "Không có căn cứ."


@dataclass(frozen=True)
class Models:
    """Clients of the workflow, how they are called, and the folder of their ledgers: with one, no call that succeeded is made twice, whatever fails later. Those by default are deterministic and stand in for models."""

    embed: Callable[[list[str]], list] = clients.HashEmbedder()
    select: Callable[[str], str] = verify.first_keys
    together: Callable[[str], str] = verify.first_keys
    repair: Callable[[str], str] | None = None
    answer: Callable[[str], str] = quoted
    workers: calls.Workers = calls.Workers()
    ledgers: str | None = None
    settings: str = ""

    def ledger(self, stage: str) -> calls.Ledger | None:
        return calls.Ledger(self.ledgers, stage, self.settings) if self.ledgers else None


def workflow(depth: int = 60, intent_depth: int = 10, sizes: tuple[int, int, int] = (12, 5, 5), models: Models = Models(), listed: int = 50, rescue: int = 3) -> list[Stage]:
    """Stages over ``documents`` (doc_id, text, article), ``questions`` (qid, query) and, if given, ``statuses`` (law_id, class).

    The index and the vectors are written once and read by every later stage; questions run together
    as one batch. Words and vectors each give ``listed`` hits of a question and of each of its
    intents, which are fused by reciprocal rank. Of the union a model selects in batches and rules
    drop what is out of force or wasn't asked for; a model then sees what is left together, the gate
    takes out what doesn't answer the question, intents that nothing covers any more get their best
    survivor back, and a model answers from the articles, with its citations checked.
    """
    embedder = models.embed

    def postings(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        return bm25.build(t["documents"]).postings

    def terms(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        return bm25.from_postings(t["postings"], t["documents"]).terms

    def stats(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        return bm25.from_postings(t["postings"], t["documents"]).stats

    def vectors(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        return clients.embed(t["documents"].select("doc_id", "text"), F.col("text"), embedder).select(F.col("doc_id").alias("id"), F.col("embedding").alias("v"))

    def analysis(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        return intents_of(t["questions"]).withColumn("num_intents", F.size("intents"))

    def asked_vectors(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        """A number for each text that is asked, with its vector: position -1 is the question, others are intents."""
        texts = t["analysis"].select("qid", F.posexplode(F.concat(F.array("query"), "intents")).alias("at", "text")).withColumn("position", F.col("at") - 1)
        numbered = texts.select((F.col("qid") * 100 + F.col("at")).alias("number"), "qid", "position", "text")
        return clients.embed(numbered, F.col("text"), embedder, "v").drop("text")

    index = lambda t: bm25.Index(t["postings"], t["terms"], t["stats"])

    def near(t: dict[str, DataFrame], which: Column) -> DataFrame:
        asked = t["asked_vectors"].where(which)
        found = dense.top_k(asked.select(F.col("number").alias("qid"), "v"), t["vectors"], listed)
        return found.select(F.col("qid").alias("number"), F.col("id").alias("doc_id"), "rank").join(asked.drop("v"), "number")

    def fused(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        return fusion.rrf([bm25.search(index(t), t["analysis"], listed), near(t, F.col("position") < 0)], depth)

    def hits(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        rows = t["analysis"].select("qid", F.posexplode("intents").alias("intent_index", "query"))
        keys = ("qid", "intent_index")
        return fusion.rrf([bm25.search(index(t), rows, listed, keys), near(t, F.col("position") >= 0).withColumnRenamed("position", "intent_index")], intent_depth, keys)

    def reranked(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        rows = t["analysis"].select("qid", F.posexplode("intents").alias("intent_index", "query"))
        pairs = t["hits"].select("qid", "doc_id").distinct().join(rows, "qid").join(t["documents"].select("doc_id", "text"), "doc_id")
        return features.rank_by_score(pairs.select("qid", "intent_index", "doc_id", features.mock_score(F.col("query"), F.col("text")).alias("score")), ["qid", "intent_index"], "doc_id", 50)

    def union(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        return fusion.tiered_union(t["fused"], t["reranked"], t["hits"], t["analysis"], sizes)

    def candidates(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        part = lambda k: F.get(F.split("article", r"\|"), F.lit(k))
        docs = t["documents"].select("doc_id", "article", F.lit("").alias("law_type"), T.text_of(part(1)).alias("law_name"), T.title_of(T.collapse(F.col("text"))).alias("title"), T.text_of(F.col("text")).alias("content"))
        return t["union"].select("qid", "doc_id", "position").join(docs, "doc_id").join(t["questions"].select("qid", T.text_of(F.col("query")).alias("question")), "qid")

    def chosen(rows: DataFrame, lists: DataFrame, column: str) -> DataFrame:
        """Candidates that the lists (qid, ...) of a column name, at their place in it."""
        places = lists.select("qid", F.posexplode(column).alias("_at", "article")).withColumn("position", F.col("_at") + 1).drop("_at")
        return rows.drop("position").join(places.groupBy("qid", "article").agg(F.min("position").alias("position")), ["qid", "article"])

    def selected(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        rows = t["candidates"]
        told = verify.selected(verify.ask(verify.prompts(rows), models.select, models.workers, models.ledger("select")))
        all_of = fusion.collect_ordered(rows, ["qid"], "article", out="all")
        filled = verify.with_fallback(F.col("selected"), F.col("all"), F.col("parse_failures") > 0, F.lit(True))
        return chosen(rows, all_of.join(told, "qid", "left").select("qid", filled.alias("kept")), "kept")

    def cleaned(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        rows = t["selected"]
        if "statuses" in t:
            rows = rules.never_empty(rows.join(rules.drop_invalid(rows, t["statuses"]).select("qid", "article", F.lit(True).alias("_valid")), ["qid", "article"], "left"), ["qid"], F.col("_valid")).drop("_valid")
        return rules.penalty_cleanup(rows).drop("reason")

    def together(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        lists = collective.select_together(t["cleaned"], models.together, repair=models.repair, workers=models.workers, ledger=models.ledger("together"))
        return chosen(t["cleaned"], lists, "selected")

    def gated(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        return rules.enforcement_gate(t["together"]).drop("reason")

    def final(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        """(qid, position, article, ...): what the gate has left, with intents rescued by what cleaning had left."""
        named = t["hits"].join(t["documents"].select("doc_id", "article"), "doc_id")
        by_intent = fusion.collect_ordered(named, ["qid", "intent_index"], "article", "rank", "ranking").groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("intent_index", "ranking"))), lambda x: x["ranking"]).alias("intents"))
        survivors = t["cleaned"].groupBy("qid").agg(F.collect_set("article").alias("survivors"))
        lists = fusion.collect_ordered(t["gated"], ["qid"], "article", out="final").join(by_intent, "qid").join(survivors, "qid")
        return chosen(t["cleaned"], lists.select("qid", rules.rescued(F.col("final"), F.col("intents"), F.col("survivors"), rescue).alias("all")), "all")

    def answers(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        rows = t["final"].withColumn("law_id", T.law_of(F.col("article"))).withColumn("number", F.substring_index("article", "|", -1))
        fields = F.struct("law_id", "law_type", "law_name", "number", "title", "content")
        listed_rows = rows.groupBy("qid").agg(F.max("question").alias("question"), F.sort_array(F.collect_list(F.struct("position", "article", fields.alias("a")))).alias("x"))
        jobs = listed_rows.select("qid", "question", F.transform("x", lambda e: e["article"]).alias("refs"), F.transform("x", lambda e: e["a"]).alias("articles"))
        jobs = jobs.withColumn("signature", generate.signature({"model": models.settings}, F.col("question"), F.col("refs"), F.col("articles"))).withColumn("labels", generate.labels(F.col("articles")))
        texts = prompts.render(rows.select("qid", "question", "position", F.col("article").alias("ref"), "content"))
        return generate.answer(jobs.join(texts, "qid"), models.answer, workers=models.workers, ledger=models.ledger("answer"))

    def results(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        carried = ["position"] if "position" in t["questions"].columns else []
        return result_rows(t["final"].select("qid", "article", "position"), t["questions"].select("qid", F.col("query").alias("question"), *carried), t["answers"])

    def answered(df: DataFrame, t: dict[str, DataFrame]) -> list[str]:
        lost = t["questions"].join(df.select(F.col("id").alias("qid")), "qid", "left_anti").count()
        return [f"{lost} questions are missing"] if lost else []

    def whole(df: DataFrame, t: dict[str, DataFrame]) -> list[str]:
        """Every question that has candidates keeps one."""
        lost = t["candidates"].select("qid").distinct().join(df, "qid", "left_anti").count()
        return [f"{lost} questions have lost all articles"] if lost else []

    def told(df: DataFrame, t: dict[str, DataFrame]) -> list[str]:
        failed = df.where("error is not null").count()
        return [f"{failed} questions have no answer"] if failed else []

    makers = [postings, terms, stats, vectors, analysis, asked_vectors, fused, hits, reranked, union, candidates]
    return [
        *(Stage(f.__name__, f) for f in makers), *(Stage(f.__name__, f, whole) for f in (selected, cleaned, together, gated, final)),
        Stage("answers", answers, told, 3 if models.ledgers else 1), Stage("results", results, answered),
    ]
