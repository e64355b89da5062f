"""Generation: signatures, answers with one repair of their citations, the cache, and parts of answers."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import text_of
from rankloom.operators.citations import fault
from rankloom.sources.calls import Ledger, Workers, ask

#: The articles that a canned answer names, how much of the first it quotes, and its texts.
NAMED, QUOTED = 4, 300
NOTHING = "Không tìm thấy điều luật liên quan đến câu hỏi của bạn."
OUTSIDE = "Mình chỉ hỗ trợ các câu hỏi liên quan đến pháp luật Việt Nam. Bạn có thể hỏi về quyền, nghĩa vụ, thủ tục, điều kiện, mức xử phạt, thời hạn hoặc căn cứ pháp lý trong một tình huống cụ thể."
#: The fields of an article, in the order of ``articles`` arrays here.
FIELDS = "array<struct<law_id:string,law_type:string,law_name:string,number:string,title:string,content:string>>"


def canned_answer(articles: Column, closing: str) -> Column:
    """A deterministic answer in place of a model's: the first article quoted, up to three more named."""
    first = F.get(articles, F.lit(0))
    of = lambda a: F.concat(text_of(a["number"]), F.lit(", "), text_of(a["law_type"]), F.lit(" "), text_of(a["law_name"]))
    lead = F.concat(F.lit("Căn cứ "), of(first), F.lit(", "), F.when(text_of(first["title"]) == "", "quy định như sau").otherwise(F.lower(first["title"])), F.lit(":\n"), F.trim(F.substring(text_of(first["content"]), 1, QUOTED)))
    others = F.filter(F.slice(articles, 2, NAMED - 1), lambda a: text_of(a["number"]) != "")
    more = F.transform(others, lambda a: F.concat(F.lit("\nNgoài ra, theo "), of(a), F.lit(": "), text_of(a["title"]), F.lit(".")))
    none = F.coalesce(F.size(articles), F.lit(0)) <= 0
    return F.when(none, F.lit(f"{NOTHING}\n\n{closing}")).otherwise(F.concat(lead, F.lit("\n"), F.array_join(more, ""), F.lit(f"\n\n{closing}")))


def signature(settings: dict, question: Column, refs: Column, articles: Column) -> Column:
    """A digest of all that an answer depends on: settings, question, references and the articles' texts, in a fixed order."""
    fixed = json.dumps(settings, sort_keys=True, ensure_ascii=False)
    return F.sha2(F.to_json(F.struct(F.lit(fixed).alias("settings"), text_of(question).alias("question"), refs.alias("refs"), articles.alias("articles")), {"ignoreNullFields": "false"}), 256)


def labels(articles: Column) -> Column:
    """How each article may be cited, as number, name and law in parentheses; those without a number or law are left out."""
    known = F.filter(articles, lambda a: text_of(a["number"]).rlike(r"(?iu)\bĐiều\s+\d") & (F.trim(text_of(a["law_id"])) != ""))
    return F.transform(known, lambda a: F.concat_ws(" ", F.trim(a["number"]), F.when(F.trim(text_of(a["law_name"])) != "", F.trim(a["law_name"])), F.concat(F.lit("("), F.trim(a["law_id"]), F.lit(")"))))


def answer(jobs: DataFrame, client: Callable[[str], str], strict: bool = False, workers: Workers = Workers(), ledger: Ledger | None = None) -> DataFrame:
    """Answers to jobs (qid, signature, question, prompt, articles as ``FIELDS``, labels): qid, signature, answer, repaired, error.

    The client gets the prompt. An answer that must be made again is repaired once, with the same
    evidence, the draft, the fault and the citations that are allowed; an empty repair is an
    error. A question that fails has a null answer and its error; with ``strict`` it has no row,
    so that a later run asks it again. With a ledger, drafts and repairs are asked once and kept.
    """
    drafts = ask(jobs, F.col("prompt"), client, "_draft", "_failed", workers=workers, ledger=ledger)
    checked = drafts.withColumn("_draft", F.when(F.col("_failed").isNull(), F.trim(text_of(F.col("_draft"))))).withColumn("_fault", F.when(F.col("_failed").isNull(), fault(F.col("_draft"), F.col("articles"))))
    repair = F.to_json(F.struct("prompt", F.col("_draft").alias("draft"), F.col("_fault").alias("fault"), F.col("labels").alias("allowed_citations")))
    told = ask(checked, repair, client, "_again", "_failed_again", F.col("_fault").isNotNull(), workers, ledger)
    again = F.trim(text_of(F.col("_again")))
    error = F.coalesce("_failed", "_failed_again", F.when(F.col("_fault").isNotNull() & (again == ""), "ValueError: the repair is empty"))
    text = F.when(error.isNull(), F.when(F.col("_fault").isNotNull(), again).otherwise(F.col("_draft")))
    out = told.select("qid", "signature", text.alias("answer"), (error.isNull() & F.col("_fault").isNotNull()).alias("repaired"), error.alias("error"))
    return out.where("error is null") if strict else out


def cached(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached answers (qid, signature, answer, repaired) that stand for a job: made from the same things, not empty, and repaired or without a fault."""
    both = jobs.select("qid", "signature", "articles").join(cache, ["qid", "signature"]).where(F.trim(text_of(F.col("answer"))) != "")
    return both.where(F.coalesce("repaired", F.lit(False)) | fault(F.col("answer"), F.col("articles")).isNull()).select("qid", "signature", "answer", "repaired")


def parts(answer: Column) -> Column:
    """(conclusion, analysis, has_conclusion) of an answer: the section headed as its conclusion, and the rest."""
    text = F.regexp_replace(F.trim(text_of(answer)), r"\r\n?", "\n")
    found = F.regexp_extract(text, r"(?isu)(?:^|\n)\s*\*{0,2}Kết luận\*{0,2}\s*\n+(.*?)(?=\n\s*\*{0,2}(?:Căn cứ|Phân tích|Cách áp dụng|Lưu ý)\b|\z)", 1)
    conclusion = F.regexp_replace(found, r"^[ \n*-]+|[ \n*-]+$", "")
    at = F.instr(text, conclusion)
    rest = F.trim(F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(conclusion), F.length(text))))
    return F.struct(conclusion.alias("conclusion"), F.when(conclusion == "", text).otherwise(rest).alias("analysis"), (conclusion != "").alias("has_conclusion"))


def without_search(rows: DataFrame, client: Callable[[str], str], workers: Workers = Workers(), ledger: Ledger | None = None) -> DataFrame:
    """Answers to questions (qid, question, route) that need no search, with empty references: small talk by the client, a fixed text for what is out of scope. A call that fails is an error of the query."""
    asked = rows.where(F.col("route").isin("small_talk", "out_of_scope")).select("qid", "question", "route")
    told = ask(asked, F.trim("question"), client, "_reply", "_error", F.col("route") == "small_talk", workers, ledger)
    text = F.when(F.col("route") == "out_of_scope", OUTSIDE).when(F.col("_error").isNotNull(), F.raise_error(F.col("_error"))).otherwise(F.trim(text_of(F.col("_reply"))))
    none = F.array().cast("array<string>")
    return told.select("qid", "question", "route", text.alias("answer"), none.alias("relevant_docs"), none.alias("relevant_articles"))


def cards(answers: DataFrame, refs: DataFrame, articles: DataFrame, preview: int = 280) -> DataFrame:
    """Answers (qid, answer) with ``cards`` for display from refs (qid, position, article) and articles (article, law_name, number, title, content), in order, and ``warnings`` on those that aren't known."""
    joined = refs.join(articles, "article", "left")
    card = F.struct("position", "article", F.col("law_name").isNotNull().alias("known"), "law_name", "number", "title", F.substring(text_of(F.col("content")), 1, preview).alias("preview"))
    listed = joined.groupBy("qid").agg(F.sort_array(F.collect_list(card)).alias("all"))
    lost = F.transform(F.filter("all", lambda c: ~c["known"]), lambda c: F.concat(F.lit("unknown article "), c["article"]))
    return answers.join(listed, "qid", "left").select("qid", "answer", F.filter("all", lambda c: c["known"]).alias("cards"), lost.alias("warnings"))
