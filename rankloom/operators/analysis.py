"""Analysis of questions by a model: rewriting and intents, with replies parsed, salvaged, repaired or refused."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import collapse, text_of
from rankloom.sources.calls import Ledger, Workers, ask

#: Fixed value: intents of a question at most.
MOST_INTENTS = 6
#: The fields of replies, and how one is found in a reply whose JSON is broken.
REWRITTEN, TOPIC, INTENTS = "rewritten_query", "topic_description", "intents"
FIELD = r'"{0}"\s*:\s*"((?:\\.|[^"\\])*)"'


def json_of(reply: str | None):
    """The JSON of a reply, code fences and what stands around its braces aside; None if there is none."""
    text = re.sub(r"^```(?:json)?\s*|```\s*$", "", (reply or "").strip(), flags=re.MULTILINE)
    inner = re.search(r"\{.*\}", text, re.DOTALL)
    for part in (text, inner[0] if inner else ""):
        try:
            return json.loads(part)
        except ValueError:
            continue
    return None


def read_rewrite(reply: str | None) -> tuple[str, str] | None:
    """(rewritten query, topic) of a reply, from its fields even if its JSON is broken; None if one is missing or blank."""
    data = json_of(reply)
    if data is None:
        found = [re.search(FIELD.format(name), reply or "", re.DOTALL) for name in (REWRITTEN, TOPIC)]
        if not all(found):
            return None
        try:
            data = dict(zip((REWRITTEN, TOPIC), (json.loads(f'"{m[1]}"', strict=False) for m in found), strict=True))
        except ValueError:
            return None
    if not isinstance(data, dict):
        return None
    both = tuple(str(data.get(k) or "").strip() for k in (REWRITTEN, TOPIC))
    return both if all(both) else None


def read_intents(reply: str | None) -> list[str]:
    """Intents of a reply: white space collapsed, each once whatever its case, six at most."""
    data = json_of(reply)
    found = data.get(INTENTS) if isinstance(data, dict) else None
    texts = [" ".join(str(x or "").split()) for x in found] if isinstance(found, list) else []
    first: dict[str, str] = {}
    for text in filter(None, texts):
        first.setdefault(text.lower(), text)
    return [*first.values()][:MOST_INTENTS]


def same_question(kind: str, question: str) -> str:
    """A deterministic client in place of a model: the question is its own rewriting, topic and only intent."""
    return json.dumps({"rewritten_query": question, "topic_description": question, "intents": [question]}, ensure_ascii=False)


@F.pandas_udf(T.StructType([T.StructField("rewritten", T.StringType()), T.StructField("topic", T.StringType())]))
def _rewrites(replies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_rewrite(r) or (None, None) for r in replies], columns=["rewritten", "topic"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _intents(replies: pd.Series) -> pd.Series:
    return pd.Series([read_intents(r) or None for r in replies], dtype=object)


def analyse(questions: DataFrame, client: Callable[[str, str], str] = same_question, strict: bool = False, workers: Workers = Workers(), ledger: Ledger | None = None) -> DataFrame:
    """(qid, query, rewritten, topic, intents, error) of (qid, query).

    The client is asked for ``rewrite``, for ``intents`` and, if strict, once for ``repair``.
    Lenient: what can't be had is the question itself, without a topic and as the only intent, with
    the error beside it. Strict: a question whose replies can't be read has no row, so that a later
    run asks it again. With a ledger each reply is asked for once.
    """
    rows = questions.select("qid", text_of(F.col("query")).alias("query"))
    payload = lambda kind: F.to_json(F.array(F.lit(kind), F.col("query")))
    call = lambda told: client(*json.loads(told))
    rows = ask(rows, payload("rewrite"), call, "_rewrite", "_rewrite_error", workers=workers, ledger=ledger).withColumn("_r", _rewrites("_rewrite"))
    if strict:
        rows = ask(rows, payload("repair"), call, "_repair", "_repair_error", F.col("_r.rewritten").isNull() & F.col("_rewrite_error").isNull(), workers, ledger)
        rows = rows.withColumn("_r", F.when(F.col("_r.rewritten").isNull(), _rewrites("_repair")).otherwise(F.col("_r"))).withColumn("_rewrite_error", F.coalesce("_rewrite_error", "_repair_error"))
    rows = ask(rows, payload("intents"), call, "_intents", "_intents_error", workers=workers, ledger=ledger).withColumn("_i", _intents("_intents"))
    unread = lambda kind: F.lit(f"ValueError: the reply to {kind} can't be read")
    first = F.when(F.col("_r.rewritten").isNull(), F.coalesce("_rewrite_error", unread("rewrite")))
    second = F.when(F.col("_i").isNull(), F.coalesce("_intents_error", unread("intents")))
    error = F.substring(F.concat_ws("; ", first, second), 1, 500)
    out = rows.select("qid", "query", F.coalesce("_r.rewritten", "query").alias("rewritten"), F.coalesce("_r.topic", F.lit("")).alias("topic"), F.coalesce("_i", F.array("query")).alias("intents"), F.when(error != "", error).alias("error"))
    return out.where("error is null") if strict else out


def intents_of(rows: DataFrame) -> DataFrame:
    """(qid, query) with ``intents``: sentences, white space collapsed, each once whatever its case, six at most; the question itself if there is none."""
    parts = F.filter(F.transform(F.split("query", r"[.!?]+\s+"), lambda x: F.regexp_replace(collapse(x), r"[.!?]+$", "")), lambda x: x != "")
    first = F.filter(parts, lambda x, i: F.array_position(F.transform(parts, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    limited = F.slice(first, 1, MOST_INTENTS)
    return rows.withColumn("intents", F.when(F.size(limited) > 0, limited).otherwise(F.array(collapse(F.col("query")))))
