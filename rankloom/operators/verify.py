"""Selection by a model or by rules: replies are parsed, fallbacks fill gaps, confidences merge."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.sources import calls

CONFIDENCES = ("high", "medium", "low")
#: The fields of a reply, the one that counts as well unless strict, and how keys are found in a broken reply: in so many characters behind a field's name.
KEYS, OTHER_KEYS = "selected_article_keys", "selected_article_ids"
NAMED, KEY, REACH = re.compile(r"selected_article_(?:keys|ids)"), re.compile(r"\bA\d+\b"), 300


def _object(reply: str) -> dict | None:
    """The first JSON object of a reply, code fences aside."""
    text = re.sub(r"^\s*```(?:json)?|```\s*$", "", reply or "", flags=re.M)
    at = text.find("{")
    while at >= 0:
        try:
            found, _ = json.JSONDecoder().raw_decode(text[at:])
            return found if isinstance(found, dict) else None
        except ValueError:
            at = text.find("{", at + 1)
    return None


def parse_selection(reply: str, known: list[str], strict: bool = False) -> tuple[list[str] | None, str]:
    """(selected keys, confidence) of a reply; None if it can't be read or names an unknown key.

    Unless strict, a second field name counts too, and keys are salvaged from a broken reply.
    """
    data = _object(reply)
    chosen = None
    if data is not None:
        chosen = data.get(KEYS)
        if chosen is None and not strict:
            chosen = data.get(OTHER_KEYS)
    if chosen is None and data is None and not strict:
        m = NAMED.search(reply or "")
        if m:
            chosen = KEY.findall(reply[m.end() : m.end() + REACH])
    if not isinstance(chosen, list):
        return None, "low"
    keys = list(dict.fromkeys(str(k).strip() for k in chosen))
    if any(k not in known for k in keys):
        return None, "low"
    said = str((data or {}).get("confidence", "")).lower()
    return keys, said if said in CONFIDENCES else "low"


SELECTION = T.StructType([T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("confidence", T.StringType())])


def parsed(replies: Column, known: Column, strict: bool = False) -> Column:
    """(keys, confidence) of replies, each with the keys that it may name."""

    def read(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = [parse_selection(r, list(k), strict) for r, k in zip(texts, keys, strict=True)]
        return pd.DataFrame({"keys": [k for k, _ in rows], "confidence": [c for _, c in rows]})

    return F.pandas_udf(read, SELECTION)(F.coalesce(replies, F.lit("")), known)


def aliased(candidates: DataFrame, size: int = 6) -> DataFrame:
    """Candidates (qid, position) with their batch from 0 and their key A1..An in it."""
    at = F.row_number().over(Window.partitionBy("qid").orderBy("position")) - 1
    return candidates.withColumn("batch", F.floor(at / size).cast("int")).withColumn("key", F.concat(F.lit("A"), (at % size + 1).cast("string")))


def prompts(candidates: DataFrame, size: int = 6, most: int = 1800) -> DataFrame:
    """One row per batch: qid, batch, payload (JSON of the question and the compact candidates), keys and articles in order."""
    rows = aliased(candidates, size)
    item = F.struct("position", "key", F.concat_ws(" ", "law_type", "law_name").alias("source"), F.col("article").alias("article"), F.substring("content", 1, most).alias("content"))
    listed = rows.groupBy("qid", "batch").agg(F.max("question").alias("question"), F.sort_array(F.collect_list(item)).alias("items"))
    shape = F.transform("items", lambda x: F.struct(x["key"].alias("key"), x["source"].alias("source"), x["article"].alias("article"), x["content"].alias("content")))
    return listed.select("qid", "batch", F.to_json(F.struct("question", shape.alias("candidate_articles"))).alias("payload"), F.transform("items", lambda x: x["key"]).alias("keys"), F.transform("items", lambda x: x["article"]).alias("articles"))


def first_keys(payload: str) -> str:
    """A deterministic reply in place of a model: candidates that share a word with the question."""
    data = json.loads(payload)
    words = set(re.findall(r"\w{4,}", data["question"].lower()))
    keys = [c["key"] for c in data["candidate_articles"] if words & set(re.findall(r"\w{4,}", (c["content"] or "").lower()))]
    return json.dumps({"selected_article_keys": keys, "confidence": "high" if keys else "low"})


def ask(batches: DataFrame, client: Callable[[str], str] = first_keys, workers: calls.Workers = calls.Workers(), ledger: calls.Ledger | None = None) -> DataFrame:
    """A reply for each payload; the client is any picklable function. A call that fails gives a null reply and its error."""
    return calls.ask(batches, F.col("payload"), client, workers=workers, ledger=ledger)


def selected(answered: DataFrame, strict: bool = False) -> DataFrame:
    """qid, selected (articles in order; null if no batch could be read), parse_failures, confidence.

    Strict: replies are read by the letter, and a question with a batch that can't be read has no
    row, so that a later run asks it again.
    """
    told = answered.withColumn("_p", parsed(F.col("reply"), F.col("keys"), strict))
    chosen = F.filter(F.transform("_p.keys", lambda k: F.get(F.col("articles"), (F.array_position("keys", k) - 1).cast("int"))), lambda a: a.isNotNull())
    rows = told.select("qid", "batch", chosen.alias("chosen"), F.col("_p.keys").isNull().alias("failed"), F.col("_p.confidence").alias("confidence"))
    grouped = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.when(~F.col("failed"), F.struct("batch", "chosen")))).alias("parts"), F.sum(F.col("failed").cast("int")).alias("parse_failures"), merged_confidence(F.col("confidence"), F.col("failed")).alias("confidence"))
    out = grouped.select("qid", F.when(F.size("parts") > 0, F.array_distinct(F.flatten(F.transform("parts", lambda p: p["chosen"])))).alias("selected"), "parse_failures", "confidence")
    return out.where("parse_failures = 0") if strict else out


def merged_confidence(confidence: Column, failed: Column) -> Column:
    """An aggregate: low if any failed, if none, or if all are low; medium if any isn't high; else high."""
    return F.when(F.coalesce(F.bool_or(failed), F.lit(True)), "low").when(F.bool_and(confidence == "low"), "low").when(F.bool_or(confidence.isin("medium", "low")), "medium").otherwise("high")


def with_fallback(chosen: Column, candidates: Column, technical: Column, single: Column) -> Column:
    """The selection, filled up: unreadable, the first five candidates; empty, three; technical trouble, it and five; a single one, it and the first."""
    first = lambda n: F.slice(candidates, 1, n)
    plus = lambda n: F.array_distinct(F.concat(chosen, first(n)))
    return F.when(chosen.isNull(), first(5)).when(F.size(chosen) == 0, first(3)).when(technical, plus(5)).when(single & (F.size(chosen) == 1), plus(1)).otherwise(chosen)


def collective_fallback(chosen: Column, candidates: Column, preserve_first: bool = False) -> Column:
    """The selection in the candidates' order; the first candidate if it is empty, or always if wanted."""
    base = F.when(chosen.isNull() | (F.size(chosen) == 0), F.slice(candidates, 1, 1)).otherwise(chosen)
    wanted = F.array_union(base, F.slice(candidates, 1, 1)) if preserve_first else base
    return F.filter(candidates, lambda c: F.array_contains(wanted, c))
