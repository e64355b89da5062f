"""Collective selection: a model sees a question's candidates together, in one round or in two, with broken replies repaired once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import text_of
from rankloom.operators.verify import collective_fallback, first_keys, parsed, prompts
from rankloom.sources.calls import Ledger, Workers, ask
from rankloom.sources.durable import durable

#: Characters of a broken reply that a repair sees, and of any reply that is kept.
SEEN, KEPT = 4000, 2000


def ask_and_repair(batches: DataFrame, client: Callable[[str], str] = first_keys, repair: Callable[[str], str] | None = None, strict: bool = False, workers: Workers = Workers(), ledger: Ledger | None = None) -> DataFrame:
    """Batches (qid, batch, payload, keys, articles): qid, batch, ``chosen`` (articles; null if no reply could be read), ``confidence``, ``reply``, ``repaired`` and ``error``.

    A reply that can't be read goes to the repair client once, with the keys that it may name.
    """
    told = ask(batches, F.col("payload"), client, workers=workers, ledger=ledger).withColumn("_p", parsed(F.col("reply"), F.col("keys"), strict))
    if repair is not None:
        broken = F.col("_p.keys").isNull() & (F.trim(text_of(F.col("reply"))) != "")
        shown = F.to_json(F.struct(F.col("keys").alias("allowed_keys"), F.substring("reply", 1, SEEN).alias("raw_response")))
        told = ask(told, shown, repair, "repaired", "_error", broken, workers, ledger).withColumn("error", F.coalesce("error", "_error"))
        told = told.withColumn("_p", F.when(F.col("repaired").isNotNull(), parsed(F.col("repaired"), F.col("keys"), strict)).otherwise(F.col("_p")))
    else:
        told = told.withColumn("repaired", F.lit(None).cast("string"))
    chosen = F.transform("_p.keys", lambda k: F.get(F.col("articles"), (F.array_position("keys", k) - 1).cast("int")))
    kept = lambda c: F.substring(text_of(F.col(c)), 1, KEPT).alias(c)
    return told.select("qid", "batch", chosen.alias("chosen"), F.coalesce("_p.confidence", F.lit("low")).alias("confidence"), kept("reply"), kept("repaired"), text_of(F.col("error")).alias("error"))


def merged(told: DataFrame) -> DataFrame:
    """Per question what its batches chose, in order, each once (null if none could be read), and whether any failed."""
    read = F.sort_array(F.collect_list(F.when(F.col("chosen").isNotNull(), F.struct("batch", "chosen"))))
    rows = told.groupBy("qid").agg(read.alias("_parts"), F.bool_or(F.col("chosen").isNull() | (F.col("error") != "")).alias("failed"))
    return rows.select("qid", F.when(F.size("_parts") > 0, F.array_distinct(F.flatten(F.transform("_parts", lambda p: p["chosen"])))).alias("chosen"), "failed")


def select_together(
    candidates: DataFrame, client: Callable[[str], str] = first_keys, batch_client: Callable[[str], str] | None = None, repair: Callable[[str], str] | None = None, least: int = 2, direct: int = 8, size: int = 6,
    preserve_first: bool = False, strict: bool = False, workers: Workers = Workers(), ledger: Ledger | None = None,
) -> DataFrame:
    """Per question of candidates (qid, position, question, law_type, law_name, article, content): qid, selected, path, failed.

    Fewer than ``least`` candidates stay as they are (path ``skipped``); up to ``direct`` go to one
    call (``direct``); more go in batches of ``size`` first, and what these choose goes to one more
    call (``rounds``), of which the batches' choice stands if it can't be read. An empty selection
    keeps the first candidate. Strict: a question of which a reply can't be read has no row.

    What the batches chose is read several times, so it is written first: models aren't asked again
    for it if an executor is lost.
    """
    rows = candidates.withColumn("_n", F.count("*").over(Window.partitionBy("qid")))
    listed = rows.groupBy("qid").agg(F.max("_n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("position", "article"))), lambda x: x["article"]).alias("all"))
    whole = 1 << 20
    asked = lambda batches, who: merged(ask_and_repair(batches, who, repair, strict, workers, ledger))
    straight = asked(prompts(rows.where((F.col("_n") >= least) & (F.col("_n") <= direct)), whole), client)
    first = durable(asked(prompts(rows.where(F.col("_n") > direct), size), batch_client or client))
    left = rows.join(first.select("qid", F.posexplode_outer("chosen").alias("_at", "article")), ["qid", "article"]).withColumn("position", F.col("_at") + 1).drop("_at", "_n")
    last = asked(prompts(left, whole), client).select("qid", F.col("chosen").alias("final"), F.col("failed").alias("failed_last"))
    two = first.join(last, "qid", "left").select("qid", F.coalesce("final", "chosen").alias("chosen"), (F.col("failed") | F.coalesce("failed_last", F.lit(True))).alias("failed"))
    told = listed.join(straight.unionByName(two), "qid", "left")
    path = F.when(F.col("n") < least, "skipped").when(F.col("n") <= direct, "direct").otherwise("rounds")
    chosen = F.when(F.col("n") < least, F.col("all")).otherwise(collective_fallback(F.col("chosen"), F.col("all"), preserve_first))
    out = told.select("qid", chosen.alias("selected"), path.alias("path"), F.coalesce("failed", F.lit(False)).alias("failed"))
    return out.where("not failed") if strict else out
