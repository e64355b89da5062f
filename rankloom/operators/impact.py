"""Lexical retrieval from impact-ordered blocks, of which a query reads those that can matter.

A posting's gain is what it adds to the score of a query that has its word once. Gains of a word fall
into levels, and a level into blocks of bounded size with their largest gain. For a query,

1. its best blocks give k documents, whose partial scores are a bound that the k best reach at least;
2. words are taken by their largest gains, and a level of a word is read only if its largest gain
   reaches that bound with the most that words still to come add, and the most that skipped levels
   of words before add: a document that is in no level read can't be among the k best;
3. of the documents met, those that could still reach the bound with what skipped blocks hold at
   most get their missing gains, by a join on word and document.

So a frequent word is read once for a few documents instead of once for each query that has it, and
the result is that of ``bm25.search``, to the last digit that it keeps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.operators import bm25
from rankloom.sources.durable import durable

#: Levels of a word's gains, and postings of a block at most, about.
LEVELS, BLOCK = 16, 4096
#: Scores are compared as rounded ones are: what is nearer counts as equal.
NEAR = 1e-8


@dataclass
class Blocks:
    """heads(term, level, part, n, top) and bodies(term, level, part, doc_id, gain); top is the largest gain of a block."""

    heads: DataFrame
    bodies: DataFrame

    def save(self, path: str) -> None:
        """Bodies are sorted by word and level within files, so a reader skips the row groups of others."""
        self.bodies.sortWithinPartitions("term", "level", "part").write.mode("overwrite").parquet(f"{path}/bodies")
        self.heads.write.mode("overwrite").parquet(f"{path}/heads")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Blocks:
        return Blocks(spark.read.parquet(f"{path}/heads"), spark.read.parquet(f"{path}/bodies"))


def blocks(index: bm25.Index, levels: int = LEVELS, size: int = BLOCK) -> Blocks:
    """The blocks of an index. A level of many postings is dealt into parts by a hash of the document, so no word, however frequent, makes a large block or task."""
    tf = F.col("tf")
    saturation = tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * F.col("dl") / F.col("avgdl")))
    level = F.least(F.floor(saturation / (bm25.K1 + 1) * levels), F.lit(levels - 1)).cast("int")
    rows = index.postings.join(F.broadcast(index.stats), how="cross").withColumn("_s", saturation)  # one row
    rows = rows.join(index.terms.select("term", "idf"), "term").select("term", level.alias("level"), "doc_id", (F.col("idf") * F.col("_s")).alias("gain"))
    sizes = rows.groupBy("term", "level").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    bodies = rows.join(sizes, ["term", "level"]).select("term", "level", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), "doc_id", "gain")
    heads = bodies.groupBy("term", "level", "part").agg(F.count("*").alias("n"), F.max("gain").alias("top"))
    return Blocks(heads, bodies)


@dataclass
class Found:
    """hits as of ``bm25.search``; reads (keys, blocks, read): how many blocks a query's words have, and how many of them it read in full."""

    hits: DataFrame
    reads: DataFrame


def search(index: Blocks, queries: DataFrame, k: int, key_cols: tuple[str, ...] = ("qid",), text_col: str = "query") -> Found:
    """The best k documents of each query: key columns, doc_id, score (9 digits), rank; ties as in ``bm25.search``.

    Null and empty queries, and those of unknown words, find nothing. What is worked out for the
    batch is written between steps, so nothing of it is worked out twice.
    """
    keys = list(key_cols)
    words = queries.select(*keys, F.posexplode(tokens(F.col(text_col))).alias("pos", "term")).groupBy(*keys, "term").agg(F.count("*").alias("times"), F.min("pos").alias("pos"))
    of_query, of_word = Window.partitionBy(*keys), Window.partitionBy(*keys, "term")
    listed = words.join(index.heads, "term").withColumn("bound", F.col("times") * F.col("top"))
    before = F.coalesce(F.sum("n").over(of_word.orderBy(F.desc("bound"), "level", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = durable(listed.withColumn("seed", before < k))

    block = ["term", "level", "part"]
    seeds = listed.where("seed").select(*keys, *block, "times").join(index.bodies, block).groupBy(*keys, "doc_id").agg(F.sum(F.col("times") * F.col("gain")).alias("partial"))
    needed = _thresholds(listed, _kth(seeds, keys, k), keys)
    judged = durable(listed.withColumn("level_top", F.max("bound").over(Window.partitionBy(*keys, "term", "level"))).join(needed, [*keys, "term"]).withColumn("read", F.col("level_top") >= F.col("needed") - NEAR).drop("level_top", "needed"))
    met = judged.where("read").select(*keys, *block, "times", "pos").join(index.bodies, block).groupBy(*keys, "doc_id").agg(F.sum(F.col("times") * F.col("gain")).alias("partial"), F.min("pos").alias("first"))
    met = durable(met)
    # What skipped blocks hold of a word at most.
    skipped = judged.where("not read").groupBy(*keys, "term", "times", "pos").agg(F.max("bound").alias("rest"))
    rest = skipped.groupBy(*keys).agg(F.sum("rest").alias("rest"))
    able = met.join(rest, keys, "left").join(_kth(met, keys, k), keys, "left").where(F.col("partial") + F.coalesce("rest", F.lit(0.0)) >= F.coalesce("least", F.lit(float("-inf"))) - NEAR)
    able = durable(able.select(*keys, "doc_id", "partial", "first"))
    wanted = able.select(*keys, "doc_id").join(skipped.select(*keys, "term", "times", "pos"), keys)
    unread = judged.where("not read").select(*block).distinct()
    more = index.bodies.join(unread, block, "left_semi").select("term", "doc_id", "gain", "level", "part").join(wanted, ["term", "doc_id"])
    more = more.join(judged.where("not read").select(*keys, *block), [*keys, *block], "left_semi")
    whole = able.unionByName(more.groupBy(*keys, "doc_id").agg(F.sum(F.col("times") * F.col("gain")).alias("partial"), F.min("pos").alias("first")))
    scored = whole.groupBy(*keys, "doc_id").agg(F.round(F.sum("partial"), 9).alias("score"), F.min("first").alias("first"))
    rank = F.row_number().over(of_query.orderBy(F.desc("score"), "first", "doc_id"))
    hits = scored.select(*keys, "doc_id", "score", rank.alias("rank")).where(F.col("rank") <= k)
    return Found(hits, judged.groupBy(*keys).agg(F.count("*").alias("blocks"), F.count_if("read").alias("read")))


def _thresholds(listed: DataFrame, least: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, needed): what a level's largest gain must reach to be read."""
    by_level = listed.groupBy(*keys, "term", "level").agg(F.max("bound").alias("top"))
    by_word = by_level.groupBy(*keys, "term").agg(F.max("top").alias("top"), F.collect_list("top").alias("levels"))
    by_query = by_word.groupBy(*keys).agg(F.sum("top").alias("all"), F.sort_array(F.collect_list(F.struct("top", "term", "levels")), asc=False).alias("words")).join(least, keys, "left")
    none = F.array().cast("array<struct<term:string,needed:double>>")

    def step(state, word):
        later = state["later"] - word["top"]
        needed = F.coalesce("least", F.lit(float("-inf"))) - later - state["skipped"]
        unread = F.coalesce(F.array_max(F.filter(word["levels"], lambda x: x < needed - NEAR)), F.lit(0.0))
        return F.struct(later.alias("later"), (state["skipped"] + unread).alias("skipped"), F.array_append(state["out"], F.struct(word["term"].alias("term"), needed.alias("needed"))).alias("out"))

    found = F.aggregate("words", F.struct(F.col("all").alias("later"), F.lit(0.0).alias("skipped"), none.alias("out")), step)["out"]
    return by_query.select(*keys, F.inline(found))


def _kth(partial: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, least): the k-th largest partial score of each query; queries of fewer documents are left out."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("partial")))
    return partial.select(*keys, "partial", nth.alias("_n")).where(F.col("_n") == k).select(*keys, F.col("partial").alias("least"))
