"""What queries share: tables, and pieces of SQL that oracles begin with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import collapse
from rankloom.operators import bm25, dense, fusion
from rankloom.operators.analysis import MOST_INTENTS, intents_of
from rankloom.sources.durable import durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def intent_rows(rows: DataFrame) -> DataFrame:
    return intents_of(rows).select("qid", F.posexplode("intents").alias("intent_index", "query"))


def index_of(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """An index of the words of all questions."""
    return bm25.build(table(spark, sf_dir, "documents"), only=bm25.words_of(questions(spark, sf_dir)))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def dense_hits(spark: SparkSession, sf_dir: str, asked: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank) of ``asked`` (qid, vec_id): a stored vector stands in for the model's embedding of a text; texts without one find nothing."""
    rows = vectors(spark, sf_dir)
    q = asked.join(rows.withColumnRenamed("id", "vec_id"), "vec_id").select("qid", "v")
    return dense.top_k(q, rows, k).select("qid", F.col("id").alias("doc_id"), "score", "rank")


def hybrid_by_intent(index: bm25.Index, dense_rows: DataFrame, asked: DataFrame, depth: int, k: int) -> DataFrame:
    """BM25 and dense hits of each intent (qid, intent_index, query), fused by reciprocal rank: qid, intent_index, doc_id, score, rank."""
    keys = ("qid", "intent_index")
    return fusion.rrf([bm25.search(index, asked, depth, keys), dense_rows], k, keys)


#: Intent i of question q has the stored vector q + i in place of an embedding; its topic has that of number q + 1.
def intent_hits(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The best k documents of each intent, by BM25 and vectors: qid, intent_index, doc_id, score, rank. Written, as queries use it several times."""
    asked = intent_rows(questions(spark, sf_dir))
    found = dense_hits(spark, sf_dir, asked.select((F.col("qid") * 10 + F.col("intent_index")).alias("qid"), (F.col("qid") + F.col("intent_index")).alias("vec_id")), 50)
    by_intent = found.select(F.floor(F.col("qid") / 10).cast("long").alias("qid"), (F.col("qid") % 10).cast("int").alias("intent_index"), "doc_id", "score", "rank")
    return durable(hybrid_by_intent(index_of(spark, sf_dir), by_intent, asked, 50, k))


def lexical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 50 documents of each question by its words. Written."""
    return durable(bm25.search(index_of(spark, sf_dir), questions(spark, sf_dir), 50))


def question_hits(spark: SparkSession, sf_dir: str, k: int = 60, lexical: DataFrame | None = None) -> DataFrame:
    """The best k documents of each question, by its words (``lexical_hits``), its vector, and its topic's vector where the topic (the first sentence) differs. Written."""
    asked = intents_of(questions(spark, sf_dir))
    topics = asked.where(F.element_at("intents", 1) != collapse(F.col("query"))).select("qid", (F.col("qid") + 1).alias("vec_id"))
    lists = [lexical or lexical_hits(spark, sf_dir), dense_hits(spark, sf_dir, asked.select("qid", F.col("qid").alias("vec_id")), 50), dense_hits(spark, sf_dir, topics, 50)]
    return durable(fusion.rrf(lists, k))


def both_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``question_hits`` and ``intent_hits`` by one search of all their words and one of all their vectors. A question counts as intent -1, its topic's vector as that of intent -2."""
    rows = intents_of(questions(spark, sf_dir))
    asked = intent_rows(questions(spark, sf_dir))
    keys, whole, topic = ("qid", "intent_index"), F.col("intent_index") == -1, F.col("intent_index") == -2
    lexical = durable(bm25.search(index_of(spark, sf_dir), asked.unionByName(rows.select("qid", F.lit(-1).alias("intent_index"), "query")), 50, keys))
    topics = rows.where(F.element_at("intents", 1) != collapse(F.col("query"))).select("qid", F.lit(-2).alias("intent_index"), (F.col("qid") + 1).alias("vec_id"))
    by_vector = asked.select(*keys, (F.col("qid") + F.col("intent_index")).alias("vec_id")).unionByName(rows.select("qid", F.lit(-1).alias("intent_index"), F.col("qid").alias("vec_id"))).unionByName(topics)
    found = dense_hits(spark, sf_dir, by_vector.select((F.col("qid") * 10 + F.col("intent_index") + 2).alias("qid"), "vec_id"), 50)
    near = durable(found.select(F.floor((F.col("qid")) / 10).cast("long").alias("qid"), (F.pmod(F.col("qid"), F.lit(10)) - 2).cast("int").alias("intent_index"), "doc_id", "score", "rank"))
    wide = fusion.rrf([lexical.where(whole), near.where(whole), near.where(topic)], 60)
    return durable(wide), durable(fusion.rrf([lexical.where(~whole), near.where(F.col("intent_index") >= 0)], 10, keys))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intents_of(questions(spark, sf_dir)).select("qid", "query", F.size("intents").alias("num_intents"))


TOKENS = r"list_filter(regexp_split_to_array(lower(nfc_normalize(coalesce({0}, ''))), '[^\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 1)"
#: Words of four letters or more, as the clients that stand in for models see them.
LONG_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{4,}}')"
COLLAPSE = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"

INDEX_SQL = f"""
words AS (SELECT doc_id, {TOKENS.format("text")} AS w FROM documents),
postings AS (SELECT doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM words) GROUP BY doc_id, dl, term),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""

INTENTS_SQL = rf"""
sentences AS (SELECT item_id AS qid, text AS query, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\s+'), lambda x: regexp_replace({COLLAPSE.format("x")}, '[.!?]+$', '')), lambda x: x <> '') AS parts FROM benchmark),
limited AS (SELECT qid, query, list_slice(list_filter(parts, lambda x, i: list_position(list_transform(parts, lambda y: lower(y)), lower(x)) = i), 1, {MOST_INTENTS}) AS kept FROM sentences),
intents AS (SELECT qid, query, CASE WHEN len(kept) > 0 THEN kept ELSE [{COLLAPSE.format("query")}] END AS intents FROM limited),
intent_rows AS (SELECT qid, unnest(range(len(intents))) AS intent_index, unnest(intents) AS query FROM intents)"""


def search_sql(name: str, source: str, keys: str, k: int) -> str:
    """CTEs that end in ``name``: the best k documents of each row of ``source`` (keys, query)."""
    of = ", ".join(f"q.{c.strip()}" for c in keys.split(","))
    return rf"""
{name}_w AS (SELECT {keys}, term, count(*) AS times, min(pos) AS pos FROM (SELECT {keys}, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT {keys}, {TOKENS.format("query")} AS w FROM {source})) GROUP BY {keys}, term),
{name}_s AS (SELECT {of}, p.doc_id, round(sum(q.times * ln((s.n - t.df + 0.5) / (t.df + 0.5) + 1) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl))), 9) AS score, min(q.pos) AS pos FROM {name}_w q JOIN postings p USING (term) JOIN terms t USING (term) CROSS JOIN stats s GROUP BY {of}, p.doc_id),
{name} AS (SELECT {keys}, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, pos, doc_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


def questions_sql(name: str, k: int) -> str:
    return search_sql(name, "(SELECT item_id AS qid, text AS query FROM benchmark)", "qid", k)


VECTORS_SQL = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


def dense_sql(name: str, source: str, keys: str, k: int) -> str:
    """CTEs that end in ``name``: the k nearest vectors of each row of ``source`` (keys, vec_id)."""
    of = ", ".join(f"q.{c.strip()}" for c in keys.split(","))
    return f"""
{name}_s AS (SELECT {of}, x.vec_id AS doc_id, round(list_cosine_similarity(o.e, x.e), 6) + 0.0 AS score FROM {source} q JOIN v o USING (vec_id) CROSS JOIN v x),
{name} AS (SELECT {keys}, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, doc_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


def fuse_sql(name: str, lists: list[str], keys: str, k: int) -> str:
    """CTEs that end in ``name``: reciprocal rank fusion of the lists."""
    rows = " UNION ALL ".join(f"SELECT {keys}, doc_id, rank, {n} AS list FROM {x}" for n, x in enumerate(lists))
    return f"""
{name}_s AS (SELECT {keys}, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(list * 1000 + rank) AS first FROM ({rows}) GROUP BY {keys}, doc_id),
{name} AS (SELECT {keys}, doc_id, score, rank FROM (SELECT {keys}, doc_id, score, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, first, doc_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


#: ``hits``: of each intent; ``wide``: of each question. Both need INDEX_SQL before them.
HITS_SQL = f"{INTENTS_SQL}, {VECTORS_SQL}, {search_sql('hits_l', 'intent_rows', 'qid, intent_index', 50)}, {dense_sql('hits_d', '(SELECT qid, intent_index, qid + intent_index AS vec_id FROM intent_rows)', 'qid, intent_index', 50)}, {fuse_sql('hits', ['hits_l', 'hits_d'], 'qid, intent_index', 10)}"
GLOBAL_SQL = f"{questions_sql('wide_l', 50)}, {dense_sql('wide_d', '(SELECT item_id AS qid, item_id AS vec_id FROM benchmark)', 'qid', 50)}, {dense_sql('wide_t', '(SELECT qid, qid + 1 AS vec_id FROM intents WHERE intents[1] <> ' + COLLAPSE.format('query') + ')', 'qid', 50)}, {fuse_sql('wide', ['wide_l', 'wide_d', 'wide_t'], 'qid', 60)}"
