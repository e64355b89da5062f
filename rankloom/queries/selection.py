"""Queries of ranking and selection: pools, reranks, features, unions and ordered sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import features, fusion, rules

from .common import GLOBAL_SQL, HITS_SQL, INDEX_SQL, both_hits, counted, intent_hits, intent_rows, questions, table


def _pool(fused: DataFrame, hits: DataFrame) -> DataFrame:
    rows = fused.select("qid", "doc_id", F.lit(1).alias("source"), "rank").unionByName(hits.select("qid", "doc_id", F.lit(2).alias("source"), "rank"))
    return fusion.ordered_distinct(rows, ["qid"], "doc_id", ["source", "rank"]).select("qid", "doc_id", "source", "position")


def keep_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the question's list, then those of its intents, each once."""
    return _pool(*both_hits(spark, sf_dir))


def _reranked(spark: SparkSession, sf_dir: str, k: int, fused: DataFrame, hits: DataFrame) -> DataFrame:
    """Each intent's pool by the score that stands in for a model."""
    pairs = _pool(fused, hits).select("qid", "doc_id").join(intent_rows(questions(spark, sf_dir)), "qid").join(table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 120).alias("text")), "doc_id")
    scored = pairs.select("qid", "intent_index", "doc_id", F.round(features.mock_score(F.col("query"), F.col("text")), 9).alias("score"))
    return features.rank_by_score(scored, ["qid", "intent_index"], "doc_id", k)


def mock_rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir, 10, *both_hits(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str, fused: DataFrame, hits: DataFrame) -> DataFrame:
    return features.aggregate(_reranked(spark, sf_dir, 50, fused, hits), fused, hits, counted(spark, sf_dir), 10)


def feature_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, *both_hits(spark, sf_dir)).drop("num_intents")


def select_with_pins_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best hits of the question are pinned where they were scored."""
    fused, hits = both_hits(spark, sf_dir)
    pins = fused.where("rank <= 2").select("qid", "doc_id", F.col("rank").alias("pin"))
    return features.select(_scored(spark, sf_dir, fused, hits), pins).select("qid", "doc_id", "score", "output_rank", "selected")


def sweep_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = spark.createDataFrame([(f"top{t}_cap{c}", t, c) for t in (3, 5, 10) for c in (5, 10)], "variant string, top_each int, cap int")
    return features.sweep(_scored(spark, sf_dir, *both_hits(spark, sf_dir)), variants).groupBy("variant", "qid").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


def tiered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused, hits = both_hits(spark, sf_dir)
    return fusion.tiered_union(fused, _reranked(spark, sf_dir, 5, fused, hits), hits, counted(spark, sf_dir))


def inferred_intent_topm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.inferred_top(fusion.union_by_article(intent_hits(spark, sf_dir)), 5)


def round_robin_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.round_robin(intent_hits(spark, sf_dir))


def coverage_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each question, with intents that none of them covers rescued."""
    wide, hits = both_hits(spark, sf_dir)
    final = fusion.collect_ordered(wide.where("rank <= 5"), ["qid"], "doc_id", "rank", "final")
    lists = fusion.collect_ordered(hits, ["qid", "intent_index"], "doc_id", "rank", "ranking").groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("intent_index", "ranking"))), lambda x: x["ranking"]).alias("intents"))
    survivors = hits.where("doc_id % 3 <> 0").groupBy("qid").agg(F.collect_set("doc_id").alias("survivors"))
    joined = final.join(lists, "qid").join(survivors, "qid", "left").withColumn("survivors", F.coalesce("survivors", F.array().cast("array<bigint>")))
    return joined.select("qid", F.posexplode(rules.rescued(F.col("final"), F.col("intents"), F.col("survivors"), 2)).alias("position", "doc_id"))


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each customer's orders in the order in which they were first bought."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"), "l_orderkey")
    return fusion.ordered_distinct(rows.select("o_custkey", "l_partkey", "o_orderdate", "l_orderkey", "l_linenumber"), ["o_custkey"], "l_partkey", ["o_orderdate", "l_orderkey", "l_linenumber"]).select("o_custkey", "l_partkey", "position")


def array_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order's returned and other lines: how many both, either and only the first have."""
    flag = F.col("l_returnflag") == "R"
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(flag, F.col("l_suppkey"))).alias("a"), F.collect_set(F.when(~flag, F.col("l_suppkey"))).alias("b"))
    return sets.select("l_orderkey", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_union("a", "b")).alias("either"), F.size(F.array_except("a", "b")).alias("only_first"), F.arrays_overlap("a", "b").alias("overlap"))


def order_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's intent hits in the order of its own list; those it lacks last."""
    wide, hits = both_hits(spark, sf_dir)
    items = hits.select("qid", "doc_id").distinct()
    return fusion.by_reference(items, wide.select("qid", "doc_id", F.col("rank").alias("position")), ["qid"], "doc_id")


QUERIES = {f.__name__: f for f in (keep_pool, mock_rerank_topk, feature_aggregate, select_with_pins_cap, sweep_caps, tiered_union, inferred_intent_topm, round_robin_union, coverage_rescue, ordered_distinct, array_set_ops, order_by_reference)}

_BOTH = f"WITH {INDEX_SQL}, {HITS_SQL}, {GLOBAL_SQL}"
_POOL = """pool_r AS (SELECT qid, doc_id, 1 AS source, rank FROM wide UNION ALL SELECT qid, doc_id, 2, rank FROM hits),
pool_1 AS (SELECT qid, doc_id, min(source * 1000 + rank) AS o FROM pool_r GROUP BY qid, doc_id),
pool AS (SELECT qid, doc_id, (o // 1000)::INTEGER AS source, row_number() OVER (PARTITION BY qid ORDER BY o, doc_id) AS position FROM pool_1)"""
_RERANKED = """rr AS (SELECT p.qid, i.intent_index, p.doc_id, round(('0x' || substr(sha1(substr(i.query, 1, 40) || '||' || substr(d.text, 1, 120)), 1, 6))::BIGINT / 16777215.0::DOUBLE, 9) AS score FROM pool p JOIN intent_rows i USING (qid) JOIN documents d USING (doc_id)),
reranked AS (SELECT *, row_number() OVER (PARTITION BY qid, intent_index ORDER BY score DESC, doc_id) AS rank FROM rr)"""
_SCORED = """best AS (SELECT qid, doc_id, min(rank) AS best_rank, greatest(max(score), 0.0) AS best_score, count(DISTINCT intent_index) AS n_match FROM reranked WHERE rank <= 10 GROUP BY qid, doc_id),
scored AS (SELECT b.qid, b.doc_id, round(1.0::DOUBLE / best_rank + 0.25 * CASE WHEN l.rank <= 10 THEN 1.0 WHEN l.rank <= 30 THEN 0.7 WHEN l.rank <= 60 THEN 0.4 ELSE 0.0 END::DOUBLE + 0.25 * least(1.0, n_match::DOUBLE / greatest(len(i.intents), 1)) + 0.15 * (h.qid IS NOT NULL)::INTEGER, 9) AS score, best_rank, round(best_score, 9) AS best_score, n_match, l.rank AS rrf_rank, h.qid IS NOT NULL AS in_hits, len(i.intents) AS num_intents FROM best b LEFT JOIN wide l USING (qid, doc_id) LEFT JOIN (SELECT DISTINCT qid, doc_id FROM hits) h USING (qid, doc_id) JOIN intents i ON i.qid = b.qid)"""
_TO_SCORED = f"{_BOTH}, {_POOL}, {_RERANKED}, {_SCORED}"
ORACLES = {
    "keep_pool": f"{_BOTH}, {_POOL} SELECT * FROM pool",
    "mock_rerank_topk": f"{_BOTH}, {_POOL}, {_RERANKED} SELECT * FROM reranked WHERE rank <= 10",
    "feature_aggregate": f"{_TO_SCORED} SELECT qid, doc_id, score, best_rank, best_score, n_match, rrf_rank, in_hits FROM scored",
    "select_with_pins_cap": f"{_TO_SCORED}, o AS (SELECT s.*, row_number() OVER (PARTITION BY s.qid ORDER BY l.rank NULLS LAST, s.score DESC, best_rank, best_score DESC, s.doc_id) AS output_rank FROM scored s LEFT JOIN wide l ON l.qid = s.qid AND l.doc_id = s.doc_id AND l.rank <= 2) SELECT qid, doc_id, score, output_rank, output_rank <= least(20, greatest(10, 5 * num_intents)) AS selected FROM o",
    "sweep_caps": f"{_TO_SCORED}, variants AS (SELECT 'top' || t || '_cap' || c AS variant, t, c FROM (SELECT unnest([3, 5, 10]) AS t) CROSS JOIN (SELECT unnest([5, 10]) AS c)), o AS (SELECT variant, c, qid, score, row_number() OVER (PARTITION BY variant, qid ORDER BY score DESC, best_rank, best_score DESC, doc_id) AS r FROM scored JOIN variants ON best_rank <= t) SELECT variant, qid, count(*) AS n, round(sum(score), 6) AS total FROM o WHERE r <= c GROUP BY variant, qid",
    "tiered_union": f"{_BOTH}, {_POOL}, {_RERANKED}, t AS (SELECT qid, doc_id, 1 AS tier, -1 AS intent_index, rank FROM wide WHERE rank <= 12 UNION ALL SELECT qid, doc_id, 2, intent_index, rank FROM reranked WHERE rank <= 5 UNION ALL SELECT qid, doc_id, 3, intent_index, rank FROM hits WHERE rank <= 5), f AS (SELECT qid, doc_id, min((tier, intent_index, rank)) AS o FROM t GROUP BY qid, doc_id) SELECT qid, doc_id, o[1] AS tier, row_number() OVER (PARTITION BY qid ORDER BY o, doc_id) AS position FROM f",
    "inferred_intent_topm": f"WITH {INDEX_SQL}, {HITS_SQL}, u AS (SELECT qid, doc_id, min(rank) AS mr, max(score) AS ms FROM hits GROUP BY qid, doc_id), r AS (SELECT h.qid, h.intent_index, h.doc_id, row_number() OVER (PARTITION BY h.qid, h.intent_index ORDER BY mr, ms DESC, h.doc_id) AS rank FROM hits h JOIN u USING (qid, doc_id)) SELECT * FROM r WHERE rank <= 5",
    "round_robin_union": f"WITH {INDEX_SQL}, {HITS_SQL}, f AS (SELECT qid, doc_id, min(rank * 100 + intent_index) AS o FROM hits GROUP BY qid, doc_id) SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY o, doc_id) AS position FROM f",
    "coverage_rescue": f"""{_BOTH.replace("WITH", "WITH RECURSIVE", 1)}, fin AS (SELECT qid, list(doc_id ORDER BY rank) AS now FROM wide WHERE rank <= 5 GROUP BY qid),
il AS (SELECT qid, intent_index, list(doc_id ORDER BY rank) AS ranking FROM hits GROUP BY qid, intent_index),
li AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY intent_index) AS k, ranking FROM il),
step(qid, k, now) AS (SELECT f.qid, 0, now FROM fin f WHERE qid IN (SELECT qid FROM li) UNION ALL SELECT s.qid, s.k + 1, CASE WHEN NOT list_has_any(s.now, list_slice(l.ranking, 1, 2)) AND l.ranking[1] % 3 <> 0 AND NOT list_contains(s.now, l.ranking[1]) THEN list_append(s.now, l.ranking[1]) ELSE s.now END FROM step s JOIN li l ON l.qid = s.qid AND l.k = s.k + 1),
fin2 AS (SELECT qid, arg_max(now, k) AS now FROM step GROUP BY qid) SELECT qid, unnest(range(len(now))) AS position, unnest(now) AS doc_id FROM fin2""",
    "ordered_distinct": "WITH f AS (SELECT o_custkey, l_partkey, min((o_orderdate, l_orderkey, l_linenumber)) AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey) SELECT o_custkey, l_partkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o, l_partkey) AS position FROM f",
    "array_set_ops": "WITH s AS (SELECT l_orderkey, coalesce(list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R'), []) AS a, coalesce(list(DISTINCT l_suppkey) FILTER (l_returnflag <> 'R'), []) AS b FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, len(list_intersect(a, b)) AS both, len(list_distinct(list_concat(a, b))) AS either, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_first, list_has_any(a, b) AS overlap FROM s",
    "order_by_reference": f"{_BOTH}, i AS (SELECT DISTINCT qid, doc_id FROM hits) SELECT i.qid, i.doc_id, row_number() OVER (PARTITION BY i.qid ORDER BY l.rank NULLS LAST, i.doc_id) AS position FROM i LEFT JOIN wide l ON l.qid = i.qid AND l.doc_id = i.doc_id",
}
