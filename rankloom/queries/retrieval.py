"""Queries of retrieval: tokens, BM25, dense vectors, fusion, intents and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import bm25, dense, fusion, impact
from rankloom.operators.features import rank_by_score

from .common import GLOBAL_SQL, HITS_SQL, INDEX_SQL, INTENTS_SQL, TOKENS, VECTORS_SQL, dense_hits, dense_sql, fuse_sql, index_of, intent_hits, intents_of, question_hits, questions, questions_sql, table, vectors


def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_distinct"))


def bm25_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.build(table(spark, sf_dir, "documents")).terms.select("term", "df", F.round("idf", 9).alias("idf"))


def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(index_of(spark, sf_dir), questions(spark, sf_dir), 10)


def impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from impact-ordered blocks, of which only those are read that can matter."""
    return impact.search(impact.blocks(index_of(spark, sf_dir), size=64), questions(spark, sf_dir), 10).hits


def _dense(distance: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors(spark, sf_dir)
        return dense.top_k(rows.where("id % 100 = 0").select(F.col("id").alias("qid"), "v"), rows, 10, distance)

    return query


def _dense_sql(expression: str) -> str:
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS qid, x.vec_id AS id, round({expression}, 6) + 0.0 AS score FROM v q JOIN v x ON q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10"""


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = dense.l2_normalize(F.col("v"))
    return vectors(spark, sf_dir).select("id", F.round(dense.norm(F.col("v")), 6).alias("norm"), F.round(F.element_at(v, 1), 6).alias("first"), F.round(F.element_at(v, -1), 6).alias("last"))


def vector_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", dense.is_valid(F.col("v"), 64).alias("valid"))


def _dense_of_questions(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """A question's vector is the stored one of the same number; documents without vector aren't found."""
    return dense_hits(spark, sf_dir, questions(spark, sf_dir).select("qid", F.col("qid").alias("vec_id")), k)


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = bm25.search(index_of(spark, sf_dir), questions(spark, sf_dir), 50)
    return fusion.rrf([lexical, _dense_of_questions(spark, sf_dir, 50)])


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the question, its vector, and the vector of its topic (its first sentence) if that differs."""
    return question_hits(spark, sf_dir)


def hybrid_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense hits; questions without any get those of their words, marked."""
    found = _dense_of_questions(spark, sf_dir, 10).select("qid", "doc_id", "rank", F.lit("dense").alias("method"))
    rest = questions(spark, sf_dir).join(found.select("qid").distinct(), "qid", "left_anti")
    return found.unionByName(bm25.search(index_of(spark, sf_dir), rest, 10).select("qid", "doc_id", "rank", F.lit("global_fallback").alias("method")))


def payload_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their text's source; else their vector's label; else a stub."""
    hits = rrf_fuse(spark, sf_dir).where("rank <= 20").select("qid", "doc_id", "rank")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("label"))
    return hits.join(docs, "doc_id", "left").join(labels, "doc_id", "left").select("qid", "doc_id", "rank", F.coalesce("source", "label", F.lit("stub")).alias("payload"))


def intents_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intents_of(questions(spark, sf_dir)).select("qid", F.size("intents").alias("num_intents"), F.array_join("intents", " | ").alias("intents"))


def intent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per intent: BM25 and vectors, 50 each, fused by reciprocal rank, the ten best."""
    return intent_hits(spark, sf_dir)


def intent_union_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.union_by_article(intent_hits(spark, sf_dir)).select("qid", "doc_id", "min_rank", "max_score", "n_match", "position")


def intent_union_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.union_by_chunk(intent_hits(spark, sf_dir))


def prefix_topk_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first K hits for several K at once, from one ranking."""
    ranked = bm25.search(index_of(spark, sf_dir), questions(spark, sf_dir), 60)
    return ranked.select("qid", "doc_id", "rank", F.explode(F.filter(F.array(*map(F.lit, (5, 10, 20, 60))), lambda k: k >= F.col("rank"))).alias("k"))


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25.search(index_of(spark, sf_dir), questions(spark, sf_dir), 5)
    scores = hits.groupBy("qid").agg(F.max("score").alias("top1"), F.round(F.avg("score"), 9).alias("mean5"))
    return questions(spark, sf_dir).select("qid").join(scores, "qid", "left").fillna(0.0, ["top1", "mean5"])


def coverage_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and mean score of each question, and whether it lies at or below the lowest tenth."""
    rows = _probe(spark, sf_dir)
    line = rows.agg(F.percentile("top1", 0.1).alias("line"))  # one row
    return rows.join(F.broadcast(line), how="cross").select("qid", "top1", "mean5", (F.col("top1") <= F.col("line")).alias("gap"))


def lowest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(spark, sf_dir).select("qid", "top1").orderBy("top1", "qid").limit(30)


def percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*(F.round(F.percentile(length, p), 6).alias(f"p{int(100 * p)}") for p in (0.1, 0.5, 0.9)))


def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the documents with most of a question's words among them that lexical search finds.

    Gold documents are the three best by the number of different shared words; the search is BM25.
    """
    words = questions(spark, sf_dir).select("qid", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"))
    shared = words.join(index_of(spark, sf_dir).postings, "term").groupBy("qid", "doc_id").agg(F.count("*").alias("score"))
    gold = rank_by_score(shared, ["qid"], "doc_id", 3).groupBy("qid").agg(F.collect_set("doc_id").alias("gold"))
    found = bm25_topk(spark, sf_dir).groupBy("qid").agg(F.collect_set("doc_id").alias("found"))
    return gold.join(found, "qid").select("qid", F.size(F.array_intersect("found", "gold")).alias("n_found"), F.round(fusion.recall(F.col("found"), F.col("gold")), 6).alias("recall"))


QUERIES = {f.__name__: f for f in (tokenize_stats, bm25_index_terms, bm25_corpus_stats, bm25_topk, impact_topk, l2_normalize, vector_validate, rrf_fuse, hybrid_topk, hybrid_fallback, payload_resolve, intents_sanitized, intent_topk, intent_union_article, intent_union_chunk, prefix_topk_exports, coverage_probe, lowest_n, percentile_linear, retrieval_recall)}
QUERIES |= {f"dense_topk_{d}": _dense(d) for d in ("cosine", "dot", "euclid")}

_DENSE = dense_sql("dense", "(SELECT item_id AS qid, item_id AS vec_id FROM benchmark)", "qid", 50)
_FUSED = f"WITH {INDEX_SQL}, {VECTORS_SQL}, {questions_sql('lex', 50)}, {_DENSE}, {fuse_sql('fused', ['lex', 'dense'], 'qid', 100)}"
_PROBE = f"WITH {INDEX_SQL}, {questions_sql('lex', 5)}, probe AS (SELECT item_id AS qid, coalesce(max(score), 0.0) AS top1, coalesce(round(avg(score), 9), 0.0) AS mean5 FROM benchmark LEFT JOIN lex ON item_id = qid GROUP BY item_id)"
ORACLES = {
    "tokenize_stats": f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents)",
    "bm25_index_terms": f"WITH {INDEX_SQL} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 9) AS idf FROM terms CROSS JOIN stats",
    "bm25_corpus_stats": f"WITH {INDEX_SQL} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_topk": f"WITH {INDEX_SQL}, {questions_sql('lex', 10)} SELECT * FROM lex",
    "impact_topk": f"WITH {INDEX_SQL}, {questions_sql('lex', 10)} SELECT * FROM lex",
    "dense_topk_cosine": _dense_sql("list_cosine_similarity(q.e, x.e)"),
    "dense_topk_dot": _dense_sql("list_inner_product(q.e, x.e)"),
    "dense_topk_euclid": _dense_sql("-list_distance(q.e, x.e)"),
    "l2_normalize": "SELECT vec_id AS id, round(n, 6) AS norm, round(e[1] / n, 6) AS first, round(e[-1] / n, 6) AS last FROM (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))",
    "vector_validate": "SELECT vec_id AS id, coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0, false) AS valid FROM embeddings",
    "rrf_fuse": f"{_FUSED} SELECT * FROM fused",
    "hybrid_topk": f"WITH {INDEX_SQL}, {INTENTS_SQL}, {VECTORS_SQL}, {GLOBAL_SQL} SELECT * FROM wide",
    "hybrid_fallback": f"WITH {INDEX_SQL}, {VECTORS_SQL}, {questions_sql('lex', 10)}, {_DENSE} SELECT qid, doc_id, rank, 'dense' AS method FROM dense WHERE rank <= 10 UNION ALL SELECT qid, doc_id, rank, 'global_fallback' FROM lex WHERE qid NOT IN (SELECT qid FROM dense)",
    "payload_resolve": f"{_FUSED} SELECT f.qid, f.doc_id, f.rank, coalesce(d.source, 'label ' || e.label, 'stub') AS payload FROM fused f LEFT JOIN documents d USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = f.doc_id WHERE f.rank <= 20",
    "intents_sanitized": f"WITH {INTENTS_SQL} SELECT qid, len(intents) AS num_intents, array_to_string(intents, ' | ') AS intents FROM intents",
    "intent_topk": f"WITH {INDEX_SQL}, {HITS_SQL} SELECT * FROM hits",
    "intent_union_article": f"WITH {INDEX_SQL}, {HITS_SQL}, u AS (SELECT qid, doc_id, min(rank) AS min_rank, max(score) AS max_score, count(*) AS n_match FROM hits GROUP BY qid, doc_id) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY min_rank, max_score DESC, doc_id) AS position FROM u",
    "intent_union_chunk": f"WITH {INDEX_SQL}, {HITS_SQL}, u AS (SELECT qid, doc_id, min(rank) AS min_rank, arg_min(score, intent_index) AS first_score FROM hits GROUP BY qid, doc_id) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY min_rank, first_score DESC, doc_id) AS position FROM u",
    "prefix_topk_exports": f"WITH {INDEX_SQL}, {questions_sql('lex', 60)} SELECT qid, doc_id, rank, k FROM lex JOIN (SELECT unnest([5, 10, 20, 60]) AS k) ON k >= rank",
    "coverage_probe": f"{_PROBE} SELECT qid, top1, mean5, top1 <= (SELECT quantile_cont(top1, 0.1) FROM probe) AS gap FROM probe",
    "lowest_n": f"{_PROBE} SELECT qid, top1 FROM probe ORDER BY top1, qid LIMIT 30",
    "percentile_linear": "SELECT lang, round(quantile_cont(l, 0.1), 6) AS p10, round(quantile_cont(l, 0.5), 6) AS p50, round(quantile_cont(l, 0.9), 6) AS p90 FROM (SELECT lang, length(text)::DOUBLE AS l FROM documents) GROUP BY lang",
    "retrieval_recall": f"WITH {INDEX_SQL}, {questions_sql('lex', 10)}, s AS (SELECT qid, doc_id, count(*) AS score FROM lex_w JOIN postings USING (term) GROUP BY qid, doc_id), gold AS (SELECT qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 3) SELECT gold.qid, count(lex.doc_id) AS n_found, round(count(lex.doc_id)::DOUBLE / count(*), 6) AS recall FROM gold LEFT JOIN lex ON lex.qid = gold.qid AND lex.doc_id = gold.doc_id GROUP BY gold.qid",
}
