"""Queries over whole runs: snapshots of a phase and comparisons of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import bm25
from rankloom.plans import snapshots

from .common import GLOBAL_SQL, HITS_SQL, INDEX_SQL, both_hits, intent_hits, lexical_hits, question_hits, questions, questions_sql, table


def _article(doc_id):
    return F.concat((doc_id % 7).cast("string"), F.lit("/2020/QH|Luật|Điều "), doc_id.cast("string"))


def phase_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of the first five hits of each intent."""
    rankings = intent_hits(spark, sf_dir).select("qid", "intent_index", _article(F.col("doc_id")).alias("article"), "rank")
    asked = questions(spark, sf_dir).select("qid", F.col("query").alias("question"))
    rows = snapshots.snapshot(asked, rankings, 5)
    return rows.select("id", F.array_join("relevant_articles", ";").alias("articles"), F.array_join("relevant_docs", ";").alias("docs"))


def phase_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of articles in the snapshots of two phases."""
    wide, hits = both_hits(spark, sf_dir)
    asked = questions(spark, sf_dir).select("qid", F.col("query").alias("question"))
    one = lambda d, phase, n: snapshots.sizes(snapshots.snapshot(asked, d.select("qid", "intent_index", _article(F.col("doc_id")).alias("article"), "rank"), n), phase)
    return one(hits, "intents", 5).unionByName(one(wide.withColumn("intent_index", F.lit(0)), "question", 12)).withColumn("mean", F.round("mean", 6))


def runs_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of each question by words and vectors against those by words alone."""
    lexical = lexical_hits(spark, sf_dir)
    wide = question_hits(spark, sf_dir, lexical=lexical)
    return snapshots.compared_runs(wide.where("rank <= 10"), lexical.where("rank <= 10"), ["qid"], "doc_id")


def coverage_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions against the English documents alone and against all, by the threshold of the former."""
    asked, docs = questions(spark, sf_dir), table(spark, sf_dir, "documents")

    def probe(corpus: DataFrame) -> DataFrame:
        hits = bm25.search(bm25.build(corpus, only=bm25.words_of(asked)), asked, 1)
        return asked.select("qid").join(hits.select("qid", F.col("score").alias("top1")), "qid", "left").fillna(0.0, ["top1"])

    return snapshots.compared_probes(probe(docs.where("lang = 'en'")), probe(docs))


QUERIES = {f.__name__: f for f in (phase_snapshot, phase_sizes, runs_compared, coverage_compared)}

_ROBIN = """robin AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank, intent_index) AS position FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY rank, intent_index) AS nth FROM hits WHERE rank <= 5) WHERE nth = 1),
docs AS (SELECT qid, doc_id % 7 AS law, min(position) AS position FROM robin GROUP BY ALL)"""
_SIDE = "(WITH {0}, {1} SELECT item_id AS qid, coalesce(max(score), 0.0) AS top1 FROM benchmark LEFT JOIN lex ON item_id = qid GROUP BY item_id)"
ORACLES = {
    "phase_snapshot": f"WITH {INDEX_SQL}, {HITS_SQL}, {_ROBIN}, a AS (SELECT qid, string_agg(doc_id % 7 || '/2020/QH|Luật|Điều ' || doc_id, ';' ORDER BY position) AS articles FROM robin GROUP BY qid), d AS (SELECT qid, string_agg(law || '/2020/QH|Luật', ';' ORDER BY position) AS docs FROM docs GROUP BY qid) SELECT qid AS id, articles, docs FROM a JOIN d USING (qid)",
    "phase_sizes": f"WITH {INDEX_SQL}, {HITS_SQL}, {GLOBAL_SQL}, {_ROBIN}, n AS (SELECT 'intents' AS phase, qid, count(*) AS n FROM robin GROUP BY qid UNION ALL SELECT 'question', qid, count(*) FROM wide WHERE rank <= 12 GROUP BY qid) SELECT phase, count(*) AS questions, min(n)::INTEGER AS least, max(n)::INTEGER AS most, round(avg(n), 6) AS mean FROM n GROUP BY phase",
    "runs_compared": f"""WITH {INDEX_SQL}, {HITS_SQL}, {GLOBAL_SQL}, {questions_sql('lex', 10)}, o AS (SELECT qid, doc_id, rank AS a FROM wide WHERE rank <= 10), j AS (SELECT coalesce(o.qid, l.qid) AS qid, coalesce(o.doc_id, l.doc_id) AS doc_id, a, l.rank AS b FROM o FULL JOIN lex l ON l.qid = o.qid AND l.doc_id = o.doc_id)
SELECT qid, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS in_both, count(*) FILTER (b IS NULL) AS only_old, count(*) FILTER (a IS NULL) AS only_new, max(doc_id) FILTER (a = 1) IS NOT DISTINCT FROM max(doc_id) FILTER (b = 1) AS same_first, coalesce(max(abs(a - b)), 0)::BIGINT AS largest_shift FROM j GROUP BY qid""",
    "coverage_compared": f"""WITH o AS {_SIDE.format(INDEX_SQL.replace('FROM documents', "FROM (SELECT * FROM documents WHERE lang = 'en')"), questions_sql('lex', 1))}, n AS {_SIDE.format(INDEX_SQL, questions_sql('lex', 1))}, g AS (SELECT qid, o.top1 AS old_top1, n.top1 AS new_top1, o.top1 <= line AS old_gap, n.top1 <= line AS new_gap FROM o JOIN n USING (qid), (SELECT round(quantile_cont(top1, 0.1), 4) AS line FROM o))
SELECT *, CASE WHEN old_gap AND new_gap THEN 'both' WHEN old_gap THEN 'closed' WHEN new_gap THEN 'opened' ELSE 'none' END AS change FROM g""",
}
