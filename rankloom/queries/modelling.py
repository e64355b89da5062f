"""Queries of what surrounds models: texts, replies, pools, signatures, caches, hydration, artifacts and title maps."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import collective, generate, linking, rerank
from rankloom.sources import artifacts, calls, clients, jsonl
from rankloom.sources.durable import durable, shared_folder

from .common import COLLAPSE, LONG_WORDS, table


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles of a few laws."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat((d % 7).cast("string"), F.lit("/2020/QH")).alias("law_id"), F.lit("Luật").alias("law_type"), F.col("source").alias("law_name"),
        F.when(d % 9 == 0, "").otherwise(F.concat(F.lit("Điều "), d.cast("string"))).alias("number"), F.when(d % 4 == 0, "").otherwise(F.substring("text", 1, 40)).alias("title"), F.col("text").alias("content"),
    )


_ARTICLES = "articles AS (SELECT doc_id, doc_id % 7 || '/2020/QH' AS law_id, 'Luật' AS law_type, source AS law_name, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'Điều ' || doc_id END AS number, CASE WHEN doc_id % 4 = 0 THEN '' ELSE substr(text, 1, 40) END AS title, text AS content FROM documents)"


def rerank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two rerankers see of each document, as digests."""
    long = rerank.long_text(F.col("law_type"), F.col("law_name"), F.col("number"), F.col("title"), F.col("content"))
    return _articles(spark, sf_dir).select("doc_id", F.md5(long).alias("long_md5"), F.md5(rerank.short_text(F.col("title"), F.col("content"))).alias("short_md5"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbouring documents as the pool of each question."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.floor(n / 10).cast("long").alias("qid"), (n % 10).cast("int").alias("position"), "doc_id", "source", "text")


_POOL = "pool AS (SELECT doc_id // 10 AS qid, (doc_id % 10)::INTEGER AS position, doc_id, source, text FROM documents)"


def rerank_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt of numbered blocks for each pool, as a digest."""
    pool = _pool(spark, sf_dir).select("qid", F.concat(F.lit("q"), F.col("qid").cast("string")).alias("question"), "position", F.col("source").alias("law_name"), F.col("doc_id").cast("string").alias("number"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("content"))
    return rerank.blocks(pool).select("qid", "n", F.md5("prompt").alias("prompt_md5"))


def rerank_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools by the scores of replies: fenced, within prose, with items that can't be read, repeated ones, and broken ones."""
    pool = _pool(spark, sf_dir)
    items = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when((i + F.col("qid")) % 5 == 4, F.lit('{"index": "x", "score": 3}')).otherwise(F.concat(F.lit('{"index": '), i.cast("string"), F.lit(', "score": '), ((i * 7 + F.col("qid")) % 11).cast("string"), F.lit("}")))), ", ")
    reply = F.when(F.col("qid") % 6 == 5, "no list at all").otherwise(F.concat(F.lit("```json\nscores: ["), items, F.lit(', {"index": 2, "score": 1.5}]\n```')))
    replies = pool.select("qid").distinct().withColumn("reply", reply)
    return rerank.full_pool(rerank.scored_by_reply(pool, replies), ["qid"], "doc_id", 3).select("qid", "doc_id", "score", "rank_in_pool", "in_final")


def pair_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client that stands in for a cross-encoder on neighbouring documents, eight pairs a call."""
    words = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9 ]+", " ")
    pool = _pool(spark, sf_dir)
    pairs = pool.select("qid", "position", words(F.col("text")).alias("text")).join(pool.where("position = 0").select("qid", words(F.col("text")).alias("query")), "qid")
    return clients.pair_scores(pairs, F.col("query"), F.col("text"), size=8).select("qid", "position", F.round("score", 9).alias("score"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of five documents as the articles of a question each."""
    a = _articles(spark, sf_dir)
    fields = F.struct("law_id", "law_type", "law_name", "number", "title", "content")
    listed = a.groupBy(F.floor(F.col("doc_id") / 5).alias("qid")).agg(F.sort_array(F.collect_list(F.struct("doc_id", fields.alias("a")))).alias("x"))
    return listed.select("qid", F.concat(F.lit("câu "), F.col("qid").cast("string")).alias("question"), F.transform("x", lambda e: e["a"]).alias("articles"))


def canned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic answers from each group's articles, as digests, with the labels they may be cited by."""
    return _jobs(spark, sf_dir).select("qid", F.md5(generate.canned_answer(F.col("articles"), "Hết.")).alias("answer_md5"), F.array_join(generate.labels(F.col("articles")), " | ").alias("labels"))


def answer_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many signatures the groups of each first law have, where groups share questions, references and articles."""
    first = F.get("articles", F.lit(0))
    seen = F.struct(first["law_id"].alias("law_id"), first["law_type"].alias("law_type"), first["law_name"].alias("law_name"), F.lit("").alias("number"), F.lit(None).cast("string").alias("title"), F.lit("").alias("content"))
    jobs = _jobs(spark, sf_dir).select(first["law_id"].alias("law"), F.concat(F.lit("câu "), (F.col("qid") % 3).cast("string")).alias("question"), F.transform("articles", lambda a: a["law_id"]).alias("refs"), F.array(seen).alias("articles"))
    signed = jobs.select("law", generate.signature({"b": 1, "a": 2}, F.col("question"), F.col("refs"), F.col("articles")).alias("signature"), generate.signature({"a": 2, "b": 1}, F.col("question"), F.col("refs"), F.col("articles")).alias("same"), generate.signature({"a": 2, "b": 2}, F.col("question"), F.col("refs"), F.col("articles")).alias("other"))
    return signed.groupBy("law").agg(F.count("*").alias("n"), F.count_distinct("signature").alias("signatures"), F.sum((F.col("signature") == F.col("same")).cast("long")).alias("same"), F.sum((F.col("signature") == F.col("other")).cast("long")).alias("other"))


def linked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of answers that cite each document among five of one number each or two, by law, by name or by number alone."""
    d = F.col("doc_id")
    article = lambda law, name, number: F.struct(law.alias("law_id"), F.lit(name).alias("law_name"), F.concat(F.lit("Điều "), number.cast("string")).alias("number"))
    law = F.concat((d % 7).cast("string"), F.lit("/2020/QH"))
    articles = F.array(article(F.lit("1/1999/X"), "Quản lý thuế chung", d), article(law, "Doanh nghiệp mới nhất", d), article(law, "Khác", d + 1))
    way = F.when(d % 4 == 0, F.concat(F.lit("- **Kết luận** theo Điều "), d, F.lit(" số "), law, F.lit(" là đúng"))).when(d % 4 == 1, F.concat(F.lit("Điều "), d, F.lit(" về doanh nghiệp mới nhất"))).when(d % 4 == 2, F.concat(F.lit("## Điều "), d)).otherwise(F.concat(F.lit("xem khoản 2 Điều "), d, F.lit(" và Điều "), d + 1, F.lit(" và Điều "), d + 2))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(linking.blocks(way, articles)).alias("line", "s"))
    return lines.select("doc_id", F.array_join(F.transform("s", lambda x: x["kind"]), ",").alias("kinds"), F.array_join(F.transform("s", lambda x: x["text"]), "|").alias("texts"), F.array_join(F.transform(F.filter("s", lambda x: x["article"].isNotNull()), lambda x: x["article"].cast("string")), ",").alias("articles"))


class _Failing:
    """A client that fails at some turns the first time they are asked."""

    def __init__(self, fails: bool) -> None:
        self.fails = fails

    def __call__(self, payload: str) -> str:
        conversation, turn, text = json.loads(payload)
        if self.fails and turn % 5 == 4:
            raise ConnectionError("connection reset")
        return f"{conversation}: {text[:20]}"


def model_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to all user turns from a ledger that two runs have filled: the first one asked even conversations and failed at some turns, the second one was given all."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    payload = F.concat(F.lit("["), F.col("conv_id"), F.lit(","), F.col("turn"), F.lit(","), F.substring(F.to_json(F.array("text")), 2, 1 << 30))
    ledger = calls.Ledger(f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}", "turns", chunk=100)
    runs = calls.Workers(threads=4)
    calls.ask(turns.where("conv_id % 2 = 0"), payload, _Failing(True), workers=runs, ledger=ledger)
    before = durable(ledger.finished(spark).withColumn("run", F.lit(1)))
    told = calls.ask(turns, payload, _Failing(False), workers=runs, ledger=ledger)
    return told.withColumn("digest", ledger.digest(payload)).join(before, "digest", "left").select("conv_id", "turn", "reply", F.coalesce("run", F.lit(2)).alias("run"))


def _cited(n: Column, law: Column) -> Column:
    return F.concat(F.lit("Theo Điều "), n.cast("string"), F.lit(" của Luật "), law, F.lit("."))


def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which answers of an earlier run stand: same signature, not empty, and repaired or cited from the evidence."""
    one = F.array(F.struct("law_id", "law_type", "law_name", F.concat(F.lit("Điều "), F.col("doc_id").cast("string")).alias("number"), F.lit("").alias("title"), F.lit("").alias("content")))
    rows = _articles(spark, sf_dir).withColumn("articles", one)
    d = F.col("doc_id")
    jobs = rows.select(d.alias("qid"), F.lit("s1").alias("signature"), "articles")
    cache = rows.select(d.alias("qid"), F.when(d % 5 == 0, "s0").otherwise("s1").alias("signature"), F.when(d % 7 == 0, " ").when(d % 3 == 0, _cited(d + 1, F.col("law_id"))).otherwise(_cited(d, F.col("law_id"))).alias("answer"), (d % 4 == 0).alias("repaired"))
    return generate.cached(jobs, cache).select("qid", "repaired")


def answer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conclusion and analysis of answers whose sections are headed in several ways."""
    d = F.col("doc_id")
    first, second = F.regexp_replace(F.substring("text", 1, 30), r"[\s*-]+", " "), F.regexp_replace(F.substring("text", 31, 30), r"[\s*-]+", " ")
    text = F.when(d % 3 == 0, F.concat(F.lit("**Kết luận**\n"), F.trim(first), F.lit("\n**Căn cứ**\n"), F.trim(second))).when(d % 3 == 1, F.concat(F.lit("kết luận\n\n"), F.trim(first))).otherwise(F.trim(first))
    part = generate.parts(text)
    return table(spark, sf_dir, "documents").select("doc_id", part["conclusion"].alias("conclusion"), part["has_conclusion"].alias("has_conclusion"))


def title_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts replaced by the official title of their brand: the first tier's, else the second's, of each the last."""
    parts = table(spark, sf_dir, "part")
    row = lambda where, title: parts.where(where).select(F.upper("p_brand").alias("code"), title.alias("title"), F.col("p_partkey").alias("position"))
    official = artifacts.titles({0: row("p_size % 10 = 0", F.concat(F.lit("a  "), F.col("p_name"))), 1: row("p_size % 3 = 0", F.concat(F.lit("b "), F.col("p_type")))})
    return artifacts.named(parts.select("p_partkey", F.col("p_brand").alias("code"), F.col("p_name").alias("name")), official).select("p_partkey", "code", "name")


def reference_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined by the full reference of their part, white space aside, where references repeat."""
    parts = table(spark, sf_dir, "part")
    known = parts.select(F.concat_ws("|", "p_brand", F.concat(F.lit(" "), F.col("p_type"), F.lit("  "))).alias("ref"), "p_partkey")
    hits = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_partkey").join(parts.select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("|", "p_brand", F.concat(F.lit(" "), F.col("p_type"))).alias("ref")), "l_partkey")
    return artifacts.by_reference(hits.select("l_orderkey", "ref"), known, "p_partkey").select("l_orderkey", "p_partkey")


def hydrate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to articles with their texts, and those that nothing is known of, marked."""
    refs = table(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("qid"), F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 6 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("article"))
    known = _articles(spark, sf_dir).select(F.col("doc_id").alias("article"), "law_type", "law_name", "number", "title", "content")
    found, missing = artifacts.hydrated(refs, known, 100)
    return found.select("qid", "article", F.md5("content").alias("content_md5")).unionByName(missing.select("qid", "article", F.lit("missing").alias("content_md5")))


def artifact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of stage artifacts with their fallbacks, made from orders and their lines."""
    item = F.struct(
        F.when(F.col("l_linenumber") == 4, "").otherwise(F.concat(F.lit(" law  "), (F.col("l_partkey") % 9).cast("string"), F.lit("|name|"), F.col("l_partkey").cast("string"))).alias("article"), F.when(F.col("l_suppkey") % 2 == 0, " own doc ").alias("doc"),
        F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(F.col("l_linenumber")).alias("intent_rank"), F.when(F.col("l_linenumber") != 6, F.col("l_linenumber") + 10).alias("best_intent_rank"),
        F.when(F.col("l_quantity") > 25, 0.0).otherwise(F.col("l_quantity")).alias("intent_rrf_score"), F.when(F.col("l_quantity") < 40, F.col("l_quantity") / 2).alias("best_intent_rrf_score"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", item.alias("i")))).alias("x"))
    listed = F.transform("x", lambda e: e["i"])
    rows = lines.select("id", F.when(F.col("id") % 3 == 0, F.slice(listed, 1, 0)).otherwise(F.slice(listed, 1, 2)).alias("intent_hits"), listed.alias("intent_hits_union"))
    return artifacts.intent_hits(rows)


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors of labelled documents, by id."""
    store = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return artifacts.points(store, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


def todo_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations that have no later turn, as what is left to answer."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    answered = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return jsonl.todo(turns.where("role = 'user'").select("conv_id", "turn"), answered, ["conv_id", "turn"])


def collective_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of groups of one to twelve documents, chosen together by the client that stands in for a model."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").withColumn("qid", F.floor(d / 12)).where((d % 12) <= F.col("qid") % 12)
    rows = docs.select("qid", (d % 12).cast("int").alias("position"), F.concat(F.lit("which text is of "), F.col("source"), F.lit(" or "), F.col("lang")).alias("question"), F.lit("Luật").alias("law_type"), F.col("source").alias("law_name"), d.cast("string").alias("article"), F.col("text").alias("content"))
    return collective.select_together(rows).select("qid", F.array_join("selected", ",").alias("selected"), "path", "failed")


QUERIES = {f.__name__: f for f in (rerank_texts, rerank_prompts, rerank_replies, pair_scoring, canned_answers, answer_signatures, linked_answers, model_ledger, cached_answers, answer_parts, title_map, reference_join, hydrate_candidates, artifact_hits, point_lookup, todo_questions, collective_selection)}

_OF = "{0}.number || ', ' || {0}.law_type || ' ' || {0}.law_name"
_PART = r"trim(regexp_replace(substr(text, {0}, 30), '[\s*-]+', ' ', 'g'))"
ORACLES = {
    "rerank_texts": f"WITH {_ARTICLES} SELECT doc_id, md5({COLLAPSE.format('law_type || chr(32) || law_name')} || chr(10) || {COLLAPSE.format('number')} || '. ' || {COLLAPSE.format('title')} || chr(10) || substr({COLLAPSE.format('content')}, 1, 1800)) AS long_md5, md5(coalesce(title, '') || ' ' || substr(coalesce(content, ''), 1, 1000)) AS short_md5 FROM articles",
    "rerank_prompts": f"WITH {_POOL} SELECT qid, count(*)::INTEGER AS n, md5('Câu hỏi: q' || qid || chr(10) || chr(10) || 'Danh sách điều luật cần chấm điểm:' || chr(10) || string_agg('[' || i || '] Văn bản: ' || coalesce(source, '') || chr(10) || 'Điều: ' || doc_id || ' — ' || substr(coalesce(text, ''), 1, 20) || chr(10) || substr(coalesce(text, ''), 1, 400), chr(10) ORDER BY position)) AS prompt_md5 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY position) - 1 AS i FROM pool) GROUP BY qid",
    "rerank_replies": f"WITH {_POOL}, s AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM pool), t AS (SELECT qid, doc_id, CASE WHEN qid % 6 = 5 THEN n - position WHEN position = 2 THEN 1.5 WHEN (position + qid) % 5 = 4 THEN 0 ELSE (position * 7 + qid) % 11 END::DOUBLE AS score FROM s) SELECT *, rank_in_pool <= 3 AS in_final FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank_in_pool FROM t)",
    "pair_scoring": f"WITH {_POOL}, w AS (SELECT qid, position, list_distinct(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda x: x <> '')) AS t FROM pool) SELECT w.qid, w.position, round(CASE WHEN len(q.t) = 0 THEN 0.0 ELSE len(list_intersect(q.t, w.t))::DOUBLE / len(q.t) END, 9) AS score FROM w JOIN w q ON q.qid = w.qid AND q.position = 0",
    "canned_answers": f"""WITH {_ARTICLES}, a AS (SELECT *, doc_id // 5 AS qid, row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) AS k FROM articles),
h AS (SELECT qid, 'Căn cứ ' || {_OF.format('a')} || ', ' || CASE WHEN coalesce(title, '') = '' THEN 'quy định như sau' ELSE lower(title) END || ':' || chr(10) || trim(substr(coalesce(content, ''), 1, 300), ' ') AS head FROM a WHERE k = 1),
m AS (SELECT qid, string_agg(chr(10) || 'Ngoài ra, theo ' || {_OF.format('a')} || ': ' || coalesce(title, '') || '.', '' ORDER BY k) FILTER (k BETWEEN 2 AND 4 AND number <> '') AS more, coalesce(string_agg(trim(number) || ' ' || trim(law_name) || ' (' || law_id || ')', ' | ' ORDER BY k) FILTER (number <> ''), '') AS labels FROM a GROUP BY qid)
SELECT qid, md5(head || chr(10) || coalesce(more, '') || chr(10) || chr(10) || 'Hết.') AS answer_md5, labels FROM h JOIN m USING (qid)""",
    "answer_signatures": f"WITH {_ARTICLES}, g AS (SELECT doc_id // 5 AS qid, list(law_id ORDER BY doc_id) AS refs, first(law_id ORDER BY doc_id) AS law, first(law_name ORDER BY doc_id) AS name FROM articles GROUP BY 1) SELECT law, count(*) AS n, count(DISTINCT (qid % 3, refs, name)) AS signatures, count(*) AS same, 0::BIGINT AS other FROM g GROUP BY law",
    "linked_answers": """SELECT doc_id, ['bullet,bold,text,citation,text', 'citation,text', 'heading', 'text,citation,text,citation,text,text'][doc_id % 4 + 1] AS kinds,
CASE doc_id % 4 WHEN 0 THEN '• |Kết luận| theo |Điều ' || doc_id || '| số ' || doc_id % 7 || '/2020/QH là đúng' WHEN 1 THEN 'Điều ' || doc_id || '| về doanh nghiệp mới nhất' WHEN 2 THEN 'Điều ' || doc_id ELSE 'xem |khoản 2 Điều ' || doc_id || '| và |Điều ' || doc_id + 1 || '| và |Điều ' || doc_id + 2 END AS texts,
['2', '2', '', '1,3'][doc_id % 4 + 1] AS articles FROM documents""",
    "model_ledger": "SELECT conv_id, turn, conv_id || ': ' || substr(coalesce(text, ''), 1, 20) AS reply, CASE WHEN conv_id % 2 = 0 AND turn % 5 <> 4 THEN 1 ELSE 2 END::INTEGER AS run FROM conversations WHERE role = 'user'",
    "cached_answers": "SELECT doc_id AS qid, doc_id % 4 = 0 AS repaired FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND (doc_id % 4 = 0 OR doc_id % 3 <> 0)",
    "answer_parts": f"SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN {_PART.format(1)} ELSE '' END AS conclusion, doc_id % 3 < 2 AND {_PART.format(1)} <> '' AS has_conclusion FROM documents",
    "title_map": rf"WITH r AS (SELECT lower(p_brand) AS c, trim(regexp_replace('a  ' || p_name, '\s+', ' ', 'g')) AS title, 0 AS tier, p_partkey FROM part WHERE p_size % 10 = 0 UNION ALL SELECT lower(p_brand), trim(regexp_replace('b ' || p_type, '\s+', ' ', 'g')), 1, p_partkey FROM part WHERE p_size % 3 = 0), f AS (SELECT c, title FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY tier, p_partkey DESC) AS n FROM r) WHERE n = 1) SELECT p_partkey, p_brand AS code, upper(substr(coalesce(title, {COLLAPSE.format('p_name')}), 1, 1)) || substr(coalesce(title, {COLLAPSE.format('p_name')}), 2) AS name FROM part LEFT JOIN f ON c = lower(trim(p_brand))",
    "reference_join": "WITH k AS (SELECT p_brand, p_type, max(p_partkey) AS p_partkey FROM part GROUP BY ALL) SELECT l_orderkey, k.p_partkey FROM lineitem JOIN part p ON p.p_partkey = l_partkey JOIN k ON k.p_brand = p.p_brand AND k.p_type = p.p_type WHERE l_linenumber = 1",
    "hydrate_candidates": f"WITH r AS (SELECT doc_id % 50 AS qid, CASE WHEN doc_id % 6 = 0 THEN -doc_id - 1 ELSE doc_id END AS article FROM labels) SELECT qid, article, CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE md5(substr({COLLAPSE.format('text')}, 1, 100)) END AS content_md5 FROM r LEFT JOIN documents d ON d.doc_id = article",
    "artifact_hits": "WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) SELECT l_orderkey AS id, 'law ' || l_partkey % 9 || '|name|' || l_partkey AS article, CASE WHEN l_suppkey % 2 = 0 THEN 'own doc' ELSE 'law ' || l_partkey % 9 || '|name' END AS doc, CASE WHEN l_linenumber % 2 = 1 THEN l_linenumber WHEN l_linenumber <> 6 THEN l_linenumber + 10 ELSE 1000000000 END::BIGINT AS intent_rank, CASE WHEN l_quantity <= 25 THEN l_quantity WHEN l_quantity < 40 THEN l_quantity / 2 ELSE 0.0 END AS score FROM l WHERE l_linenumber <> 4 AND (l_orderkey % 3 = 0 OR k <= 2)",
    "collective_selection": rf"""WITH c AS (SELECT doc_id // 12 AS qid, doc_id % 12 AS position, doc_id::VARCHAR AS article, 'which text is of ' || source || ' or ' || lang AS question, substr(coalesce(text, ''), 1, 1800) AS content FROM documents WHERE doc_id % 12 <= (doc_id // 12) % 12),
n AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, (row_number() OVER (PARTITION BY qid ORDER BY position) - 1) // 6 AS b FROM c),
q AS (SELECT *, max(question) OVER (PARTITION BY qid, CASE WHEN n > 8 THEN b END) AS asked FROM n),
h AS (SELECT *, len(list_intersect({LONG_WORDS.format('asked')}, {LONG_WORDS.format('content')})) > 0 AS hit FROM q),
r AS (SELECT *, max(question) FILTER (hit) OVER (PARTITION BY qid) AS again FROM h),
s AS (SELECT *, hit AND (n <= 8 OR len(list_intersect({LONG_WORDS.format('again')}, {LONG_WORDS.format('content')})) > 0) AS kept FROM r)
SELECT qid, CASE WHEN n < 2 THEN string_agg(article, ',' ORDER BY position) ELSE coalesce(string_agg(article, ',' ORDER BY position) FILTER (kept), arg_min(article, position)) END AS selected, CASE WHEN n < 2 THEN 'skipped' WHEN n <= 8 THEN 'direct' ELSE 'rounds' END AS path, n > 8 AND NOT bool_or(hit) AS failed FROM s GROUP BY qid, n""",
    "point_lookup": "SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)",
    "todo_questions": "SELECT conv_id, turn FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn = c.turn + 1)",
}
