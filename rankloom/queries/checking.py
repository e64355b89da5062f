"""Queries of rules, verification, answers and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import maps
from rankloom.functions import text as T
from rankloom.operators import answers, bm25, citations, fusion, rules, verify
from rankloom.plans import checks
from rankloom.sources import tables

from .common import INDEX_SQL, LONG_WORDS, index_of, questions, questions_sql, table

#: Titles, questions and laws that documents take in turn, so that rules meet every role.
TITLES = ["Hình thức xử phạt", "Mức phạt tiền", "Thẩm quyền xử phạt", "Cưỡng chế nợ thuế", "Vi phạm quy định về hồ sơ", "Điều kiện đăng ký", "Biện pháp khắc phục hậu quả", "Phạm vi điều chỉnh", "Xử phạt hành vi gian lận", "Nguyên tắc xử phạt", "XỬ PHẠT đối với tổ chức"]
ASKED = ["Thủ tục đăng ký gồm hồ sơ nào?", "Mức phạt tiền là bao nhiêu?", "Công ty bị xử lý như thế nào?", "Thời hạn nộp là bao lâu?", "Có bị cưỡng chế không?", "Nội dung chung là gì?"]
LAWS = ["Luật Doanh nghiệp", "Nghị định xử phạt vi phạm hành chính", "Luật Quản lý thuế"]
CLASSES = {1: "expired_before_as_of", 2: "active", 3: "not_yet_effective_as_of", 4: ""}


def _pick(values: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents make a question: qid, position, question, law_name, title, content, article."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.floor(d / 5).cast("long").alias("qid"), (d % 5 + 1).cast("int").alias("position"), _pick(ASKED, F.floor(d / 5)).alias("question"), _pick(LAWS, d).alias("law_name"), _pick(TITLES, d).alias("title"), T.text_of(F.col("text")).alias("content"),
        F.concat(F.lit("'"), (d % 7).cast("string"), F.lit("/2020/QH|Luật "), F.col("source"), F.lit("|Điều "), d.cast("string")).alias("article"), "doc_id",
    )


def class_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = tables.status_of(spark.createDataFrame([(f"'{k}/2020/QH", v) for k, v in CLASSES.items()], "law_id string, effective_class_as_of string"))
    return rules.drop_invalid(_candidates(spark, sf_dir), classes).select("qid", "position", "article")


def never_empty_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.penalty_cleanup(_candidates(spark, sf_dir)).select("qid", "position", "reason")


def never_empty_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.enforcement_gate(_candidates(spark, sf_dir)).select("qid", "position", "reason")


def role_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("qid", "position", rules.role_of(F.col("title")).alias("role"), rules.penalty_decision(F.col("question"), F.col("law_name"), F.col("title"))["reason"].alias("reason"))


def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_rules(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


def confidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One confidence a conversation from its turns': short ones are low, long ones high, empty ones failed."""
    n = F.length(T.text_of(F.col("text")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.when(n < 200, "low").when(n < 600, "medium").otherwise("high").alias("confidence"), (n == 0).alias("failed"))
    return rows.groupBy("conv_id").agg(verify.merged_confidence(F.col("confidence"), F.col("failed")).alias("confidence"))


def fair_share_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).select("source", "lang", "n", answers.fair_share(2400, 48_000, F.col("n")).alias("share"))


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).select("qid", "question", "position", F.col("article").alias("ref"), "content")
    return answers.render(rows, 300, 1_200).select("qid", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


def batches_of_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations in batches of six, with the key of each in its batch."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 50).alias("qid"), F.struct("conv_id", "turn").alias("position"))
    return verify.aliased(rows).select("qid", F.col("position.conv_id").alias("conv_id"), F.col("position.turn").alias("turn"), "batch", "key")


def stage_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of candidates go to the stand-in model; replies are parsed and merged, gaps filled."""
    asked = F.substring(F.first("content").over(Window.partitionBy("qid").orderBy("position")), 1, 60)
    rows = _candidates(spark, sf_dir).withColumn("law_type", F.lit("Luật")).withColumn("question", asked)
    told = verify.selected(verify.ask(verify.prompts(rows)))
    listed = fusion.collect_ordered(rows, ["qid"], "article", out="candidates")
    chosen = verify.with_fallback(F.col("selected"), F.col("candidates"), F.col("parse_failures") > 0, F.lit(True))
    filled = listed.join(told, "qid", "left").withColumn("filled", chosen)
    return filled.select("qid", F.array_join("filled", ";").alias("selected"), "confidence", F.array_join(verify.collective_fallback(F.col("filled"), F.col("candidates")), ";").alias("final"))


def citation_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that an answer cites, from answers built of each document's lines."""
    answer = F.concat_ws(" ", F.transform(F.split(T.text_of(F.col("text")), "\n"), lambda x, i: F.concat(F.lit("Điều "), (i % 4).cast("string"), F.when(i % 3 == 0, "a").otherwise(""), F.lit(" "), F.substring(x, 1, 10))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.mentions(answer), ",").alias("numbers"))


def citation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite the articles of their question in six ways, some of them wrong: whether all citations are supported."""
    number, law = F.col("doc_id").cast("string"), F.concat((F.col("doc_id") % 7).cast("string"), F.lit("/2020/QH"))
    ways = [
        F.concat(F.lit("Theo Điều "), number, F.lit(" của Luật "), law, F.lit(".")),
        F.concat(F.lit("Luật số "), law, F.lit(" (Điều "), number, F.lit(").")),
        F.concat(F.lit("Theo Điều "), number, F.lit(" của Luật 9/2020/QH.")),
        F.concat(F.lit("Theo điều "), number, F.lit(".")),
        F.concat(F.lit("Xem Điều "), (F.col("doc_id") + 1_000_000).cast("string"), F.lit(";")),
        F.concat(F.lit("Theo Điều "), number, F.lit(" " + "x" * 120 + " "), law, F.lit(".")),
    ]
    rows = _candidates(spark, sf_dir).select("qid", "position", F.get(F.array(*ways), (F.col("doc_id") % len(ways)).cast("int")).alias("part"), F.struct(F.concat(F.lit("Điều "), number).alias("number"), law.alias("law_id")).alias("article"))
    listed = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("position", "part", "article"))).alias("a"))
    answer = F.array_join(F.transform("a", lambda x: x["part"]), " ")
    return listed.select("qid", citations.check(answer, F.transform("a", lambda x: x["article"])).alias("c")).select("qid", "c.ok", "c.detail")


def submission_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of rows made from documents, some of them broken on purpose."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        F.when(d % 50 == 0, "x").when(d % 40 == 1, "7").otherwise(d.cast("string")).alias("id"), F.when(d % 30 == 2, None).otherwise(F.col("lang")).alias("question"), F.when(d % 25 == 3, "none").otherwise("theo Điều 5").alias("answer"),
        F.array(F.when(d % 20 == 4, "law").otherwise("law|name")).alias("relevant_docs"), F.array(F.when(d % 35 == 5, "law|name|5").otherwise("law|name|Điều 5")).alias("relevant_articles"),
    )
    return answers.problems(rows)


def referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without a document and documents without a label, by id."""
    labels, docs = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id")
    return labels.join(docs, "doc_id", "left_anti").withColumn("problem", F.lit("no document")).unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("problem", F.lit("no label")))


def stage_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of a stage's rows made from documents, with ids left out, added and repeated, empty fields and unknown references."""
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    rows = docs.where("doc_id % 17 <> 3").select((F.when(d % 19 == 4, -d - 1).otherwise(d)).alias("id"), F.when(d % 23 == 5, "").otherwise(F.col("lang")).alias("answer"), F.array(F.concat(F.lit("a"), (d % 40).cast("string"))).alias("relevant_articles"))
    rows = rows.unionByName(rows.where("id % 29 = 6"))
    known = docs.select(F.concat(F.lit("a"), (d % 37).cast("string")).alias("article")).distinct()
    return checks.stage_problems(rows, docs.select(d.alias("id")), ["answer", "relevant_articles"], known)


def stores_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents, postings and vectors that don't belong together; vectors are those of the same numbers."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(d, F.concat(F.lit("h"), (d % 5).cast("string")).alias("hash"))
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("h"), F.when(F.col("vec_id") % 11 == 0, 9).otherwise(F.col("vec_id") % 5).cast("string")).alias("hash"), F.lit("b").alias("backend"), F.when(F.col("label") == 0, "old").otherwise("m").alias("model"))
    postings = table(spark, sf_dir, "labels").select(F.when(d % 13 == 0, -d - 1).otherwise(d).alias("doc_id"))
    return checks.consistency(docs, postings, stored, "b", "m")


def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of customers merged: the right one wins, defaults fill up."""
    key = F.col("c_custkey")
    left = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    right = F.when(key % 3 == 0, F.create_map(F.lit("nation"), F.lit(None).cast("string"), F.lit("new"), key.cast("string"))).when(key % 3 == 1, F.create_map(F.lit("nation"), F.lit("x")))
    both = maps.with_defaults(maps.merged(left, right), F.create_map(F.lit("new"), F.lit("none"), F.lit("more"), F.lit("yes")))
    told = F.array_join(F.sort_array(F.transform(F.map_entries(both), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), ",")
    return table(spark, sf_dir, "customer").select("c_custkey", told.alias("merged"))


def id_set_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pairs of tables hold the same ids, without repeats."""
    return tables.same_ids({"orders_lines": (table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()), "vectors_documents": (table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))})


def semi_join_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(kept, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def anti_join_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of the highest priority."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the names of their nation and region; build sides have unique keys, which is checked."""
    nation = tables.unique(table(spark, sf_dir, "nation"), ["n_nationkey"])
    region = tables.unique(table(spark, sf_dir, "region"), ["r_regionkey"])
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


def settings_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders that each of a few settings keeps, and their value."""
    grid = spark.createDataFrame([(q, d) for q in (10.0, 25.0, 40.0) for d in (0.02, 0.06)], "most_quantity double, least_discount double")
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    kept = lines.join(F.broadcast(grid), (F.col("l_quantity") <= F.col("most_quantity")) & (F.col("l_discount") >= F.col("least_discount")))
    return kept.groupBy("most_quantity", "least_discount").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("value"))


def route_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route for each user turn: small talk if very short, out of scope if hardly any word, else legal."""
    n = F.size(T.tokens(F.col("text")))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.when(n < 5, "out_of_scope").when(n < 15, "small_talk").otherwise("legal").alias("route"))


def default_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified selections; questions without one take their first five candidates, marked."""
    listed = fusion.collect_ordered(bm25.search(index_of(spark, sf_dir), questions(spark, sf_dir), 10), ["qid"], "doc_id", "rank", "candidates")
    records = listed.where("qid % 4 <> 0").select("qid", F.filter("candidates", lambda x: x % 2 == 0).alias("chosen"))
    joined = listed.join(records, "qid", "left")
    return joined.select("qid", F.array_join(F.transform(F.coalesce("chosen", F.slice("candidates", 1, 5)), lambda x: x.cast("string")), ",").alias("items"), F.when(F.col("chosen").isNull(), "missing_record_default").otherwise("verified").alias("origin"))


def reference_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoders of article references side by side."""
    ref = F.concat_ws("|", F.concat(F.lit(" "), F.col("p_brand")), "p_type", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")), F.concat(F.lit("Điều "), F.col("p_size").cast("string")))
    rows = table(spark, sf_dir, "part").select("p_partkey", ref.alias("ref"))
    key = T.lookup_key(F.col("ref"))
    return rows.select("p_partkey", T.doc_of(F.col("ref")).alias("doc"), T.doc_before_last(F.col("ref")).alias("before_last"), T.doc_or_empty(F.col("ref")).alias("or_empty"), key["law_id"].alias("law_id"), key["number"].alias("number"))


QUERIES = {f.__name__: f for f in (class_drop, never_empty_fallback, never_empty_guard, role_rules, reason_counts, confidence_merge, fair_share_budget, prompt_render, batches_of_six, stage_selection, citation_mentions, citation_validate, submission_validate, stage_checked, stores_consistent, map_merge, referential_check, id_set_equal, semi_join_keep, anti_join_todo, lookup_join, settings_grid, route_turns, default_assembly, reference_codecs)}


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _has(c: str, pattern: str) -> str:
    # A word's end, where \\b knows ASCII letters only.
    return f"regexp_matches({c}, '(?i){pattern}')".replace(r"\b", r"(?:$|[^\p{L}\p{N}_])")


_CANDIDATES = f"""c AS (SELECT doc_id // 5 AS qid, (doc_id % 5 + 1)::INTEGER AS position, {_list(ASKED)}[(doc_id // 5) % {len(ASKED)} + 1] AS question, {_list(LAWS)}[doc_id % {len(LAWS)} + 1] AS law_name, {_list(TITLES)}[doc_id % {len(TITLES)} + 1] AS title, coalesce(text, '') AS content, '''' || doc_id % 7 || '/2020/QH|Luật ' || source || '|Điều ' || doc_id AS article, doc_id FROM documents)"""
_REASON = f"CASE WHEN NOT {_has('law_name || chr(32) || title', rules.PENALTY_ARTICLE)} THEN '' WHEN {_has('question', rules.PENALTY_QUESTION)} THEN 'question_penalty_signal' WHEN {_has('question', rules.OTHER_QUESTION)} THEN 'non_penalty_question_with_penalty_article' ELSE 'ambiguous_question' END"
_ROLE = f"CASE WHEN {_has('title', rules.ROLE_EXEMPT)} THEN NULL " + " ".join(f"WHEN {_has('title', p)} THEN '{r}'" for r, p, _ in rules.ROLES) + " ELSE NULL END"
_ASKS = "CASE " + " ".join(f"WHEN role = '{r}' THEN {_has('question', p)}" for r, _, p in rules.ROLES) + " ELSE false END"
_PENALTY = f"(({_has('law_name', rules.PENALTY_LAW)} AND {_has('title', rules.OFFENCE_TITLE)}) OR ({_has('title', rules.OFFENCE_TITLE)} AND {_has('substr(content, 1, 700)', rules.OPERATIVE)}) OR role IS NOT NULL)"
ORACLES = {
    "class_drop": f"WITH {_CANDIDATES} SELECT qid, position, article FROM c WHERE doc_id % 7 NOT IN (1, 3)",
    "never_empty_fallback": f"WITH {_CANDIDATES}, r AS (SELECT *, {_REASON} AS reason FROM c), k AS (SELECT *, max((reason <> 'non_penalty_question_with_penalty_article')::INTEGER) OVER (PARTITION BY qid) AS kept FROM r) SELECT qid, position, reason FROM k WHERE reason <> 'non_penalty_question_with_penalty_article' OR kept = 0",
    "never_empty_guard": f"""WITH {_CANDIDATES}, r AS (SELECT *, {_ROLE} AS role FROM c), p AS (SELECT *, {_has('title', rules.COERCION_TITLE)} AS coercion, {_PENALTY} AS penalty, {_ASKS} AS asks FROM r),
a AS (SELECT *, max((NOT coercion AND NOT penalty)::INTEGER) OVER (PARTITION BY qid) = 1 AS alt FROM p),
d AS (SELECT *, CASE WHEN coercion THEN CASE WHEN alt AND NOT {_has('question', rules.COERCION_QUESTION)} THEN 'coercion_not_requested_with_alternative' ELSE '' END WHEN role IS NOT NULL THEN CASE WHEN asks THEN '' ELSE 'generic_' || role || '_not_requested' END WHEN NOT penalty THEN '' WHEN {_has('question', rules.EXPLICIT_QUESTION)} OR {_has('question', rules.IMPLICIT_QUESTION)} OR {_has('question', rules.VIOLATION_QUESTION)} THEN '' WHEN alt THEN 'specific_penalty_not_requested_with_alternative' ELSE '' END AS reason FROM a),
g AS (SELECT *, min((reason <> '')::INTEGER) OVER (PARTITION BY qid) AS everything, max(position) OVER (PARTITION BY qid) AS last FROM d) SELECT qid, position, reason FROM g WHERE reason = '' OR (everything = 1 AND position = last)""",
    "role_rules": f"WITH {_CANDIDATES} SELECT qid, position, {_ROLE} AS role, {_REASON} AS reason FROM c",
    "reason_counts": f"WITH {_CANDIDATES} SELECT {_REASON} AS reason, count(*) AS n FROM c GROUP BY 1",
    "confidence_merge": "WITH t AS (SELECT conv_id, length(coalesce(text, '')) AS l FROM conversations), u AS (SELECT conv_id, CASE WHEN l < 200 THEN 'low' WHEN l < 600 THEN 'medium' ELSE 'high' END AS c, l = 0 AS f FROM t) SELECT conv_id, CASE WHEN bool_or(f) THEN 'low' WHEN bool_and(c = 'low') THEN 'low' WHEN bool_or(c <> 'high') THEN 'medium' ELSE 'high' END AS confidence FROM u GROUP BY conv_id",
    "fair_share_budget": "SELECT source, lang, count(*) AS n, least(2400, greatest(1, 48000 // count(*)))::INTEGER AS share FROM documents GROUP BY source, lang",
    "prompt_render": f"WITH {_CANDIDATES}, s AS (SELECT *, least(300, greatest(1, 1200 // count(*) OVER (PARTITION BY qid)))::INTEGER AS m FROM c), t AS (SELECT *, greatest(20, (m - 7) // 4) AS tail FROM s), b AS (SELECT qid, question, position, '[' || position || '] ' || article || chr(10) || CASE WHEN length(content) <= m THEN content ELSE rtrim(substr(content, 1, m - 7 - tail)) || ' [...] ' || ltrim(right(content, tail)) END AS block FROM t), p AS (SELECT qid, 'Question: ' || first(question) || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY position) AS prompt FROM b GROUP BY qid) SELECT qid, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM p",
    "batches_of_six": "WITH r AS (SELECT conv_id % 50 AS qid, conv_id, turn, row_number() OVER (PARTITION BY conv_id % 50 ORDER BY conv_id, turn) - 1 AS n FROM conversations) SELECT qid, conv_id, turn, (n // 6)::INTEGER AS batch, 'A' || (n % 6 + 1) AS key FROM r",
    "citation_mentions": "SELECT doc_id, array_to_string(list_distinct_keep(n), ',') AS numbers FROM x",
    "stage_selection": f"""WITH {_CANDIDATES}, q AS (SELECT *, substr(first(content) OVER (PARTITION BY qid ORDER BY position), 1, 60) AS asked FROM c),
h AS (SELECT *, len(list_intersect({LONG_WORDS.format('asked')}, {LONG_WORDS.format('substr(content, 1, 1800)')})) > 0 AS hit FROM q),
l AS (SELECT qid, list(article ORDER BY position) AS a, coalesce(list(article ORDER BY position) FILTER (hit), []) AS s FROM h GROUP BY qid),
f AS (SELECT qid, a, s, CASE len(s) WHEN 0 THEN a[1:3] WHEN 1 THEN CASE WHEN s[1] = a[1] THEN s ELSE [s[1], a[1]] END ELSE s END AS filled FROM l)
SELECT qid, array_to_string(filled, ';') AS selected, CASE WHEN len(s) > 0 THEN 'high' ELSE 'low' END AS confidence, array_to_string(list_filter(a, lambda x: list_contains(filled, x)), ';') AS final FROM f""",
    "citation_validate": f"""WITH {_CANDIDATES}, p AS (SELECT qid, doc_id::VARCHAR AS number, doc_id % 6 AS way, doc_id FROM c),
w AS (SELECT qid, string_agg('Điều ' || number || ' (9/2020/QH)', ', ' ORDER BY number) FILTER (way = 2) AS outside, string_agg('Điều ' || (doc_id + 1000000), ', ' ORDER BY (doc_id + 1000000)::VARCHAR) FILTER (way = 4) AS bare, count(*) FILTER (way < 2) AS good FROM p GROUP BY qid)
SELECT qid, outside IS NULL AND bare IS NULL AND good > 0 AS ok, CASE WHEN outside IS NOT NULL THEN '{citations.OUTSIDE}' || outside WHEN bare IS NOT NULL THEN '{citations.NUMBER_OUTSIDE}' || bare WHEN good = 0 THEN '{citations.NOTHING_SUPPORTED}' ELSE 'ok' END AS detail FROM w""",
    "submission_validate": """WITH r AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 'x' WHEN doc_id % 40 = 1 THEN '7' ELSE doc_id::VARCHAR END AS id, CASE WHEN doc_id % 30 = 2 THEN NULL ELSE lang END AS question, doc_id FROM documents), p AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM r)
SELECT id, 'missing field' AS problem FROM p WHERE question IS NULL UNION ALL SELECT id, 'id is not an integer' FROM p WHERE id = 'x' UNION ALL SELECT id, 'id is repeated' FROM p WHERE n > 1 UNION ALL SELECT id, 'bad document reference' FROM p WHERE doc_id % 20 = 4 UNION ALL SELECT id, 'bad article reference' FROM p WHERE doc_id % 35 = 5 UNION ALL SELECT id, 'answer cites no article' FROM p WHERE doc_id % 25 = 3""",
    "stage_checked": """WITH b AS (SELECT CASE WHEN doc_id % 19 = 4 THEN -doc_id - 1 ELSE doc_id END AS id, CASE WHEN doc_id % 23 = 5 THEN '' ELSE lang END AS answer, 'a' || doc_id % 40 AS article FROM documents WHERE doc_id % 17 <> 3), r AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE id % 29 = 6), k AS (SELECT DISTINCT 'a' || doc_id % 37 AS article FROM documents)
SELECT doc_id::VARCHAR AS id, 'is missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT id FROM r) UNION ALL SELECT DISTINCT id::VARCHAR, 'wasn''t expected' FROM r WHERE id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT id::VARCHAR, 'is repeated' FROM r GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id::VARCHAR, 'has no answer' FROM r WHERE coalesce(answer, '') = '' UNION ALL SELECT DISTINCT id::VARCHAR, 'names the unknown ' || article FROM r WHERE article NOT IN (SELECT article FROM k)""",
    "stores_consistent": """WITH d AS (SELECT doc_id AS id, 'h' || doc_id % 5 AS hash FROM documents), v AS (SELECT vec_id AS id, 'h' || CASE WHEN vec_id % 11 = 0 THEN 9 ELSE vec_id % 5 END AS hash, CASE WHEN label = 0 THEN 'old' ELSE 'm' END AS model FROM embeddings), p AS (SELECT DISTINCT CASE WHEN doc_id % 13 = 0 THEN -doc_id - 1 ELSE doc_id END AS id FROM labels)
SELECT 'documents share an id or have none' AS problem, (SELECT count(*) FROM (SELECT count(*) OVER (PARTITION BY id) AS n FROM d) WHERE n > 1) AS n UNION ALL SELECT 'indexed documents are unknown', (SELECT count(*) FROM p WHERE id NOT IN (SELECT id FROM d)) UNION ALL SELECT 'documents have no vector', (SELECT count(*) FROM d WHERE id NOT IN (SELECT id FROM v)) UNION ALL SELECT 'vectors are of unknown documents', (SELECT count(*) FROM v WHERE id NOT IN (SELECT id FROM d))
UNION ALL SELECT 'vectors are of another text', (SELECT count(*) FROM d JOIN v USING (id) WHERE d.hash <> v.hash) UNION ALL SELECT 'vectors are of another model', (SELECT count(*) FROM v WHERE model <> 'm')""",
    "map_merge": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'more=yes,nation=null,new=' || c_custkey WHEN 1 THEN 'more=yes,nation=x,new=none' ELSE 'more=yes,nation=' || c_nationkey || ',new=none' END || ',segment=' || c_mktsegment AS merged FROM customer",
    "referential_check": "SELECT doc_id, 'no document' AS problem FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'no label' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "id_set_equal": "SELECT 'orders_lines' AS pair, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS only_left, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS only_right, 0::BIGINT AS repeated UNION ALL SELECT 'vectors_documents', (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)), (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)), 0",
    "semi_join_keep": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "anti_join_todo": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "lookup_join": "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "settings_grid": "SELECT q AS most_quantity, d AS least_discount, count(*) AS n, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN (SELECT unnest([10.0, 25.0, 40.0])::DOUBLE AS q) ON l_quantity <= q JOIN (SELECT unnest([0.02, 0.06])::DOUBLE AS d) ON l_discount >= d GROUP BY q, d",
    "route_turns": "SELECT conv_id, turn, CASE WHEN n < 5 THEN 'out_of_scope' WHEN n < 15 THEN 'small_talk' ELSE 'legal' END AS route FROM (SELECT *, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda x: length(x) > 1)) AS n FROM conversations WHERE role = 'user')",
    "default_assembly": f"WITH {INDEX_SQL}, {questions_sql('lex', 10)}, l AS (SELECT qid, list(doc_id ORDER BY rank) AS c FROM lex GROUP BY qid) SELECT qid, array_to_string(CASE WHEN qid % 4 <> 0 THEN list_filter(c, lambda x: x % 2 = 0) ELSE c[1:5] END, ',') AS items, CASE WHEN qid % 4 <> 0 THEN 'verified' ELSE 'missing_record_default' END AS origin FROM l",
    "reference_codecs": "WITH r AS (SELECT p_partkey, concat_ws('|', ' ' || p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN p_name END, 'Điều ' || p_size) AS ref FROM part) SELECT p_partkey, array_to_string(string_split(ref, '|')[1:2], '|') AS doc, regexp_replace(ref, '\\|[^|]*$', '') AS before_last, array_to_string(string_split(ref, '|')[1:2], '|') AS or_empty, trim(split_part(ref, '|', 1)) AS law_id, trim(string_split(ref, '|')[-1]) AS number FROM r",
}
ORACLES["citation_mentions"] = "WITH a AS (SELECT doc_id, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)), n AS (SELECT doc_id, (i % 4) || CASE WHEN i % 3 = 0 THEN 'a' ELSE '' END AS number, min(i) AS i FROM a GROUP BY doc_id, number) SELECT doc_id, string_agg(number, ',' ORDER BY i) AS numbers FROM n GROUP BY doc_id"
