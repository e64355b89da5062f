"""Queries of corpus building: filters, parsing, ids, deduplication, tolerant reading and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import corpus
from rankloom.sources import jsonl, tables

from .common import COLLAPSE, table


def meta_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a kept status, by case-folded comparison."""
    return table(spark, sf_dir, "orders").where(corpus.fold(F.col("o_orderstatus")).isin("f", "p")).select("o_orderkey", "o_orderstatus", "o_orderpriority")


def type_map_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose language the mapping knows, with its canonical name."""
    names = spark.createDataFrame([("EN", "English"), ("De", "German"), ("fr", "French")], "raw string, canonical string")
    return corpus.canonical_type(table(spark, sf_dir, "documents"), names, "lang").select("doc_id", "lang", "canonical")


KEYWORDS = ["the ", "and", "Ö", "réa"]


def domain_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where(corpus.contains_any(F.concat_ws(" ", "source", "text"), KEYWORDS)).select("doc_id", "lang")


def exclude_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without a brand or type that holds an excluded word."""
    parts = table(spark, sf_dir, "part")
    code = F.concat_ws("-", "p_brand", "p_type")
    return parts.where((T.text_of(F.col("p_brand")) != "") & ~corpus.contains_any(code, ["#1", "brass", "-TIN"])).select("p_partkey", "p_brand", "p_type")


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_text(F.col("html"))).alias("text_md5"), F.length(T.html_text(F.col("html"))).alias("n_chars"))


#: Words that mark sections of documents, as article markers do in statutes: the n-th line of a document is its article (7 n) mod 5 + n.
def _numbered(docs: DataFrame) -> DataFrame:
    docs = tables.spread(docs.select("doc_id", "text"))
    lines = F.split(T.text_of(F.col("text")), "\n")
    number = lambda i: ((i * 7) % 5 + i).cast("string")
    return docs.select("doc_id", F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("Điều "), number(i + 1), F.lit(". "), x, F.lit(" 1. "), F.substring(x, 1, 40))), " ").alias("text"))


def monotonic_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.marked(_numbered(table(spark, sf_dir, "documents")))
    return corpus.boundaries(found).select(F.col("id").alias("doc_id"), "pos", "number")


def article_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles between boundaries, by digests of their bodies and titles and the number of clauses."""
    rows = corpus.articles(corpus.marked(_numbered(table(spark, sf_dir, "documents"))))
    return rows.select(F.col("id").alias("doc_id"), "number", F.md5("title").alias("title_md5"), F.md5("content").alias("content_md5"), F.size("clauses").alias("n_clauses"))


def title_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = T.collapse(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.title_of(body).alias("title"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = T.content_id(F.col("source"), F.col("lang"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", hashed.alias("chunk_id"), T.dashed(hashed).alias("point_id"))


def embedding_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.embedding_text(F.col("lang"), F.col("source"), F.col("doc_id").cast("string"), F.substring("text", 1, 300), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(text).alias("fingerprint"))


def dedup_tier_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each first line, case aside: benchmark passages before documents, then by id."""
    line = F.lower(F.trim(F.substring_index("text", "\n", 1)))
    rows = table(spark, sf_dir, "documents").select(F.lit(1).alias("tier"), F.col("doc_id").alias("id"), line.alias("key")).unionByName(table(spark, sf_dir, "benchmark").select(F.lit(0).alias("tier"), F.col("item_id").alias("id"), line.alias("key")))
    return corpus.first_per_key(rows, ["key"], ["tier", "id"]).select("tier", "id", F.md5("key").alias("key_md5"))


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type."""
    return jsonl.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each order."""
    return corpus.first_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


def json_props_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a property read from JSON; what isn't JSON counts as without it."""
    rows = jsonl.parse(table(spark, sf_dir, "events").withColumn("value", F.col("props")), "k int, v string")
    return rows.select("event_id", F.col("data").isNotNull().alias("readable"))


def value_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.profile(table(spark, sf_dir, "documents"), "source", 10)


def size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations by role: characters."""
    return corpus.size_statistics(table(spark, sf_dir, "conversations"), F.length(T.text_of(F.col("text"))), ["role"])


def language_tier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents, labelled ones, and how many pass a length filter."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = lambda c: F.count_if(c)
    return docs.groupBy("lang").agg(F.count("*").alias("n"), n(F.col("quality").isNotNull()).alias("labelled"), n(F.length("text") >= 500).alias("kept"), n(F.col("quality") == 0).alias("poor"), F.count_distinct("source").alias("sources"))


def excerpt_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), 200).alias("excerpt"))


QUERIES = {f.__name__: f for f in (meta_filter, type_map_join, domain_keyword_filter, exclude_codes, html_to_text, monotonic_boundaries, article_slices, title_split, content_hash, embedding_fingerprint, dedup_tier_priority, latest_per_key, first_per_key, json_props_tolerant, value_profile, size_stats, language_tier_stats, excerpt_head_tail)}

_HTML = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"""
for _name, _char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_name}', '{_char}')"
_NUMBERED = f"""numbered AS (SELECT doc_id, {COLLAPSE.format("t")} AS text FROM (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: 'Điều ' || ((i * 7) % 5 + i) || '. ' || x || ' 1. ' || substr(x, 1, 40)), ' ') AS t FROM documents)),
m AS (SELECT doc_id, text, regexp_extract_all(text, '(?:Điều|ĐIỀU)\\s+(\\d+[a-zđ]?)\\s*\\.\\s+', 0) AS m, regexp_extract_all(text, '(?:Điều|ĐIỀU)\\s+(\\d+[a-zđ]?)\\s*\\.\\s+', 1) AS g, regexp_split_to_array(text, '(?:Điều|ĐIỀU)\\s+\\d+[a-zđ]?\\s*\\.\\s+') AS gaps FROM numbered),
u AS (SELECT doc_id, text, unnest(range(len(m))) AS k, unnest(m) AS mm, unnest(g) AS number, unnest(gaps[1:len(m)]) AS gap FROM m),
p AS (SELECT *, sum(length(gap) + length(mm)) OVER (PARTITION BY doc_id ORDER BY k) + 1 AS body_at FROM u),
c AS (SELECT doc_id, text, (body_at - length(mm))::BIGINT AS pos, number, regexp_extract(number, '^\\d+')::BIGINT AS num, regexp_extract(number, '^\\d+(.*)$', 1) AS letter, body_at::BIGINT AS body_at FROM p WHERE NOT regexp_matches(substr(text, body_at::BIGINT, 30), '(?i)^(?:của|này|đó|trên|sau|dưới|và|hoặc|nêu|nói|quy\\s+định\\s+(?:này|đó|nêu|áp|đã|theo|như)|khoản|điểm|,|;)')),
b AS (SELECT * FROM (SELECT *, max((num, letter)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c) WHERE (num, letter) > coalesce(before, (0::BIGINT, '')))"""
_BEFORE = "length(regexp_extract({0}, '^(.*?)(?:^|\\s+)\\d{{1,2}}\\.\\s+', 1))"
_HINT = "trim(substr({0}, 1, 180))"
_CUT = f"(length({_HINT}) - strpos(reverse({_HINT}), ' '))"
_TITLE = f"CASE WHEN regexp_matches({{0}}, '(?:^|\\s+)\\d{{{{1,2}}}}\\.\\s+') AND {_BEFORE} < 300 THEN trim(regexp_extract({{0}}, '^(.*?)(?:^|\\s+)\\d{{{{1,2}}}}\\.\\s+', 1)) WHEN length({{0}}) > 180 AND contains({_HINT}, ' ') AND {_CUT} > 40 THEN substr({_HINT}, 1, {_CUT}) ELSE {_HINT} END"
ORACLES = {
    "meta_filter": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE lower(trim(o_orderstatus)) IN ('f', 'p')",
    "type_map_join": "SELECT doc_id, lang, canonical FROM documents JOIN (VALUES ('en', 'English'), ('de', 'German'), ('fr', 'French')) v(raw, canonical) ON lower(trim(lang)) = raw",
    "domain_keyword_filter": "SELECT doc_id, lang FROM documents WHERE " + " OR ".join(f"contains(lower(concat_ws(' ', source, text)), '{w.lower()}')" for w in KEYWORDS),
    "exclude_codes": "SELECT p_partkey, p_brand, p_type FROM part WHERE coalesce(p_brand, '') <> '' AND NOT contains(lower(p_brand || '-' || p_type), '#1') AND NOT contains(lower(p_brand || '-' || p_type), 'brass') AND NOT contains(lower(p_brand || '-' || p_type), '-tin')",
    "html_to_text": f"SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT page_id, {COLLAPSE.format(_HTML)} AS t FROM pages)",
    "monotonic_boundaries": f"WITH {_NUMBERED} SELECT doc_id, pos, number FROM b",
    "article_slices": f"""WITH {_NUMBERED}, s AS (SELECT doc_id, 'Điều ' || number AS number, trim(substr(text, body_at, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), length(text) + 1) - body_at)) AS content FROM b)
SELECT doc_id, number, md5({_TITLE.format("content")}) AS title_md5, md5(content) AS content_md5, len(list_filter(regexp_split_to_array(content, '(?:^|\\s+)\\d{{1,2}}\\.\\s+')[2:], lambda x: trim(x) <> '')) AS n_clauses FROM s WHERE content <> ''""",
    "title_split": f"SELECT doc_id, {_TITLE.format('t')} AS title FROM (SELECT doc_id, {COLLAPSE.format('text')} AS t FROM documents)",
    "content_hash": r"SELECT doc_id, h AS chunk_id, regexp_replace(h, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS point_id FROM (SELECT doc_id, md5(source || '|' || lang || '|' || substr(text, 1, 120)) AS h FROM documents)",
    "embedding_fingerprint": "SELECT doc_id, sha256(nfc_normalize(lang || ' ' || substr(source, 1, 220) || chr(10) || doc_id || '. ' || substr(text, 1, 180) || chr(10) || substr(text, 1, 1000))) AS fingerprint FROM documents",
    "dedup_tier_priority": "WITH r AS (SELECT 1 AS tier, doc_id AS id, lower(trim(split_part(text, chr(10), 1))) AS key FROM documents UNION ALL SELECT 0, item_id, lower(trim(split_part(text, chr(10), 1))) FROM benchmark) SELECT tier, id, md5(key) AS key_md5 FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, id) AS n FROM r) WHERE n = 1",
    "latest_per_key": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "first_per_key": "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1",
    "json_props_tolerant": "SELECT event_id, json_valid(props) AS readable FROM events",
    "value_profile": "SELECT coalesce(source, '') AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    "size_stats": "SELECT role, min(l) AS smallest, max(l) AS largest, round(avg(l), 6) AS average, median(l)::DOUBLE AS middle FROM (SELECT role, length(coalesce(text, '')) AS l FROM conversations) GROUP BY role",
    "language_tier_stats": "SELECT lang, count(*) AS n, count(quality) AS labelled, count(*) FILTER (length(text) >= 500) AS kept, count(*) FILTER (quality = 0) AS poor, count(DISTINCT source) AS sources FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "excerpt_head_tail": "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE rtrim(substr(text, 1, 193 - 48)) || ' [...] ' || ltrim(right(text, 48)) END AS excerpt FROM documents",
}
