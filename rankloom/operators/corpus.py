"""Corpus building: filters on metadata, article parsing within rows, deduplication and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import clauses_of, collapse, text_of, title_of

#: Words behind a marker that make it a cross-reference, and the marker itself.
MARKER = r"(?:Điều|ĐIỀU)\s+(\d+[a-zđ]?)\s*\.\s+"
REFERENCE = r"(?iuU)^(?:của|này|đó|trên|sau|dưới|và|hoặc|nêu|nói|quy\s+định\s+(?:này|đó|nêu|áp|đã|theo|như)|khoản|điểm|,|;)"


def fold(c: Column) -> Column:
    return F.lower(F.trim(text_of(c)))


def contains_any(c: Column, words: list[str]) -> Column:
    text, out = F.lower(text_of(c)), F.lit(False)
    for w in words:
        out = out | text.contains(w.lower())
    return out


def canonical_type(rows: DataFrame, types: DataFrame, type_col: str) -> DataFrame:
    """Rows whose type, case aside, the mapping (raw, canonical) knows, with ``canonical``."""
    keyed = types.select(F.lower("raw").alias("_raw"), "canonical")
    return rows.withColumn("_raw", fold(F.col(type_col))).join(keyed, "_raw").drop("_raw")


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


MARK = "struct<pos:bigint,number:string,num:bigint,letter:string,body_at:bigint>"


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marker: str = MARKER, reference: str = REFERENCE) -> DataFrame:
    """(id, text, marks): article markers of each text that aren't cross-references, as an array of (pos from 1, number, num, letter, body_at).

    All of it is made within the row: offsets are running sums of the lengths of what lies between
    the matches. Texts without a match are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), collapse(F.col(text_col)).alias("text"))
    rows = rows.select("id", "text", F.regexp_extract_all("text", F.lit(marker), F.lit(0)).alias("m"), F.regexp_extract_all("text", F.lit(marker), F.lit(1)).alias("g")).where(F.size("m") > 0)
    rows = rows.select("id", "text", "m", "g", F.zip_with("m", F.slice(F.split("text", marker, -1), F.lit(1), F.size("m")), lambda m, gap: F.length(gap) + F.length(m)).alias("steps"))
    ends = F.aggregate("steps", F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    rows = rows.select("id", "text", "m", "g", F.slice(ends, F.lit(2), F.size("steps")).alias("ends"))
    number = lambda g: F.struct(g.alias("number"), F.regexp_extract(g, r"^\d+", 0).cast("long").alias("num"), F.regexp_extract(g, r"^\d+(.*)$", 1).alias("letter"))
    told = F.transform(F.zip_with("m", "ends", lambda m, end: F.struct((end + 1 - F.length(m)).alias("pos"), (end + 1).alias("body_at"))), lambda x, k: F.struct(x["pos"].alias("pos"), number(F.get("g", k)).alias("n"), x["body_at"].alias("body_at")))
    flat = F.transform(told, lambda x: F.struct(x["pos"].alias("pos"), x["n"]["number"].alias("number"), x["n"]["num"].alias("num"), x["n"]["letter"].alias("letter"), x["body_at"].alias("body_at")))
    return rows.select("id", "text", F.filter(flat, lambda x: ~F.substring(F.col("text"), x["body_at"].cast("int"), F.lit(30)).rlike(reference)).alias("marks"))


def ascending(marks: Column) -> Column:
    """Marks whose number, then letter, exceeds all before them."""
    key = lambda x: F.struct(x["num"].alias("num"), x["letter"].alias("letter"))
    start = F.struct(F.struct(F.lit(0).cast("bigint").alias("num"), F.lit("").alias("letter")).alias("best"), F.array().cast(f"array<{MARK}>").alias("kept"))
    grown = lambda acc, x: F.struct(key(x).alias("best"), F.concat(acc["kept"], F.array(x)).alias("kept"))
    return F.aggregate(marks, start, lambda acc, x: F.when(key(x) > acc["best"], grown(acc, x)).otherwise(acc), lambda acc: acc["kept"])


def boundaries(found: DataFrame) -> DataFrame:
    """(id, pos, number, num, letter, body_at) of the marks of :func:`marked` that begin an article, a row each."""
    return found.select("id", F.inline(ascending(F.col("marks"))))


def articles(found: DataFrame) -> DataFrame:
    """Articles between boundaries: id, number, title, content, clauses; empty ones are left out. No shuffle: a text is cut where it lies."""
    rows = found.select("id", "text", ascending(F.col("marks")).alias("kept"))
    end = lambda k: F.coalesce(F.get("kept", k + 1)["pos"], F.length("text") + 1)
    cut = F.transform("kept", lambda x, k: F.struct(F.concat(F.lit("Điều "), x["number"]).alias("number"), F.trim(F.substring(F.col("text"), x["body_at"].cast("int"), (end(k) - x["body_at"]).cast("int"))).alias("content")))
    rows = rows.select("id", F.inline(cut)).where("content <> ''")
    return rows.select("id", "number", title_of(F.col("content")).alias("title"), "content", clauses_of(F.col("content")).alias("clauses"))


def profile(rows: DataFrame, col: str, n: int) -> DataFrame:
    """The n most frequent values of a column, nulls as empty, with their count."""
    return rows.groupBy(text_of(F.col(col).cast("string")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def size_statistics(rows: DataFrame, value: Column, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.min(value).alias("smallest"), F.max(value).alias("largest"), F.round(F.avg(value), 6).alias("average"), F.median(value).alias("middle"))
