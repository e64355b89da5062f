"""Answers cut into segments for display, with citations linked to the articles that they name, as expressions on arrays.

A text is cut by one pattern into what matches and what lies between, each known by its place in the
list, so nothing is searched twice. A citation is an article's number with its clause and point, and
the law that is named right before or behind it. It is linked to the article of that number; of
several, to the one whose law id stands around the citation, else to one of whose name three words
do, else to the first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import text_of
from rankloom.operators.citations import FLAGS

#: Kinds of laws, how a citation is written, what joins two of them, and the marks of markdown.
LAW_KIND = r"(?:Bộ\s+luật|Luật|Nghị\s+định|Thông\s+tư\s+liên\s+tịch|Thông\s+tư|Nghị\s+quyết|Pháp\s+lệnh|Quyết\s+định|Hiến\s+pháp)"
ARTICLE = r"(?:điểm\s+[A-Za-zÀ-ỹ]\s+)?(?:khoản\s+\d+[A-Za-zÀ-ỹ]?\s+)?Điều\s+\d+[A-Za-zÀ-ỹ]?(?:\s*,?\s*khoản\s+\d+[A-Za-zÀ-ỹ]?)?(?:\s*,?\s*điểm\s+[A-Za-zÀ-ỹ](?![\p{L}]))?"
JOINED = r"(?:và|hoặc|cùng|theo)"
STYLED = r"(\*\*\*|\*\*|__|`)(.+?)\1"
HEADING, BULLET = r"^(#{1,6})\s*(.+?)\s*#*\s*$", r"^([-*+]|\d+[.)])\s+(.+)$"
LINK, SOURCE, TAG = r"\[([^\]]+)\]\([^)]+\)", r"\s*\[(?:A|D|S|R)\d+\]", r"<[^>]+>"
#: Characters around a citation in which a law is looked for, and words of its name that must be found, of so many letters at least.
BEFORE, AFTER, WORDS, LETTERS = 140, 180, 3, 4

_NAME = rf"{LAW_KIND}\s+(?:(?!\s{JOINED}\s)[^,;.\n()])" + "{0,180}?"
CITATION = rf"(?:{_NAME}\s*\(?\s*)?{ARTICLE}(?:\s*,?\s+(?:của\s+)?{_NAME}(?=\s+{JOINED}\s|\s*[,;.\n()]|\s*$))?(?:(?<=\()\)|(?<![\s(])\)(?=[\s,;.]|$))?"
SEGMENT = "struct<kind:string,text:string,level:int,article:int>"


def _cut(text: Column, form: str) -> Column:
    """What matches and what doesn't, in turn: text, before, after (what lies on either side up to the next match), and whether it matches; empty parts are left out."""
    found = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    gaps = F.split(text, form, -1)
    none = F.lit(None).cast("string")
    both = F.transform(gaps, lambda gap, k: F.array(F.struct(gap.alias("text"), none.alias("before"), none.alias("after"), F.lit(False).alias("hit")), F.struct(F.get(found, k).alias("text"), gap.alias("before"), F.get(gaps, k + 1).alias("after"), F.lit(True).alias("hit"))))
    return F.filter(F.flatten(both), lambda x: F.coalesce(x["text"], F.lit("")) != "")


def best_article(citation: Column, before: Column, after: Column, articles: Column) -> Column:
    """The place (from 1) of the article (law_id, law_name, number) that a citation names; null if none has its number."""
    number = F.lower(F.regexp_extract(citation, FLAGS + r"Điều\s+(\d+[a-zđ]?)", 1))
    around = F.lower(F.concat(F.right(text_of(before), F.lit(BEFORE)), citation, F.substring(text_of(after), 1, AFTER)))

    def rank(a: Column, k: Column) -> Column:
        law, words = F.lower(F.trim(text_of(a["law_id"]))), F.filter(F.split(F.lower(text_of(a["law_name"])), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= LETTERS)
        of_law = (law != "") & F.contains(around, law)
        named = F.size(F.filter(words, lambda w: F.contains(around, w))) >= WORDS
        return F.when(F.lower(F.regexp_extract(text_of(a["number"]), r"\d+[A-Za-zđ]?", 0)) == number, F.struct(F.when(of_law, 0).when(named, 1).otherwise(2).alias("how"), (k + 1).alias("at")))

    return F.array_min(F.filter(F.transform(articles, rank), lambda x: x.isNotNull()))["at"]


def _segment(kind: Column | str, text: Column, level: Column | None = None, article: Column | None = None) -> Column:
    null = F.lit(None).cast("int")
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.alias("text"), (null if level is None else level.cast("int")).alias("level"), (null if article is None else article.cast("int")).alias("article"))


def _linked(text: Column, kind: Column, articles: Column) -> Column:
    """Segments of a text of one kind; citations that name an article are their own."""

    def one(x: Column) -> Column:
        article = F.when(x["hit"], best_article(x["text"], x["before"], x["after"], articles))
        return _segment(F.when(article.isNotNull(), "citation").otherwise(kind), x["text"], None, article)

    return F.transform(_cut(text, FLAGS + CITATION), one)


def _inline(text: Column, articles: Column) -> Column:
    """Segments of a line: plain ones, bold ones and code."""
    inner = lambda x: F.when(x["hit"], F.regexp_extract(x["text"], "(?s)" + STYLED, 2)).otherwise(x["text"])
    kind = lambda x: F.when(~x["hit"], "text").when(x["text"].startswith("`"), "code").otherwise("bold")
    return F.flatten(F.transform(_cut(text, STYLED), lambda x: _linked(inner(x), kind(x), articles)))


def _plain(line: Column) -> Column:
    """A line without links, marks of sources and tags, and without emphasis around all of it."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, LINK, "$1"), SOURCE, ""), TAG, ""))
    return F.regexp_replace(text, r"^(\*\*\*|\*\*|__|_)([^*_]+)\1$", "$2")


def blocks(answer: Column, articles: Column) -> Column:
    """The lines of an answer, each a list of segments (kind, text, level, article).

    Kinds are text, bold, code, bullet, heading (with its level) and citation (with the place of its
    article in ``articles``, from 1). Null counts as an empty answer, which has one empty line; texts
    of a line's segments, put together, are the line without its marks.
    """
    many = F.coalesce(articles, F.array().cast("array<struct<law_id:string,law_name:string,number:string>>"))

    def block(raw: Column) -> Column:
        line = _plain(raw)
        level = F.length(F.regexp_extract(line, HEADING, 1))
        marker, item = F.regexp_extract(line, BULLET, 1), F.regexp_extract(line, BULLET, 2)
        shown = F.when(marker.rlike(r"^\d"), F.concat(marker, F.lit(" "))).otherwise("• ")
        none = F.array().cast(f"array<{SEGMENT}>")
        return (
            F.when(line == "", F.array(_segment("text", F.lit("")))).when(level > 0, F.array(_segment("heading", _plain(F.regexp_extract(line, HEADING, 2)), level)))
            .otherwise(F.concat(F.when(marker != "", F.array(_segment("bullet", shown))).otherwise(none), _inline(F.when(marker != "", item).otherwise(line), many)))
        )

    return F.transform(F.split(F.regexp_replace(text_of(answer), r"\r\n?", "\n"), "\n"), block)
