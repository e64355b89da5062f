"""Checks of what an answer cites, as expressions on arrays.

An answer is cut once into marks: mentions of articles, ids of laws, and ends of clauses, each with
its place and the number of clauses before it (a mention ends a clause as well, so no law is taken
across another mention). A mention's candidates are the laws of its clause, on either side, that
stand near enough; the one with the least key wins: the preferred side first, then the distance.
The preferred side is the right one, or the left one for a mention in parentheses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import text_of

#: How articles, laws and ends of clauses are written, and how far apart a citation's parts may be.
MENTION = r"(?<![\p{L}\p{N}_])Điều\s+(\d+[a-zđ]?)"
LAW_ID = r"\d+[^\S\n]*/[^\S\n]*(?:\d{4}[^\S\n]*/[^\S\n]*)?(?!Điều\s+\d)[A-ZĐa-zđ][\p{L}\p{N}_\-]*"
CLAUSE_END = r"[\n;]|\.(?=\s|$)"
STANDARD_LAW_ID = r"^\d{1,4}/(?:\d{4}/)?[A-ZĐ][A-ZĐ0-9\-]*$"
DIRECT, HEADER, EVIDENCE = 100, 300, 300
#: What a check says; {} stands for the citations.
EMPTY = "answer is empty"
NO_EVIDENCE = "supplied articles do not contain valid citation metadata"
NO_MENTION = "answer does not contain an 'Điều X' citation"
OUTSIDE = "citation is not present in supplied articles: "
NUMBER_OUTSIDE = "unqualified article is not present in supplied articles: "
NOTHING_SUPPORTED = "answer has no fully qualified citation from supplied articles"

FLAGS = "(?iuU)"
NONE = "array<struct<number:string,law:string>>"


def canon(law: Column) -> Column:
    """A law's id in upper case without white space."""
    return F.upper(F.regexp_replace(text_of(law), r"(?U)\s+", ""))


def number_of(c: Column) -> Column:
    """The number of the first article that is mentioned, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(text_of(c), FLAGS + MENTION, 1))


def marks(text: Column) -> Column:
    """The marks of a text in order: kind (mention, law or end), text, start and end (from 0), clause, and whether a parenthesis opens just before it."""
    form = f"{FLAGS}{MENTION}|{LAW_ID}|{CLAUSE_END}"
    found = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, form, -1), F.lit(1), F.size(found)), found, lambda gap, mark: F.struct(gap.alias("gap"), mark.alias("mark")))
    kind = lambda m: F.when(m.rlike(FLAGS + "^" + MENTION), "mention").when(m.rlike(FLAGS + f"^(?:{LAW_ID})"), "law").otherwise("end")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("clause"), F.array().cast("array<struct<kind:string,text:string,start:int,end:int,clause:int,opened:boolean>>").alias("all"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.length(x["mark"])
        mark = F.struct(kind(x["mark"]).alias("kind"), x["mark"].alias("text"), begin.alias("start"), end.alias("end"), s["clause"].alias("clause"), x["gap"].rlike(r"(?U)\(\s*$").alias("opened"))
        return F.struct(end.alias("at"), (s["clause"] + (mark["kind"] != "law").cast("int")).alias("clause"), F.array_append(s["all"], mark).alias("all"))

    return F.aggregate(pairs, start, step)["all"]


def supplied(articles: Column, number: str = "number", law: str = "law_id") -> Column:
    """The pairs of number and law that may be cited; articles without either are left out."""
    return F.filter(F.transform(articles, lambda a: F.struct(number_of(a[number]).alias("number"), canon(a[law]).alias("law"))), lambda p: (p["number"] != "") & (p["law"] != ""))


def cited(text: Column, laws: Column) -> Column:
    """(number, law) of each mention in order; the law is null where none stands near. Ids count if ``laws`` has them or they have the usual form."""
    every = marks(text)

    def law_of(m: Column) -> Column:
        near = F.transform(
            F.filter(every, lambda x: (x["kind"] == "law") & x["clause"].isin(m["clause"], m["clause"] + 1) & (F.array_contains(laws, canon(x["text"])) | canon(x["text"]).rlike(STANDARD_LAW_ID))),
            lambda x: F.struct(((x["clause"] == m["clause"]) != m["opened"]).alias("other_side"), F.when(x["clause"] == m["clause"], m["start"] - x["end"]).otherwise(x["start"] - m["end"]).alias("distance"), canon(x["text"]).alias("law")),
        )
        return F.array_min(F.filter(near, lambda x: x["distance"] <= DIRECT))["law"]

    return F.transform(F.filter(every, lambda x: x["kind"] == "mention"), lambda m: F.struct(number_of(m["text"]).alias("number"), law_of(m).alias("law")))


def check(answer: Column, articles: Column, known: Column | None = None, number: str = "number", law: str = "law_id") -> Column:
    """(ok, detail, outside) of an answer: whether all that it cites is supplied, why not, and the cited pairs that aren't.

    ``known`` are ids of further laws. Null answers count as empty ones, null articles as none.
    """
    text = F.trim(text_of(answer))
    allowed = supplied(F.coalesce(articles, F.array()), number, law) if articles is not None else F.array().cast(NONE)
    laws = F.transform(allowed, lambda p: p["law"])
    laws = laws if known is None else F.concat(laws, F.transform(F.coalesce(known, F.array().cast("array<string>")), canon))
    found = cited(text, laws)
    pairs = F.array_sort(F.array_distinct(F.filter(found, lambda p: p["law"].isNotNull())))
    outside = F.filter(pairs, lambda p: ~F.array_contains(allowed, p))
    numbers = F.transform(allowed, lambda p: p["number"])
    bare = F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda p: p["law"].isNull() & ~F.array_contains(numbers, p["number"])), lambda p: p["number"])))
    named = lambda p: F.concat(F.lit("Điều "), p["number"], F.lit(" ("), p["law"], F.lit(")"))
    detail = (
        F.when(text == "", EMPTY).when(F.size(allowed) == 0, NO_EVIDENCE).when(F.size(found) == 0, NO_MENTION)
        .when(F.size(outside) > 0, F.concat(F.lit(OUTSIDE), F.array_join(F.transform(outside, named), ", ")))
        .when(F.size(bare) > 0, F.concat(F.lit(NUMBER_OUTSIDE), F.array_join(F.transform(bare, lambda n: F.concat(F.lit("Điều "), n)), ", ")))
        .when(F.size(pairs) == 0, NOTHING_SUPPORTED).otherwise("ok")
    )
    return F.struct((detail == "ok").alias("ok"), detail.alias("detail"), F.when((text != "") & (F.size(allowed) > 0), outside).otherwise(F.array().cast(NONE)).alias("outside"))


def explained(pair: Column, articles: Column) -> Column:
    """Whether supplied evidence (law_id, number, title, content) itself accounts for a pair (number, law) outside of it.

    An article of the same law does if its title or its content begins with that number and it is
    listed under another one; any article does that mentions the number, in the same law or with the
    law's id around the mention.
    """

    def accounts(a: Column) -> Column:
        own = canon(a["law_id"]) == pair["law"]
        heads = F.array(text_of(a["title"]), F.substring(text_of(a["content"]), 1, HEADER))
        headed = F.exists(heads, lambda h: F.lower(F.regexp_extract(h, FLAGS + r"^\s*" + MENTION, 1)) == pair["number"])
        text = F.concat(text_of(a["title"]), F.lit("\n"), text_of(a["content"]))
        around = lambda m: canon(F.substring(text, F.greatest(m["start"] - EVIDENCE, F.lit(0)) + 1, m["end"] - F.greatest(m["start"] - EVIDENCE, F.lit(0)) + EVIDENCE))
        mentioned = F.exists(F.filter(marks(text), lambda m: m["kind"] == "mention"), lambda m: (number_of(m["text"]) == pair["number"]) & (own | F.contains(around(m), pair["law"])))
        return (own & headed & (number_of(a["number"]) != pair["number"])) | mentioned

    return F.exists(articles, accounts)


def fault(answer: Column, articles: Column, known: Column | None = None) -> Column:
    """Why an answer must be made again, or null. Only an empty answer, and pairs that the evidence neither holds nor explains, are reasons; what is ambiguous passes."""
    told = check(answer, articles, known)
    unexplained = F.exists(told["outside"], lambda p: ~explained(p, articles))
    return F.when((F.trim(text_of(answer)) == "") | unexplained, told["detail"])


def pairs_told(detail: Column) -> Column:
    """The pairs (number, law) that a check's detail names, read back from it."""
    form = r"Điều (\S+) \(([^()]*)\)"
    one = lambda k: F.regexp_extract_all(text_of(detail), F.lit(form), F.lit(k))
    return F.zip_with(one(1), one(2), lambda n, w: F.struct(n.alias("number"), w.alias("law")))
