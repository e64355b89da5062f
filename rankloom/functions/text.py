"""Text normalisers, the tokeniser, reference codecs, content ids and excerpts, as column expressions.

Null counts as an empty text everywhere.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


#: Characters that canonical composition leaves alone wherever they stand: Latin letters with their accents, punctuation and ideographs.
COMPOSED = r"\x00-\u02FF\u1E00-\u1EFF\u2010-\u2027\u4E00-\u9FFF"


def nfc(c: Column) -> Column:
    """Canonical composition. Only texts that may need it leave the JVM; null stays null."""
    return F.coalesce(_compose(F.when(c.rlike(f"[^{COMPOSED}]"), c)), c)


def composed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a text column composed, in one pass over batches: those in which nothing needs it, which are nearly all, go through as they came."""
    at = rows.columns.index(column)
    odd = "[^" + re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", COMPOSED) + "]"  # as Arrow's engine writes it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            needed = pc.fill_null(pc.match_substring_regex(texts, odd), False)
            if pc.any(needed).as_py():
                made = pa.array([unicodedata.normalize("NFC", t) for t in texts.filter(needed).to_pylist()], texts.type)
                texts = pc.replace_with_mask(texts, needed, made)
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def plain_tokens(c: Column) -> Column:
    """``tokens`` of texts that are composed already."""
    return F.filter(F.split(F.lower(text_of(c)), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) > 1)


def tokens(c: Column) -> Column:
    """Lower-cased words of two or more letters, digits or underscores, of the composed text."""
    return plain_tokens(nfc(text_of(c)))


# --- references: law|type and name|article ----------------------------------------------------


def doc_of(ref: Column) -> Column:
    """The first two parts; a reference of one part stays as it is."""
    return F.substring_index(ref, "|", 2)


def doc_before_last(ref: Column) -> Column:
    """Everything before the last separator."""
    return F.regexp_replace(ref, r"\|[^|]*$", "")


def doc_or_empty(ref: Column) -> Column:
    """The first two parts, or empty for a reference of one part."""
    return F.when(F.size(F.split(ref, r"\|")) >= 2, doc_of(ref)).otherwise(F.lit(""))


def lookup_key(ref: Column) -> Column:
    """(law, article) of a reference of three parts or more, else null."""
    whole = F.size(F.split(ref, r"\|")) >= 3
    return F.when(whole, F.struct(F.trim(F.substring_index(ref, "|", 1)).alias("law_id"), F.trim(F.substring_index(ref, "|", -1)).alias("number")))


def law_of(ref: Column) -> Column:
    """The law's id, without a leading apostrophe."""
    return F.trim(F.regexp_replace(F.substring_index(ref, "|", 1), "^'+", ""))


def document_ref(law_id: Column, law_type: Column, law_name: Column, coded: bool = False) -> Column:
    """A law's reference; ``coded`` has its id in the name as well, behind the type."""
    return F.concat_ws("|", law_id, F.concat_ws(" ", law_type, *([law_id] if coded else []), law_name))


def article_ref(law_id: Column, law_type: Column, law_name: Column, number: Column, coded: bool = False) -> Column:
    return F.concat_ws("|", document_ref(law_id, law_type, law_name, coded), number)


# --- ids, fingerprints and texts for models ---------------------------------------------------


def content_id(law_id: Column, number: Column, content: Column) -> Column:
    return F.md5(F.concat_ws("|", law_id, number, F.substring(text_of(content), 1, 120)))


def dashed(hexed: Column) -> Column:
    """32 hex digits as a dashed id."""
    return F.regexp_replace(hexed, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def embedding_text(law_type: Column, law_name: Column, number: Column, title: Column, content: Column) -> Column:
    return F.concat(F.concat_ws(" ", text_of(law_type), F.substring(text_of(law_name), 1, 220)), F.lit("\n"), text_of(number), F.lit(". "), F.substring(text_of(title), 1, 180), F.lit("\n"), F.substring(text_of(content), 1, 1000))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the composed text, so that composed and decomposed spellings have one."""
    return F.sha2(nfc(text), 256)


def query_text(question: Column, instruction: str) -> Column:
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), question)


def strip_type(name: Column, kind: Column) -> Column:
    """The name without its leading type, unless nothing would remain."""
    rest = F.trim(F.substring(name, F.length(F.trim(kind)) + 1, F.length(name)))
    return F.when(F.startswith(F.lower(name), F.lower(F.trim(kind))) & (rest != ""), rest).otherwise(F.trim(name))


def upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def excerpt(c: Column, most: Column | int, mark: str = " [...] ") -> Column:
    """Texts longer than ``most`` as their head (three quarters) and tail (the rest, 20 at least) around a mark."""
    most = F.lit(most) if isinstance(most, int) else most
    room = F.greatest(most - len(mark), F.lit(1))
    tail = F.greatest(F.lit(20), F.floor(room / 4)).cast("int")
    head = F.greatest(room - tail, F.lit(1)).cast("int")
    text = text_of(c)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), head)), F.lit(mark), F.ltrim(F.right(text, tail))))


def title_of(body: Column) -> Column:
    """The title of an article: what precedes its first clause, if that begins within 300 characters; else up to 180 characters, cut at the last space beyond the 40th."""
    clause = F.regexp_instr(body, F.lit(r"(?:^|\s+)\d{1,2}\.\s+"))
    before = F.trim(F.substring(body, F.lit(1), clause - 1))
    hint = F.trim(F.substring(body, 1, 180))
    cut = F.length(hint) - F.locate(" ", F.reverse(hint))
    short = F.when((F.length(body) > 180) & F.contains(hint, F.lit(" ")) & (cut > 40), F.substring(hint, F.lit(1), cut)).otherwise(hint)
    return F.when((clause > 0) & (clause <= 300), before).otherwise(short)


def clauses_of(content: Column) -> Column:
    """Numbered clauses of an article as (id, text); empty ones are left out."""
    form = r"(?:^|\s+)(\d{1,2})\.\s+"
    ids = F.regexp_extract_all(content, F.lit(form), F.lit(1))
    bodies = F.slice(F.split(content, form, -1), F.lit(2), F.size(ids))
    return F.filter(F.zip_with(ids, bodies, lambda i, t: F.struct(i.alias("id"), F.trim(t).alias("text"))), lambda x: x["text"] != "")


def mentions(c: Column) -> Column:
    """Numbers of the articles that a text cites, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text_of(c), F.lit("Điều\\s+(\\d+[a-zđ]?)"), F.lit(1)))


def html_text(c: Column) -> Column:
    """Text of a page: no scripts, styles or comments; tags become spaces; frequent entities are read; white space collapses."""
    out = F.regexp_replace(text_of(c), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return collapse(out)
